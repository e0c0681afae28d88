"""PAM/PFS rules: SIDE:MOTIF against the flanks of a protospacer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.dna import IUPAC, rounded

#: Curated rule per subtype. Fixed values.
CURATED_RULES = {"I-E": "5prime:AWG", "I-F": "genomic_3prime:GG", "I-A": "5prime:CCN", "II-A": "3prime:NGG", "V-A": "5prime:TTTN"}
#: Ways to write a side. Fixed values.
SIDES = {
    "5prime": ("5", "5P", "5PRIME", "UPSTREAM"),
    "3prime": ("3", "3P", "3PRIME", "DOWNSTREAM"),
    "genomic_5prime": ("GENOMIC_5", "GENOMIC5", "GENOMIC_5P", "GENOMIC_5PRIME", "GENOMIC_UPSTREAM"),
    "genomic_3prime": ("GENOMIC_3", "GENOMIC3", "GENOMIC_3P", "GENOMIC_3PRIME", "GENOMIC_DOWNSTREAM"),
}


def rule_side(rule: Column) -> Column:
    """The side a rule names, '' if none."""
    said = F.upper(F.trim(F.split_part(rule, F.lit(":"), F.lit(1))))
    side = F.lit("")
    for name, ways in SIDES.items():
        side = F.when(said.isin(*ways), name).otherwise(side)
    return F.when(F.contains(rule, F.lit(":")), side).otherwise("")


def seed_side(rule: Column) -> Column:
    """The spacer end at which the rule's seed lies; genomic sides count as the plain ones."""
    return F.regexp_replace(rule_side(rule), "^genomic_", "")


def with_evaluation(df: DataFrame, rule: Column, flank_5p: str, flank_3p: str, upstream: str, downstream: str, out: str = "pam") -> DataFrame:
    """df with struct(pam_sequence, pam_match, support, score, offset) of a rule over the named flank columns.

    The window next to the protospacer is looked at first, then the nearest one
    further away that fits. match is null where the rule is missing or invalid
    or the flank too short. Steps are columns of their own, so that each is
    computed once.
    """
    columns = df.columns
    classes = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, f"[{v}]")])
    side = rule_side(rule)
    motif = F.regexp_replace(F.upper(F.regexp_replace(rule, "^[^:]*:", "")), r"\s", "")
    steps = df.withColumn("_rule", rule).withColumn("_side", side).withColumn("_motif", motif)
    flanks = {"5prime": flank_5p, "3prime": flank_3p, "genomic_5prime": upstream, "genomic_3prime": downstream}
    flank = reduce(lambda acc, x: F.when(F.col("_side") == x[0], F.col(x[1])).otherwise(acc), flanks.items(), F.lit(""))
    steps = steps.withColumn("_flank", F.upper(flank)).withColumn("_valid", (F.col("_side") != "") & F.col("_motif").rlike(f"^[{''.join(IUPAC)}]+$"))
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(F.split("_motif", ""), lambda c: classes[c]), ""), F.lit("$"))
    steps = steps.withColumn("_pattern", F.when(F.col("_valid"), pattern))
    n, k = F.length("_flank"), F.length("_motif")
    inward = F.col("_side").isin("5prime", "genomic_5prime")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.when(inward, F.col("_flank").substr(n - k - i + 1, k)).otherwise(F.col("_flank").substr(i + 1, k)))
    steps = steps.withColumn("_windows", F.when(F.col("_valid") & (n >= k), windows))
    first = F.get(F.filter(F.transform("_windows", lambda x, i: F.when(F.regexp_like(x, F.col("_pattern")), i)), lambda i: i.isNotNull()), F.lit(0))
    steps = steps.withColumn("_at", first).withColumn("_window", F.get("_windows", F.coalesce("_at", F.lit(0))))
    bases = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    each = F.zip_with(
        F.split("_motif", ""), F.split("_window", ""), lambda m, b: F.when(F.contains(bases[m], b), 1.0).when(m == "N", 0.25).otherwise(0.0)
    )
    score = rounded(F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / k, 6)
    null = F.lit(None)
    looked = F.col("_windows").isNotNull()
    support = (
        F.when(F.coalesce("_rule", F.lit("")) == "", "not_evaluated")
        .when(~F.coalesce("_valid", F.lit(False)), "invalid_rule")
        .when(n < k, "insufficient_flank")
        .when(F.col("_at") == 0, "compatible")
        .when(F.col("_at") > 0, "compatible_nearby")
        .otherwise("not_supported")
    )
    result = F.struct(
        F.when(looked, F.col("_window")).when(F.col("_valid"), F.col("_flank")).otherwise("").alias("pam_sequence"),
        F.when(looked, F.col("_at").isNotNull()).otherwise(null).cast("boolean").alias("pam_match"),
        support.alias("support"),
        F.when(looked, score).alias("score"),
        F.when(looked, F.coalesce("_at", F.lit(0))).cast("int").alias("offset"),
    )
    return steps.withColumn(out, result).select(*columns, out)
