"""Tables of labelled repeats: checks, conflicts, novelty, balance, audits, holdouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.dna import rounded

#: Words that mark a subtype as undecided. Fixed values.
AMBIGUOUS = ("", "ambiguous", "hybrid", "na", "nan", "none", "unknown")
TRUSTED = ("high", "curated", "cas_operon_supported")


def cas_type(subtype: Column) -> Column:
    """Type of a subtype such as II-A; Unknown without a roman numeral and hyphen."""
    numeral = F.regexp_extract(F.upper(F.trim(subtype)), "^(I|II|III|IV|V|VI)-", 1)
    return F.when(numeral != "", F.concat(F.lit("Type "), numeral)).otherwise("Unknown")


def is_ambiguous(subtype: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(subtype, F.lit(""))))
    return said.isin(*AMBIGUOUS) | F.contains(said, F.lit("/")) | F.contains(said, F.lit(","))


def is_usable(repeat: Column, shortest: int = 23, longest: int = 47) -> Column:
    return F.coalesce(repeat.rlike(f"^[ACGTN]{{{shortest},{longest}}}$"), F.lit(False))


def is_trusted(confidence: Column) -> Column:
    return F.coalesce(F.lower(F.trim(confidence)).isin(*TRUSTED), F.lit(False))


def repeat_issues(table: DataFrame) -> DataFrame:
    """(row_id, issue): what is wrong with rows of a training table; a row comes out once per issue."""
    repeat = F.upper(F.coalesce("repeat_sequence", F.lit("")))
    checks = {
        "repeat_sequence holds other letters than ACGTN": ~repeat.rlike("^[ACGTN]+$"),
        "repeat_length differs from the sequence": F.coalesce(F.col("repeat_length") != F.length(repeat), F.lit(True)),
        "spacer_count is missing or negative": F.coalesce(F.col("spacer_count") < 0, F.lit(True)),
        "cas_type is empty": F.trim(F.coalesce("cas_type", F.lit(""))) == "",
        "cas_subtype is empty": F.trim(F.coalesce("cas_subtype", F.lit(""))) == "",
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return table.select("row_id", F.explode(found).alias("issue"))


def value_issues(table: DataFrame, row: str, key: str, required: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(row, issue): empty required cells, repeated keys, values outside a list; null counts as empty."""
    read = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in {key, *required, *allowed}}
    again = F.row_number().over(Window.partitionBy(read[key]).orderBy(row))
    checks = [F.when(read[key] == "", F.lit(f"{key} is empty")), F.when((read[key] != "") & (F.col("_again") > 1), F.lit(f"{key} is repeated"))]
    checks += [F.when(read[c] == "", F.lit(f"{c} is empty")) for c in required if c != key]
    checks += [F.when(~read[c].isin(*values), F.concat(F.lit(f"{c} is not allowed: "), read[c])) for c, values in allowed.items()]
    return table.withColumn("_again", again).select(row, F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def with_hash(table: DataFrame) -> DataFrame:
    return table.withColumn("repeat_hash", F.sha2(F.upper(F.trim("repeat_sequence")), 256))


def conflicts(table: DataFrame, order: str) -> DataFrame:
    """Repeats with several subtypes: repeat_hash, subtypes in order, row_count, and the first row's sequence."""
    per = table.groupBy("repeat_hash").agg(
        F.array_join(F.array_sort(F.collect_set("cas_subtype")), ";").alias("subtypes"),
        F.countDistinct("cas_subtype").alias("n"),
        F.count("*").alias("row_count"),
        F.min_by("repeat_sequence", order).alias("example_repeat_sequence"),
    )
    return per.filter("n > 1").drop("n")


def novel(candidates: DataFrame, current: DataFrame, order: str) -> DataFrame:
    """Candidates whose repeat neither conflicts among the candidates nor is known already."""
    clean = candidates.join(conflicts(candidates, order).select("repeat_hash"), "repeat_hash", "left_anti")
    return clean.join(current.select("repeat_hash").distinct(), "repeat_hash", "left_anti")


def balanced(table: DataFrame, most: int) -> DataFrame:
    """The first rows of each subtype by spacers (most first), genome and repeat; all rows if most is not positive."""
    if most <= 0:
        return table
    order = Window.partitionBy("cas_subtype").orderBy(F.desc("spacer_count"), "genome_id", "repeat_sequence", "row_id")
    return table.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= most).drop("_no")


def audit_summary(current: DataFrame, candidates: DataFrame, most: int, order: str) -> DataFrame:
    """(metric, value) about candidates beside the current table."""
    new = novel(candidates, current, order)
    clashing = conflicts(candidates, order).select("repeat_hash")
    both = current.select("repeat_hash").intersect(candidates.select("repeat_hash"))

    def one(metric: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "value")

    parts = [
        one("current_rows", current),
        one("candidate_rows", candidates),
        one("current_unique_repeat_hashes", current.select("repeat_hash").distinct()),
        one("candidate_unique_repeat_hashes", candidates.select("repeat_hash").distinct()),
        one("overlapping_repeat_hashes", both),
        one("candidate_conflicting_repeat_hashes", clashing),
        one("candidate_rows_after_conflict_filter", candidates.join(clashing, "repeat_hash", "left_anti")),
        one("novel_nonconflicting_candidate_rows", new),
        one("balanced_candidate_rows", balanced(new, most)),
    ]
    return reduce(DataFrame.unionByName, parts)


def subtype_delta(current: DataFrame, candidates: DataFrame, most: int, order: str) -> DataFrame:
    """Rows per subtype in the current table, the candidates, the novel ones and their balanced part."""
    new = novel(candidates, current, order)
    tagged = [("current", current), ("candidate", candidates), ("novel_nonconflicting", new), ("balanced_candidate", balanced(new, most))]
    rows = reduce(DataFrame.unionByName, [df.select("cas_subtype", F.lit(tag).alias("tag")) for tag, df in tagged])
    return rows.groupBy("cas_subtype").agg(*[F.count_if(F.col("tag") == tag).alias(f"{tag}_count") for tag, _ in tagged])


def frequent_classes(table: DataFrame, column: str, least: int) -> DataFrame:
    """Rows of classes with at least so many rows."""
    if least <= 1:
        return table
    sizes = table.groupBy(column).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(column)
    return table.join(sizes, column, "left_semi")


def group_holdout(table: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """(group, rows, held_out): groups in the order of a digest are held out until share of all rows is reached.

    The group with which the target is crossed is held out too. Sums run over
    the 4,096 values of a digest's first digits, and within these over groups.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("grp").cast("string"), F.lit(""))))
    sizes = table.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("rows")).withColumn("_d", digest).withColumn("_b", F.left("_d", F.lit(3)))
    per = sizes.groupBy("_b").agg(F.sum("rows").alias("_n"))
    ahead = per.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    before = F.col("_ahead") + F.sum("rows").over(Window.partitionBy("_b").orderBy("_d", "grp")) - F.col("rows")
    return sizes.join(ahead, "_b").withColumn("held_out", before < F.rint(F.col("_all") * share)).select("grp", "rows", "held_out")


def collapse_spacers(rows: DataFrame, keys: list[str], spacer: str, length: str, least: int = 2) -> DataFrame:
    """Spacer-level rows to one row per keys with distinct spacers and their mean length; nulls are keys of their own."""
    per = rows.groupBy(*keys).agg(F.countDistinct(spacer).alias("spacer_count"), rounded(F.avg(length), 6).alias("mean_spacer_length"))
    return per.filter(F.col("spacer_count") >= least)
