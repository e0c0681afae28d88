"""One surviving record for each group of duplicate records.

Duplicates are rows that report the same array; groups are the components of
these pairs. Within a group every source claims values field by field. Source
accuracies and the dependence of sources, seen in the false values they share,
are estimated in turns; a vote that was probably copied is discounted, and the
value with the largest posterior survives in each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.arrays import bases, genome_key, same_bases, subtype
from arrayloom.llm.classes import members_of, with_members
from arrayloom.llm.components import components
from arrayloom.llm.overlap import chunks, every_offset
from arrayloom.runtime import written

NEAR = 50
# Buckets of starts with more classes than this are joined on chunks of the repeats as well.
CROWD = 200
FALSE_VALUES = 10  # equally likely wrong values per field
COPY_PRIOR, COPY_RATE = 0.2, 0.8
FIRST_ACCURACY, ROUNDS = 0.8, 3
PATTERN_VALUES = 64  # items of more values are not written as patterns

#: Words that stand for a missing value. Fixed values.
PLACEHOLDERS = ("", "na", "n/a", "nan", "none", "null", "unknown", "ambiguous", "not available", "-", "?", ".")
#: How far a label's confidence is trusted. Fixed values.
TRUST = {"curated": 5, "cas_operon_supported": 4, "high": 3, "medium": 2, "med.": 2, "low": 1}


def _keyed(arrays: DataFrame) -> DataFrame:
    return arrays.select(
        "row_id", genome_key(F.col("genome_id")).alias("genome"), bases(F.col("repeat_sequence")).alias("bases"), F.col("array_start").alias("start")
    ).filter("genome is not null and bases is not null and start is not null")


def _classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("genome", "start", "bases").agg(F.min("row_id").alias("class_id"), F.count("*").alias("n"))


def near_pairs(classes: DataFrame, within: int = NEAR) -> DataFrame:
    """(a, b): pairs of different classes in one genome with the same repeat that start at most so many places apart.

    Starts are laid into buckets one place wider than the distance, so that
    partners are in the same bucket or the next one. Classes in a crowded bucket
    are not compared with all of it but joined on chunks of their repeats too,
    which loses no pair.
    """
    width = within + 1
    placed = classes.select("class_id", "genome", F.floor(F.col("start") / width).alias("own"), "start", "bases")
    crowded = written(placed.groupBy("genome", "own").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("genome", "own"), "crowded")
    if crowded.isEmpty():
        return _checked(_bucket_pairs(placed), within)
    marked = written(placed.join(crowded.withColumn("hot", F.lit(True)), ["genome", "own"], "left").fillna(False, ["hot"]), "marked")
    calm = _bucket_pairs(marked.filter("not hot"))
    beside = crowded.select("genome", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("own")).distinct()
    busy = marked.join(beside, ["genome", "own"], "left_semi")

    def cell(bucket: Column) -> Column:
        return F.concat_ws(":", "genome", bucket.cast("string")).alias("genome")

    left = chunks(busy.select("class_id", cell(F.col("own")), F.col("bases").alias("text"))).select(F.col("class_id").alias("a"), "digest")
    right = busy.select("class_id", "genome", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("own"), "bases")
    right = every_offset(right.select("class_id", cell(F.col("own")), F.col("bases").alias("text"))).select(F.col("class_id").alias("b"), "digest")
    met = left.join(right, "digest").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = busy.select(F.col("class_id").alias("a"), F.col("genome").alias("ga"), F.col("start").alias("sa"), F.col("bases").alias("ba"), F.col("hot").alias("ha"))
    two = busy.select(F.col("class_id").alias("b"), F.col("genome").alias("gb"), F.col("start").alias("sb"), F.col("bases").alias("bb"), F.col("hot").alias("hb"))
    busy_pairs = met.join(one, "a").join(two, "b").filter("ga = gb and (ha or hb)")
    return _checked(calm, within).unionByName(_checked(busy_pairs, within))


def _bucket_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of classes in the same bucket or neighbouring ones, each once, with starts and repeats."""
    left = placed.select(F.col("class_id").alias("a"), "genome", F.col("own").alias("bucket"), F.col("start").alias("sa"), F.col("bases").alias("ba"))
    right = placed.select(F.col("class_id").alias("b"), "genome", "own", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("bucket"), F.col("start").alias("sb"), F.col("bases").alias("bb"))
    return left.join(right, ["genome", "bucket"]).filter((F.col("own") > F.col("bucket")) | (F.col("a") < F.col("b")))


def _checked(pairs: DataFrame, within: int) -> DataFrame:
    return pairs.filter((F.abs(F.col("sa") - F.col("sb")) <= within) & same_bases(F.col("ba"), F.col("bb"))).select("a", "b")


def found(arrays: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: rows that report the same array. Rows without genome, repeat or start match nothing."""
    rows = written(_keyed(arrays), "rows")
    classes = written(_classes(rows), "classes")
    own = classes.filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    pairs = near_pairs(classes).withColumn("own", F.lit(False)).unionByName(own.withColumn("own", F.lit(True)))
    members = members_of(rows, classes, ["genome", "start", "bases"])
    each = with_members(with_members(pairs, "a", members), "b", members).filter("not own or a < b")
    return each.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def groups(arrays: DataFrame) -> DataFrame:
    """(row_id, group_id) of the rows that have a duplicate; group_id is the least row id of the group."""
    rows = written(_keyed(arrays), "rows")
    classes = written(_classes(rows), "classes")
    roots = components(near_pairs(classes).unionByName(classes.filter("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))))
    grouped = classes.join(roots, F.col("class_id") == F.col("vertex")).select("genome", "start", "bases", F.col("root").alias("group_id"))
    return rows.join(grouped, ["genome", "start", "bases"]).select("row_id", "group_id")


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def fuse(records: DataFrame, group: str, source: str, fields: list[str], trust: str, recency: str, rounds: int = ROUNDS) -> DataFrame:
    """(group, field, value, posterior, sources): the value with the largest posterior of every field of every group.

    fields are string columns; null claims nothing, so a field that is null in
    all of a group's rows does not come out. Of equal posteriors the value with
    the highest trust, then the latest, then the first in order wins. A null
    source is one source of its own. Repeated rows of a source claim once.
    The table has a row per source and value, not per record, before anything
    is joined, and rounds run over the different patterns of sources and values,
    so the size of a group does not matter; pairs are formed of sources only.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("c")
    rows = records.select(
        F.col(f"`{group}`").alias("g"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s"), F.col(f"`{trust}`").alias("trust"), F.col(f"`{recency}`").alias("at"), packed
    )
    claims = rows.filter("c.value is not null").groupBy("g", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "s").agg(
        F.max("trust").alias("trust"), F.max("at").alias("at")
    )
    # A source that contradicts itself in a group is counted with a share of a vote for each value.
    item = ["g", "field"]
    claims = written(claims.withColumn("part", 1.0 / F.count("*").over(Window.partitionBy(*item, "s"))), "claims")
    values = claims.groupBy(*item, "value").agg(F.max("trust").alias("trust"), F.max("at").alias("at"), F.sort_array(F.collect_list("s")).alias("by"))
    order = Window.partitionBy(*item).orderBy(F.desc_nulls_last("trust"), F.desc_nulls_last("at"), "value")
    placed = values.withColumn("no", F.row_number().over(order)).withColumn("many", F.count("*").over(Window.partitionBy(*item)))
    # Items with the same sources behind their values, in order, are one pattern: they have the same votes in every round,
    # so rounds run over the few patterns with their multiplicities. An item of very many values is its own pattern.
    said = F.when(F.col("many") <= PATTERN_VALUES, F.concat_ws("\u0001", F.lpad("no", 4, "0"), F.concat_ws("\u0002", "by")))
    items = placed.groupBy(*item).agg(F.sort_array(F.collect_list(said)).alias("p")).withColumn(
        "pattern", F.md5(F.when(F.size("p") > 0, F.concat_ws("\u0003", "p")).otherwise(F.concat_ws("\u0004", F.col("g").cast("string"), "field")))
    )
    keyed = written(placed.drop("many").join(items.select(*item, "pattern"), item), "values")
    first = keyed.groupBy("pattern").agg(F.min(F.struct(*item)).alias("i"), F.count_if(F.col("no") == 1).alias("weight")).select("pattern", "weight", "i.*")
    votes_of = keyed.join(first, ["pattern", *item]).select("pattern", "weight", "no", F.explode("by").alias("s"))
    votes_of = votes_of.withColumn("part", 1.0 / F.count("*").over(Window.partitionBy("pattern", "s")))
    posterior = _rounds(written(votes_of, "patterns"), rounds)
    best = keyed.join(posterior.filter("is_best").select("pattern", "no", "posterior"), ["pattern", "no"])
    return best.select(F.col("g").alias(group), "field", "value", "posterior", F.size("by").cast("bigint").alias("sources"))


def _rounds(votes: DataFrame, rounds: int) -> DataFrame:
    """(pattern, no, posterior, is_best) from votes (pattern, weight, no, s, part), after so many rounds."""
    accuracy = votes.select("s").distinct().withColumn("accuracy", F.lit(FIRST_ACCURACY))
    dependence: DataFrame | None = None
    for no in range(rounds):
        weighted = votes.join(accuracy, "s").withColumn("vote", F.col("part") * F.log(FALSE_VALUES * F.col("accuracy") / (1 - F.col("accuracy"))))
        if dependence is not None:
            # votes count in falling order of accuracy; each is discounted by the chance that it was copied from one before it
            key = ["pattern", "no"]
            ahead = votes.select(*key, F.col("s").alias("s2")).join(dependence, "s2")
            copied = votes.select(*key, "s").join(ahead, [*key, "s"]).groupBy(*key, "s").agg(F.sum(_log(1 - COPY_RATE * F.col("dependent"))).alias("log_own"))
            weighted = weighted.join(copied, [*key, "s"], "left").withColumn("vote", F.col("vote") * F.exp(F.coalesce("log_own", F.lit(0.0))))
        summed = weighted.groupBy("pattern", "no").agg(F.sum("vote").alias("vote"))
        item = Window.partitionBy("pattern")
        top = F.max("vote").over(item)
        unseen = F.greatest(F.lit(FALSE_VALUES + 1) - F.count("*").over(item), F.lit(0)) * F.exp(-top)
        new = summed.withColumn("posterior", F.exp(F.col("vote") - top) / (F.sum(F.exp(F.col("vote") - top)).over(item) + unseen))
        posterior = written(new.withColumn("is_best", F.row_number().over(item.orderBy(F.desc("posterior"), "no")) == 1), "posterior")
        if no == rounds - 1:
            break
        judged = votes.join(posterior.select("pattern", "no", "posterior", "is_best"), ["pattern", "no"])
        counted = F.col("part") * F.col("weight")
        accuracy = written(judged.groupBy("s").agg(F.least(F.greatest(F.sum(F.col("posterior") * counted) / F.sum(counted), F.lit(0.05)), F.lit(0.99)).alias("accuracy")), "accuracy")
        dependence = written(_dependence(judged, accuracy), "dependence")
    return posterior


def _dependence(judged: DataFrame, accuracy: DataFrame) -> DataFrame:
    """(s, s2, dependent): how likely s, the less accurate of two sources, depends on s2, from the true and false values they share.

    Values in common are counted over the sources of each value, values apart as
    all pairs of two sources' values, from their numbers, less those in common.
    """
    other = judged.select("pattern", "no", F.col("s").alias("s2"))
    shared = judged.join(other, ["pattern", "no"]).filter("s <> s2").groupBy("s", "s2").agg(F.sum(F.when(F.col("is_best"), F.col("weight")).otherwise(0)).alias("kt"), F.sum(F.when(~F.col("is_best"), F.col("weight")).otherwise(0)).alias("kf"))
    sizes = judged.groupBy("pattern", "weight", "s").agg(F.count("*").alias("n"))
    pairs = sizes.join(sizes.select("pattern", F.col("s").alias("s2"), F.col("n").alias("n2")), "pattern").filter("s <> s2").groupBy("s", "s2").agg(F.sum(F.col("n") * F.col("n2") * F.col("weight")).alias("all"))
    met = pairs.join(shared, ["s", "s2"], "left").fillna(0, ["kt", "kf"]).withColumn("kd", F.col("all") - F.col("kt") - F.col("kf"))
    rated = met.join(accuracy.withColumnRenamed("accuracy", "x"), "s").join(accuracy.select(F.col("s").alias("s2"), F.col("accuracy").alias("y")), "s2")
    rated = rated.filter((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("s") > F.col("s2"))))
    x, y, c = F.col("x"), F.col("y"), COPY_RATE
    pt, pf = x * y, (1 - x) * (1 - y) / FALSE_VALUES
    pd = 1 - pt - pf
    against = (
        F.col("kt") * (_log(pt) - _log(y * c + pt * (1 - c)))
        + F.col("kf") * (_log(pf) - _log((1 - y) * c + pf * (1 - c)))
        + F.col("kd") * (_log(pd) - _log(pd * (1 - c)))
    )
    odds = F.log(F.lit((1 - COPY_PRIOR) / COPY_PRIOR)) + against
    return rated.select("s", "s2", (1 / (1 + F.exp(F.least(odds, F.lit(500.0))))).alias("dependent"))


#: Fields of an array record that are chosen one by one.
FIELDS = ("organism", "taxonomy", "assembly_level", "contig_id", "array_start", "array_end", "repeat_sequence", "spacer_count", "mean_spacer_length", "cas_type", "cas_subtype", "label_source", "label_confidence", "pam_rule")


def readable(arrays: DataFrame) -> DataFrame:
    """The records with placeholder words and impossible numbers as null, and writings of one value made equal."""

    def said(c: str) -> Column:
        plain = F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))
        return F.when(~F.lower(plain).isin(*PLACEHOLDERS), plain)

    confidence = F.lower(said("label_confidence"))
    strand = bases(F.col("repeat_sequence"))
    return arrays.select(
        "row_id",
        said("source").alias("source"),
        said("organism").alias("organism"),
        F.array_join(F.filter(F.transform(F.split(said("taxonomy"), "[;|,>]"), lambda r: F.regexp_replace(F.trim(r), "^[a-z]__", "")), lambda r: r != ""), ";").alias("taxonomy"),
        F.lower(said("assembly_level")).alias("assembly_level"),
        said("contig_id").alias("contig_id"),
        F.when(F.col("array_start") >= 0, F.col("array_start")).cast("string").alias("array_start"),
        F.when(F.col("array_end") > F.coalesce("array_start", F.lit(0)), F.col("array_end")).cast("string").alias("array_end"),
        F.least(strand, F.reverse(F.translate(strand, "ACGTN", "TGCAN"))).alias("repeat_sequence"),
        F.when(F.col("spacer_count") > 0, F.col("spacer_count")).cast("string").alias("spacer_count"),
        F.when(F.col("mean_spacer_length") > 0, F.col("mean_spacer_length")).cast("string").alias("mean_spacer_length"),
        said("cas_type").alias("cas_type"),
        subtype(F.col("cas_subtype")).alias("cas_subtype"),
        F.lower(said("label_source")).alias("label_source"),
        F.when(confidence == "med.", "medium").otherwise(confidence).alias("label_confidence"),
        F.upper(said("pam_rule")).alias("pam_rule"),
        F.coalesce(*[F.when(confidence == k, F.lit(v)) for k, v in TRUST.items()], F.expr("try_cast(label_confidence as double) * 3").cast("int"), F.lit(0)).alias("trust"),
        "called_at",
    )


def surviving_records(arrays: DataFrame) -> DataFrame:
    """One row per group of duplicates and per row without duplicate: group_id, records, every field, and the least posterior among them."""
    read = readable(arrays).withColumn("taxonomy", F.when(F.col("taxonomy") != "", F.col("taxonomy")))
    placed = written(read.join(groups(arrays), "row_id", "left"), "placed")
    grouped = placed.filter("group_id is not null")
    chosen = fuse(grouped, "group_id", "source", list(FIELDS), "trust", "called_at")
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("records"))
    # one value per field, so a group's map stays as small as the list of fields
    wide = chosen.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("values"), F.min("posterior").alias("least_posterior"))
    fused = sizes.join(wide, "group_id", "left").select("group_id", "records", *[F.col("values")[f].alias(f) for f in FIELDS], "least_posterior")
    alone = placed.filter("group_id is null").select(
        F.col("row_id").alias("group_id"), F.lit(1).cast("bigint").alias("records"), *FIELDS, F.lit(None).cast("double").alias("least_posterior")
    )
    return fused.unionByName(alone)
