"""Same or near-same records across splits, by content-defined chunks.

Training records are cut into chunks at places that a rolling hash of the content
chooses; records of the other splits are hashed at every offset, as an edit may
move their own cuts. Equal digests within a genome give the candidate pairs, and
the lengths of the whole chunks that both share are summed into the fraction of
the training record that is found elsewhere.

Completeness: a record of length L is cut into edits + 1 chunks of which each is
at least width(L) long, and the first width(L) bases of a chunk are digested. Two
edits leave one chunk untouched, and its digest is among the other record's, as
that is hashed at every offset for every width a record within two bases of its
length may have. So no pair within the edit limit is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.arrays import MAX_EDITS, bases, genome_key, other_strand, same_bases
from arrayloom.llm.classes import members_of, with_members
from arrayloom.runtime import written

# (least length, digested bases): three of them always fit into the length.
WIDTHS = ((384, 128), (96, 32), (34, 11), (24, 8), (18, 6), (9, 3), (3, 1), (0, 0))


def _width(length: Column) -> Column:
    chosen = F.lit(0)
    for least, width in reversed(WIDTHS):
        chosen = F.when(length >= least, width).otherwise(chosen)
    return chosen


def _digest(genome: Column, text: Column, at: Column, width: Column) -> Column:
    return F.xxhash64(genome, width, text.substr(at + 1, width))


def _cuts(text: Column, width: Column) -> list[Column]:
    """Where the three chunks begin: each at the least rolling hash among the places that leave room for the rest."""
    slack = F.length(text) - 3 * width

    def least(low: Column, high: Column) -> Column:
        hashed = F.transform(F.sequence(low, high), lambda i: F.struct(F.xxhash64(text.substr(i + 1, F.lit(4))).alias("h"), i.alias("i")))
        return F.array_min(hashed)["i"]

    return least, slack


def _cut(records: DataFrame) -> DataFrame:
    """Both strands of records (class_id, genome, text) with the digests' width w and where their three chunks begin: 0, b and c."""
    strands = records.select("class_id", "genome", F.explode(F.array("text", other_strand(F.col("text")))).alias("text")).withColumn("w", _width(F.length("text")))
    w = F.col("w")
    least, slack = _cuts(F.col("text"), w)
    cut = strands.withColumn("b", least(w, slack + w))
    return cut.withColumn("c", least(F.col("b") + w, slack + 2 * w))


def chunks(records: DataFrame) -> DataFrame:
    """(class_id, digest) of the three chunks of both strands of records (class_id, genome, text)."""
    digests = [_digest(F.col("genome"), F.col("text"), at, F.col("w")) for at in (F.lit(0), F.col("b"), F.col("c"))]
    return _cut(records).select("class_id", F.explode(F.array(*digests)).alias("digest"))


def pieces(records: DataFrame) -> DataFrame:
    """records (class_id, genome, text) with strands: the texts of the three whole chunks, for each strand."""
    text, n = F.col("text"), F.length("text")
    parts = F.array(F.left(text, F.col("b")), text.substr(F.col("b") + 1, F.col("c") - F.col("b")), text.substr(F.col("c") + 1, n))
    cut = _cut(records).groupBy("class_id").agg(F.collect_list(parts).alias("strands"))
    return records.select("class_id", "genome", "text").join(cut, "class_id")


def every_offset(records: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(class_id, digest) of records at every offset, for every width that a record within so many edits has."""
    n = F.length("text")
    widths = F.array_distinct(F.transform(F.sequence(F.greatest(n - edits, F.lit(0)), n + edits), lambda i: _width(i)))
    each = records.select("class_id", "genome", "text", F.explode(widths).alias("w")).filter(F.col("w") <= n)
    w, text = F.col("w"), F.col("text")
    last = F.when(w == 0, 0).otherwise(n - w)
    digests = F.transform(F.sequence(F.lit(0), last), lambda i: _digest(F.col("genome"), text, i, w))
    return each.select("class_id", F.explode(F.array_distinct(digests)).alias("digest"))


def _compared(records: DataFrame, text: str, group: str, split: str, row_id: str, train: str, others: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that take part, their classes of equal ones, and (t, o, overlap) of near classes of training and other splits."""
    rows = records.select(
        F.col(f"`{row_id}`").alias("row_id"),
        F.col(f"`{group}`").alias("genome"),
        F.col(f"`{text}`").alias("text"),
        F.when(F.col(f"`{split}`") == train, "t").when(F.col(f"`{split}`").isin(*others), "o").alias("side"),
    ).filter("genome is not null and text <> '' and side is not null")
    rows = written(rows, "rows")
    classes = written(rows.groupBy("side", "genome", "text").agg(F.min("row_id").alias("class_id"), F.count("*").alias("n")), "classes")
    trained = classes.filter("side = 't'")
    other = classes.filter("side = 'o'")
    met = chunks(trained).select(F.col("class_id").alias("t"), "digest").join(every_offset(other).withColumnRenamed("class_id", "o"), "digest")
    candidates = met.select("t", "o").distinct()
    whole = pieces(trained).select(F.col("class_id").alias("t"), F.col("genome").alias("ga"), F.col("text").alias("ta"), "strands")
    found = F.transform("strands", lambda cut: F.aggregate(cut, F.lit(0), lambda n, piece: n + F.when(F.contains(F.col("ob"), piece), F.length(piece)).otherwise(0)))
    checked = (
        candidates.join(whole, "t")
        .join(other.select(F.col("class_id").alias("o"), F.col("text").alias("ob"), F.col("genome").alias("gb")), "o")
        .filter((F.col("ga") == F.col("gb")) & same_bases(F.col("ta"), F.col("ob")))
        .select("t", "o", (F.array_max(found) / F.length("ta")).alias("overlap"))
    )
    return rows, classes, checked


def cross_split_overlaps(records: DataFrame, text: str, group: str, split: str, row_id: str, train: str = "train", others: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Pairs of a training row and a row of another split that are at most two edits apart: train_row, other_row, overlap.

    overlap is the part of the training record's length in whole chunks that the
    other record shares (the better strand's). Rows without split, group or text
    (null or empty) take no part; rows with equal group and text are compared
    once and expanded at the end. Column names of the input other than the named
    ones are ignored. An empty table gives no pairs.
    """
    rows, classes, checked = _compared(records, text, group, split, row_id, train, others)
    members = members_of(rows, classes, ["side", "genome", "text"])
    return with_members(with_members(checked, "t", members), "o", members).select(F.col("t").alias("train_row"), F.col("o").alias("other_row"), "overlap")


def record_overlaps(records: DataFrame, text: str, group: str, split: str, row_id: str, train: str = "train", others: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(row_id, pairs, overlap) of each row of the other splits that a training row is near: its training rows, and the largest overlap with one.

    Pairs are counted from the sizes of classes of equal rows, without making them.
    """
    rows, classes, checked = _compared(records, text, group, split, row_id, train, others)
    per = checked.join(classes.select(F.col("class_id").alias("t"), "n"), "t").groupBy("o").agg(F.sum("n").alias("pairs"), F.max("overlap").alias("overlap"))
    keys = ["side", "genome", "text"]
    placed = classes.select(*keys, F.col("class_id").alias("o")).join(per, "o").drop("o")
    return rows.join(placed, keys).select("row_id", "pairs", "overlap")


def array_overlaps(arrays: DataFrame) -> DataFrame:
    read = arrays.select("row_id", "split", genome_key(F.col("genome_id")).alias("genome"), bases(F.col("repeat_sequence")).alias("bases"))
    return cross_split_overlaps(read, "bases", "genome", "split", "row_id")


def found(arrays: DataFrame) -> DataFrame:
    pairs = array_overlaps(arrays)
    return pairs.select(F.least("train_row", "other_row").alias("row_id_a"), F.greatest("train_row", "other_row").alias("row_id_b"))


def overlaps_of_records(arrays: DataFrame) -> DataFrame:
    read = arrays.select("row_id", "split", genome_key(F.col("genome_id")).alias("genome"), bases(F.col("repeat_sequence")).alias("bases"))
    return record_overlaps(read, "bases", "genome", "split", "row_id")


def by_split_and_source(arrays: DataFrame) -> DataFrame:
    """Per split and source of the held-out row: its rows, those with a training twin, and the pairs."""
    held = arrays.filter(F.col("split").isin("validation", "test")).select("row_id", "split", "source")
    return held.join(overlaps_of_records(arrays), "row_id", "left").groupBy("split", "source").agg(
        F.count("*").alias("rows"), F.count("pairs").alias("rows_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )
