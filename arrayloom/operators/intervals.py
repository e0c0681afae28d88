"""Joins of intervals on one sequence, by bins instead of pairs of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 20_000


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The gap between two intervals, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def _near(left: DataFrame, right: DataFrame, on: str, reach: int, bin_width: int) -> DataFrame:
    """Pairs whose intervals (start, end) are at most reach apart; each pair once, in the first bin that both cover."""
    low, high = F.floor((F.col("start") - reach) / bin_width), F.floor((F.col("end") + reach) / bin_width)
    a = left.select(F.struct("*").alias("a"), F.col(on).alias("k"), low.alias("a0"), F.explode(F.sequence(low, high)).alias("bin"))
    low_b, high_b = F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width)
    b = right.select(F.struct("*").alias("b"), F.col(on).alias("k"), low_b.alias("b0"), F.explode(F.sequence(low_b, high_b)).alias("bin"))
    pairs = a.join(b, ["k", "bin"]).filter(F.col("bin") == F.greatest("a0", "b0"))
    gap = distance(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    return pairs.withColumn("distance", gap).filter(F.col("distance") <= reach).select("a", "b", "distance")


def overlapping(left: DataFrame, right: DataFrame, on: str, bin_width: int = BIN) -> DataFrame:
    """(a, b): pairs of rows with equal on whose closed intervals overlap. Null places match nothing."""
    known = "start is not null and end is not null and start <= end"
    return _near(left.filter(known), right.filter(known), on, 0, bin_width).select("a", "b")


def nearest(left: DataFrame, right: DataFrame, on: str, left_id: str, order: str, reach: int = BIN) -> DataFrame:
    """(a, b, distance): for each left row the nearest right row at most reach away; of equally near ones the first by order."""
    known = "start is not null and end is not null and start <= end"
    pairs = _near(left.filter(known), right.filter(known), on, reach, max(BIN, reach))
    first = Window.partitionBy(F.col(f"a.{left_id}")).orderBy("distance", F.col(f"b.{order}"))
    return pairs.withColumn("no", F.row_number().over(first)).filter("no = 1").drop("no")
