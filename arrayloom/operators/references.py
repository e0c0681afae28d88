"""References to records that do not exist.

References are composite keys in which columns may be null. They are grouped by
their null mask; the registry is laid out once per mask in use, reduced to that
mask's columns, and one anti-join on (mask, non-null columns) leaves the orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def find_orphans(
    references: DataFrame,
    registry: DataFrame,
    keys: dict[str, str],
    match: str = "partial",
    as_of: str | None = None,
    live_from: str | None = None,
    live_until: str | None = None,
) -> DataFrame:
    """Rows of references that no registry row answers, with their columns unchanged.

    keys: reference column -> registry column, compared as they stand (normalise before).
    match, as in SQL's MATCH: with "simple" a reference with any null column is
    exempt; with "full" it must be null in all (exempt) or none, else it is an
    orphan; with "partial" its non-null columns must agree with one registry row.
    A reference that is null in all columns is exempt under each of the three.
    as_of, live_from, live_until: the registry row must hold at the reference's
    time, live_from <= as_of and live_until null or later. A reference without a
    time, and a registry row without live_from, never match.
    Repeated references come out as often as they went in; an empty registry
    makes every checked reference an orphan.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = list(keys)
    full = (1 << len(names)) - 1
    mask = sum((F.col(f"`{n}`").isNotNull().cast("int") * (1 << i) for i, n in enumerate(names)), F.lit(0))
    refs = references.withColumn("_mask", mask).filter("_mask > 0")
    if match == "simple":
        refs = refs.filter(F.col("_mask") == full)
    key = F.array(*[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    refs = refs.withColumn("_key", key)

    broken = refs.filter(F.col("_mask") != full) if match == "full" else None
    if broken is not None:
        refs = refs.filter(F.col("_mask") == full)
    # at most 2^k - 1 values, whatever the number of references
    masks = [full] if match != "partial" else sorted(r[0] for r in refs.select("_mask").distinct().collect())
    rows = registry.select(
        *[F.col(f"`{r}`").cast("string").alias(f"_r{i}") for i, r in enumerate(keys.values())],
        (F.col(f"`{live_from}`") if live_from else F.lit(None).cast("timestamp")).alias("_from"),
        (F.col(f"`{live_until}`") if live_until else F.lit(None).cast("timestamp")).alias("_until"),
    )

    def laid_out(m: int) -> Column:
        inside = [i for i in range(len(names)) if m >> i & 1]
        known = F.lit(True)
        for i in inside:
            known = known & F.col(f"_r{i}").isNotNull()
        parts = F.array(*[F.col(f"_r{i}") if i in inside else F.lit("") for i in range(len(names))])
        return F.when(known, F.struct(F.lit(m).alias("m"), parts.alias("k")))

    if as_of:
        rows = rows.filter("_from is not null")
    if not masks:
        return references.limit(0)
    rows = rows.select(F.explode(F.array(*[laid_out(m) for m in masks])).alias("x"), "_from", "_until").filter("x is not null")
    # of rows that end at the same moment the one that began first answers for all
    rows = rows.groupBy(F.col("x.m").alias("_m"), F.col("x.k").alias("_k"), "_until").agg(F.min("_from").alias("_from"))

    on = (F.col("_mask") == F.col("_m")) & (F.col("_key") == F.col("_k"))
    if as_of:
        at = F.col(f"`{as_of}`")
        on = on & (F.col("_from") <= at) & (F.col("_until").isNull() | (F.col("_until") > at))
    found = refs.join(rows, on, "left_anti")
    return (found if broken is None else found.unionByName(broken)).drop("_mask", "_key")


def cell_values(cell: Column, delimiters: str = ";,|") -> Column:
    """The distinct values of a cell, in order, without blanks and quotes around them; empty pieces are left out."""
    pieces = F.split(cell, f"[{delimiters}]")
    bare = F.transform(pieces, lambda p: F.regexp_replace(p, "^[\\s\"']+|[\\s\"']+$", ""))
    return F.array_distinct(F.filter(bare, lambda p: p != ""))


def last_path_element(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def orphan_counts(orphans: DataFrame, field: str, at: str) -> DataFrame:
    """Orphans per field and month (null where the time is unknown)."""
    month = F.date_format(F.col(at), "yyyy-MM")
    return orphans.groupBy(field, month.alias("month")).agg(F.count("*").alias("orphans"))
