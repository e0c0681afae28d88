"""At most so many records per contributor, the best by score, by radix selection.

Score and identifier are written as order-preserving hexadecimal digits. Rows
are counted per contributor and digit, the digit in which the contributor's
last kept row falls is fixed, and only rows that agree with the digits fixed so
far are counted in the next pass. A comparison with these digits then keeps or
drops each row: no contributor's rows are ever sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.arrays import subtype
from arrayloom.runtime import discard, written

DIGIT = 4  # hexadecimal digits fixed per pass: two bytes


def sortable(steps: str, digits: int) -> Column:
    """A distance from the least value, an SQL expression of type decimal(21), as so many hexadecimal digits in the order of numbers."""
    low = F.lpad(F.hex(F.expr(f"cast(({steps}) % {1 << 32} as bigint)")), 8, "0")
    if digits <= 8:
        return F.right(low, F.lit(digits))
    return F.concat(F.lpad(F.hex(F.expr(f"({steps}) div {1 << 32}")), digits - 8, "0"), low)


def row_cap(counts: DataFrame, max_share: float) -> int:
    """The largest cap k with k <= max_share * (sum of min(rows, k)), from (rows per contributor, contributors).

    0 where there are too few contributors for any to stay within the share.
    """
    histogram = sorted((r[0], r[1]) for r in counts.collect())
    low, high = 0, max((n for n, _ in histogram), default=0)
    while low < high:  # holds for every k up to the largest one that fits, as the right side is concave in k
        k = (low + high + 1) // 2
        if k <= max_share * sum(min(n, k) * m for n, m in histogram) + 1e-9:
            low = k
        else:
            high = k - 1
    return low


def cap_contributors(records: DataFrame, contributor: str, score: str, row_id: str, max_rows: int | None = None, max_share: float | None = None) -> DataFrame:
    """records with at most max_rows rows of each contributor, and none above max_share of what remains.

    Kept are the rows with the highest score, of equal scores those with the
    smallest row id; a null score is below all others. score and row_id are
    whole numbers. Rows without contributor are one contributor of their own.
    Rows repeated with the same score and id are kept or dropped together, and
    dropped if together they would exceed the cap. All columns come out as they
    went in; an empty table stays empty.
    """
    if max_rows is None and max_share is None:
        raise ValueError("give max_rows, max_share or both")
    who = F.coalesce(F.col(f"`{contributor}`").cast("string"), F.lit(""))
    points, own = F.col(f"`{score}`").cast("bigint"), F.col(f"`{row_id}`").cast("bigint")
    slim = written(records.select(who.alias("_who"), points.alias("_score"), own.alias("_id")), "scores")
    sizes = written(slim.groupBy("_who").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{c}") for c in ("_score", "_id") for f in (F.min, F.max)]), "counts")
    ends = sizes.agg(F.min("min_score"), F.max("max_score"), F.min("min_id"), F.max("max_id")).first()
    low_score, high_score, low_id, high_id = (x if x is not None else 0 for x in ends)
    # digits start where scores and ids of these data do: a null score is 0, the least one 1; the smallest id comes first
    wide = (len(f"{high_score - low_score + 1:x}"), len(f"{high_id - low_id:x}"))
    # differences of whole numbers at both ends of 64 bits are decimals, as they need more room than the numbers
    steps = (f"coalesce(cast(_score as decimal(21)) - cast({low_score} as decimal(21)) + 1, cast(0 as decimal(21)))", f"coalesce(cast({high_id} as decimal(21)) - cast(_id as decimal(21)), cast(0 as decimal(21)))")
    digits = [sortable(s, n) for s, n in zip(steps, wide)]
    total = sum(wide)
    cap = max_rows
    if max_share is not None:
        # as many rows as there are different counts: the square root of twice the records at most
        by_share = row_cap(sizes.groupBy("n").agg(F.count("*")), max_share)
        cap = by_share if cap is None else min(cap, by_share)
    # state of a contributor above the cap: digits fixed so far, rows still wanted below them
    state = written(sizes.filter(F.col("n") > cap).select("_who", F.lit("").alias("fixed"), F.lit(cap).cast("bigint").alias("wanted"), F.lit(cap == 0).alias("done"), F.lit(False).alias("all")), "cutoff")
    keys = slim.withColumn("_key", F.concat(*digits))
    for at in range(0, total, DIGIT):
        open_ = state.filter("not done")
        if open_.isEmpty():
            break
        digit = F.substring("_key", at + 1, DIGIT)
        active = keys.join(open_, "_who").filter(F.col("_key").startswith(F.col("fixed")))
        per = active.groupBy("_who", "fixed", "wanted", digit.alias("digit")).agg(F.count("*").alias("n"))
        falling = Window.partitionBy("_who").orderBy(F.desc("digit"))
        before = F.sum("n").over(falling) - F.col("n")
        cut = per.withColumn("before", before).filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("n") >= F.col("wanted")))
        whole = F.col("before") + F.col("n") == F.col("wanted")
        last = at + DIGIT >= total
        moved = cut.select(
            "_who",
            F.concat("fixed", "digit").alias("fixed"),
            (F.col("wanted") - F.col("before")).alias("wanted"),
            (whole | F.lit(last)).alias("done"),
            whole.alias("all"),
        )
        new = written(state.filter("done").unionByName(moved), "cutoff")
        discard(state)
        state = new
    fixed = F.substring(F.col("_key"), F.lit(1), F.length("fixed"))
    kept = F.col("fixed").isNull() | (fixed > F.col("fixed")) | ((fixed == F.col("fixed")) & F.col("all"))
    joined = records.withColumns({"_who": who, "_score": points, "_id": own}).withColumn("_key", F.concat(*digits)).join(state.select("_who", "fixed", "all"), "_who", "left")
    return joined.filter(kept).select(*[F.col(f"`{c}`") for c in records.columns])


def read(arrays: DataFrame) -> DataFrame:
    """The whole records with their subtype read as well; counts below zero count as missing. Times are written out to the second."""
    known = F.when(F.col("spacer_count") >= 0, F.col("spacer_count"))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("called_at", "loaded_at")}
    return arrays.withColumns({"subtype": subtype(F.col("cas_subtype")), "spacer_count": known.cast("bigint"), **times})
