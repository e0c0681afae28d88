"""A sample whose category shares match given targets, with a minimum from small categories.

The categories form a tree: type, subtype, and phylum within the subtype. Quotas
go down the tree; what a node cannot supply passes to its siblings first, then
to its cousins under other parents. Only counts per leaf of the tree reach the
driver: their number is bounded by the target table, whose size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.arrays import rank, subtype
from arrayloom.runtime import written

MAX_CATEGORIES = 10_000
BUCKET_ROWS = 20_000  # rows of one leaf that are ranked together, about
FITTED = 1e-6  # proportional fitting ends when no leaf changes by more than this part of a row
OTHER = ""  # the leaf of rows whose second category is missing or has no target


def _rounded(wanted: dict, total: int, limit: dict) -> dict:
    """Whole numbers near wanted that sum to total or to what limit allows, by largest remainder."""
    low = {k: min(int(v), limit[k]) for k, v in wanted.items()}
    rest = total - sum(low.values())
    while rest > 0:
        room = sorted((k for k in low if low[k] < limit[k]), key=lambda k: (low[k] - wanted[k], str(k)))
        if not room:
            break
        for k in room[:rest]:
            low[k] += 1
        rest = total - sum(low.values())
    return low


def _shared_out(need: int, weights: dict, room: dict) -> dict:
    """need rows over keys in proportion to weights (their room where all weights are 0), none above its room."""
    given = dict.fromkeys(room, 0)
    while need > 0:
        open_ = {k: weights[k] for k in room if given[k] < room[k]}
        if not open_:
            break
        if not any(open_.values()):
            open_ = {k: room[k] - given[k] for k in open_}
        total = sum(open_.values())
        part = _rounded({k: need * w / total for k, w in open_.items()}, need, {k: room[k] - given[k] for k in open_})
        moved = sum(part.values())
        for k, v in part.items():
            given[k] += v
        need -= moved
        if not moved:
            break
    return given


def parent_of(category: str) -> str:
    """The type of a subtype: what stands before its hyphen."""
    return category.split("-")[0]


def allocate(size: int, supply: dict[tuple[str, str], int], first: dict[str, tuple[float, int]], second: dict[str, tuple[float, int]]) -> dict[tuple[str, str], int]:
    """Rows to draw from each leaf (first category, second category).

    first, second: category -> (target share, minimum rows). Quotas of the
    first categories are set top-down: each gets its share, at least its
    minimum, at most its supply; the unmet part goes to siblings of the same
    parent by their targets, then to all others. Within a first category the
    second one's quotas follow from proportional fitting of the leaf counts to
    both sets of targets; what a leaf lacks goes to its siblings there, so the
    first category's share is kept, and rows are then exchanged between leaves
    to reach the second categories' minima.
    """
    have = {c: sum(n for (a, _), n in supply.items() if a == c) for c in first}
    ideal = _rounded({c: size * share for c, (share, _) in first.items()}, size, dict.fromkeys(first, size))
    floor = {c: min(least, have[c]) for c, (_, least) in first.items()}
    quota = {c: max(min(ideal[c], have[c]), floor[c]) for c in first}
    families = [[c for c in first if parent_of(c) == p] for p in sorted({parent_of(c) for c in first})]
    for kin in [*families, list(first)]:  # siblings first, then cousins
        unmet = sum(ideal[c] for c in kin) - sum(quota[c] for c in kin)
        for c, n in _shared_out(max(0, unmet), {c: first[c][0] for c in kin}, {c: have[c] - quota[c] for c in kin}).items():
            quota[c] += n
    above = sum(quota.values()) - size  # minima above their share are paid by the others
    for c, n in _shared_out(max(0, above), {c: first[c][0] for c in first}, {c: quota[c] - floor[c] for c in first}).items():
        quota[c] -= n

    fit = {leaf: float(n) for leaf, n in supply.items() if leaf[0] in first}
    for _ in range(1000):
        before = dict(fit)
        for axis, goal in ((1, {c: size * share for c, (share, _) in second.items()}), (0, quota)):
            sums: dict[str, float] = {}
            for leaf, x in fit.items():
                sums[leaf[axis]] = sums.get(leaf[axis], 0.0) + x
            fit = {leaf: min(float(supply[leaf]), x * goal[leaf[axis]] / sums[leaf[axis]]) if leaf[axis] in goal and sums[leaf[axis]] > 0 else x for leaf, x in fit.items()}
        if all(abs(fit[leaf] - x) <= FITTED for leaf, x in before.items()):
            break
    drawn: dict[tuple[str, str], int] = {}
    for c, n in quota.items():
        leaves = {leaf: x for leaf, x in fit.items() if leaf[0] == c}
        part = _rounded(leaves, n, {leaf: supply[leaf] for leaf in leaves})
        drawn |= part
    for b, (_, least) in second.items():
        mine = [leaf for leaf in drawn if leaf[1] == b]
        short = min(least, sum(supply[leaf] for leaf in mine)) - sum(drawn[leaf] for leaf in mine)
        for leaf in sorted(mine, key=lambda x: drawn[x] - supply[x]):
            for other in sorted((x for x in drawn if x[0] == leaf[0] and x[1] != b), key=lambda x: (x[1] in second, -drawn[x])):
                spare = sum(v for x, v in drawn.items() if x[1] == other[1]) - second.get(other[1], (0, 0))[1]
                moved = max(0, min(short, supply[leaf] - drawn[leaf], drawn[other], spare))
                drawn[leaf] += moved
                drawn[other] -= moved
                short -= moved
    return drawn


def _targets(targets: DataFrame, field: str) -> dict[str, tuple[float, int]]:
    rows = targets.filter(F.col("field_name") == field).select("category", "target_share", "min_rows").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    return {r.category: (float(r.target_share or 0), int(r.min_rows or 0)) for r in rows if r.category is not None}


def _plan(records: DataFrame, row_id: str, first: str, second: str, targets: DataFrame, names: tuple[str, str], fraction: float):
    one, two = _targets(targets, names[0]), _targets(targets, names[1])
    leaf_two = F.when(F.col(f"`{second}`").isin(*two), F.col(f"`{second}`")).otherwise(OTHER) if two else F.lit(OTHER)
    leaf_one = F.when(F.col(f"`{first}`").isin(*one), F.col(f"`{first}`")).otherwise(OTHER) if one else F.lit(OTHER)
    leaves = written(records.select(F.col(f"`{row_id}`").alias("row_id"), leaf_one.alias("first"), leaf_two.alias("second")), "leaves")
    counts = {(r["first"], r["second"]): r["n"] for r in leaves.groupBy("first", "second").agg(F.count("*").alias("n")).collect()}
    size = round(sum(counts.values()) * fraction)
    supply = {(a, b): counts.get((a, b), 0) for a in one for b in [*two, OTHER]}
    return leaves, counts, size, allocate(size, supply, one, two), one, two


def proportional_sample(records: DataFrame, row_id: str, first: str, second: str, targets: DataFrame, names: tuple[str, str], fraction: float, seed: int = 7) -> DataFrame:
    """(row_id, first, second): fraction of all records, drawn to meet the targets of two category columns.

    targets has field_name, category, target_share and min_rows; names are the
    field names of the two columns. Rows whose first category has no target are
    never drawn; rows whose second one has none serve only where the first needs
    them. At a leaf the rows with the smallest permuted rank are drawn; repeated
    rows of one id have one rank and are drawn together. The sample is smaller
    than asked only if all rows with a target are drawn. An empty table gives an
    empty sample.
    """
    leaves, counts, _, drawn, _, _ = _plan(records, row_id, first, second, targets, names, fraction)
    rows = [(a, b, n) for (a, b), n in drawn.items() if n > 0]
    quota = records.sparkSession.createDataFrame(rows, "first string, second string, quota bigint")
    shuffled = F.xxhash64(F.lit(seed), F.col("row_id"))
    # The rank comes in two steps: rows are counted per leaf and hash bucket; buckets that lie wholly below the quota are
    # taken as they are, and only rows of the one in which it ends are ranked.
    buckets = max(64, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    dealt = leaves.withColumn("h", shuffled).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    per = dealt.groupBy("first", "second", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("first", "second").orderBy("bucket"))
    wanted = per.withColumn("before", upto - F.col("n")).join(F.broadcast(quota), ["first", "second"]).filter("before < quota")
    inside = dealt.join(wanted, ["first", "second", "bucket"])
    whole = inside.filter("before + n <= quota")
    place = F.dense_rank().over(Window.partitionBy("first", "second", "bucket").orderBy("h", "row_id"))
    cut = inside.filter("before + n > quota").withColumn("place", place).filter("before + place <= quota")
    return whole.select("row_id", "first", "second").unionByName(cut.select("row_id", "first", "second"))


def missed_targets(records: DataFrame, row_id: str, first: str, second: str, targets: DataFrame, names: tuple[str, str], fraction: float) -> DataFrame:
    """Per field and category: target and drawn rows, shares, supply, and whether share and minimum were met.

    A share counts as met within half a percent of its own rows, or within one row, which is what rounding takes.
    """
    _, counts, size, drawn, one, two = _plan(records, row_id, first, second, targets, names, fraction)
    total = sum(drawn.values())
    rows = []
    for axis, (name, wanted) in enumerate(zip(names, (one, two))):
        for c, (share, least) in sorted(wanted.items()):
            got = sum(n for leaf, n in drawn.items() if leaf[axis] == c)
            have = sum(n for leaf, n in counts.items() if leaf[axis] == c)
            meets = abs(got - share * size) <= max(1.0, 0.005 * share * size)
            rows.append((name, c, share, least, have, got, got / total if total else 0.0, meets, got >= least))
    return records.sparkSession.createDataFrame(
        rows, "field_name string, category string, target_share double, min_rows int, available bigint, drawn bigint, share double, share_met boolean, minimum_met boolean"
    )


def read(arrays: DataFrame) -> DataFrame:
    return arrays.select("row_id", subtype(F.col("cas_subtype")).alias("subtype"), F.initcap(rank(F.col("taxonomy"), 2)).alias("phylum"))
