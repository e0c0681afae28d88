"""Train, validation and test splits in which all bound records fall together.

Components come from hooking and shortcutting over parent tables. The number of
components of each category and size is then a small histogram, and subset-sum
bitsets over the sizes and their multiplicities choose how many components of
each size go to each split, so that the split totals come closest to the given
shares and categories are spread alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.arrays import genome_key, rank, subtype
from arrayloom.llm.components import components
from arrayloom.runtime import written

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
# Totals are counted in units of total / UNITS rows: the bitsets stay about this long at any number of rows, and a second
# one, in rows, closes the remainder.
UNITS = 200_000
LARGE = 1000  # components above this part of all rows are placed one by one


def bound_groups(records: DataFrame, row_id: str, bonds: list[str]) -> DataFrame:
    """(row_id, group_row_id): the least row id of all rows bound to a row through equal values, directly or over other rows.

    Rows are bound by an equal non-null value in one of the bond columns. Rows
    with equal values in all of them are one vertex; each value ties its
    vertices to the least among them. A row without any value is its own group.
    """
    rows = records.select(F.col(f"`{row_id}`").alias("row_id"), *[F.col(f"`{b}`").cast("string").alias(f"_b{i}") for i, b in enumerate(bonds)])
    names = [f"_b{i}" for i in range(len(bonds))]
    known = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    keyed = rows.filter(known).select("row_id", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names], F.array(*[F.col(n).isNotNull() for n in names]).alias("_has"))
    vertices = keyed.groupBy("_has", *names).agg(F.min("row_id").alias("v"))
    values = F.explode(F.array(*[F.when(F.col("_has")[i], F.struct(F.lit(i).alias("i"), F.col(n).alias("x"))) for i, n in enumerate(names)]))
    tied = vertices.select("v", values.alias("value")).filter("value is not null").select("v", F.col("value.i").alias("i"), F.col("value.x").alias("x"))
    least = tied.groupBy("i", "x").agg(F.min("v").alias("m"))
    roots = components(tied.join(least, ["i", "x"]).select(F.col("v").alias("a"), F.col("m").alias("b")))
    placed = vertices.join(roots, F.col("v") == F.col("vertex")).select("_has", *names, F.col("root").alias("group_row_id"))
    single = rows.filter(~known).select("row_id", F.col("row_id").alias("group_row_id"))
    return keyed.join(placed, ["_has", *names]).select("row_id", "group_row_id").unionByName(single)


def choose_counts(sizes: list[tuple[int, int]], targets: dict[str, float], unit: int = 1) -> dict[str, dict[int, int]]:
    """For each split but the largest, how many components of each size it takes.

    sizes: (size, number of components). The splits choose in turn, smallest
    target first, from what is left. For every size its multiplicity is broken
    into powers of two; a bitset holds which totals can be reached after each of
    these items, and walking back from the total closest to the target gives the
    counts. With a unit above one row, totals of most components are counted in
    units and some of the smallest are held back; a second bitset over these, in
    rows, closes what rounding left. The largest split takes the rest.
    """
    left = dict(sizes)
    order = sorted(targets, key=lambda s: (targets[s], s))
    chosen: dict[str, dict[int, int]] = {}
    for split in order[:-1]:
        back = _held_back(left, unit) if unit > 1 else {}
        spare = sum(s * n for s, n in back.items())
        first = _closest({s: n - back.get(s, 0) for s, n in left.items()}, max(0.0, targets[split] - spare / 2), unit)
        short = targets[split] - sum(s * n for s, n in first.items())
        second = _closest(back, short, 1) if back and short > 0 else {}
        chosen[split] = {s: first.get(s, 0) + second.get(s, 0) for s in {*first, *second}}
        for size, n in chosen[split].items():
            left[size] -= n
    return chosen


def _held_back(left: dict[int, int], unit: int) -> dict[int, int]:
    """The smallest components, as many as rounding to units may be off over all items."""
    items = sum(n.bit_length() for n in left.values())
    wanted, back = 2 * unit * items, {}
    for size, n in sorted(left.items()):
        if wanted <= 0:
            break
        back[size] = min(n, -(-wanted // size))
        wanted -= size * back[size]
    return back


def _closest(left: dict[int, int], target: float, unit: int) -> dict[int, int]:
    """How many components of each size to take so that their total, in units, comes closest to the target."""
    goal = target / unit
    bound = int(goal * 2) + max((s for s, n in left.items() if n), default=0) // unit + 1
    items: list[tuple[int, int, int]] = []
    for size, many in sorted(left.items()):
        step = 1
        while many > 0:
            take = min(step, many)
            weight = round(size * take / unit)
            if weight <= bound:
                items.append((weight, size, take))
            many, step = many - take, step * 2
    keep = (1 << (bound + 1)) - 1
    reach = [1]
    for weight, _, _ in items:
        reach.append((reach[-1] | reach[-1] << weight) & keep)
    at = round(goal)
    total = next((t for d in range(bound + 1) for t in (at - d, at + d) if 0 <= t <= bound and reach[-1] >> t & 1), 0)
    counts: dict[int, int] = {}
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            weight, size, take = items[k - 1]
            counts[size] = counts.get(size, 0) + take
            total -= weight
    return counts


def place_large(large: dict[int, dict[str, int]], wanted: dict[str, dict[str, float]]) -> dict[int, str]:
    """A split for each large component (group -> rows per category), the largest first, such that splits come near wanted (split -> category -> rows).

    Each goes where it leaves the least sum of squared distances, every category
    measured against what it is to hold there.
    """
    has = {split: dict.fromkeys(goal, 0) for split, goal in wanted.items()}
    out: dict[int, str] = {}

    def grows(split: str, rows: dict[str, int]) -> float:
        # the total counts like a category, so that a split isn't filled by components of rare categories
        per = [((has[split].get(c, 0) + n - wanted[split].get(c, 0.0)) ** 2 - (has[split].get(c, 0) - wanted[split].get(c, 0.0)) ** 2) / max(wanted[split].get(c, 0.0), 1.0) for c, n in rows.items()]
        goal, own, more = sum(wanted[split].values()), sum(has[split].values()), sum(rows.values())
        return sum(per) + ((own + more - goal) ** 2 - (own - goal) ** 2) / max(goal, 1.0)

    for group, rows in sorted(large.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        split = min(wanted, key=lambda s: (grows(s, rows), s))
        out[group] = split
        for c, n in rows.items():
            has[split][c] = has[split].get(c, 0) + n
    return out


def grouped_splits(records: DataFrame, row_id: str, bonds: list[str], balance: str, shares: dict[str, float] | None = None) -> DataFrame:
    """(row_id, group_row_id, split) such that bound rows share a split, the totals come closest to shares, and categories are spread alike.

    balance: the category. Components above a thousandth of all rows, of which
    there are a thousand at most, are placed one by one by their rows per
    category. Smaller ones are chosen category by category (the commonest one of
    each), rarest first: subset-sum bitsets over their sizes bring each category
    closest to its part of every split, and the commonest category brings the
    totals closest. A component larger than a split's share goes to a split that
    holds it, so shares can be missed where the bonds leave no choice; compare
    with split_report. Null categories are a category of their own. Categories
    are expected to be few, as their counts are collected.
    """
    shares = shares or SHARES
    groups = written(bound_groups(records, row_id, bonds), "groups")
    category = records.select(F.col(f"`{row_id}`").alias("row_id"), F.coalesce(F.col(f"`{balance}`"), F.lit("")).alias("category"))
    per = written(groups.join(category, "row_id").groupBy("group_row_id", "category").agg(F.count("*").alias("n")), "per")
    comps = per.groupBy("group_row_id").agg(F.sum("n").alias("size"), F.max_by("category", F.struct("n", "category")).alias("category"))
    totals = {r["category"]: r["n"] for r in per.groupBy("category").agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())
    least = total // LARGE + 1
    large: dict[int, dict[str, int]] = {}
    for r in per.join(comps.filter(F.col("size") >= least).select("group_row_id"), "group_row_id", "left_semi").collect():
        large.setdefault(r["group_row_id"], {})[r["category"]] = r["n"]
    wanted = {s: {c: share * n for c, n in totals.items()} for s, share in shares.items()}
    placed = place_large(large, wanted)
    # distinct sizes grow as the square root of the rows, so the histograms are small
    small = comps.filter(F.col("size") < least)
    histogram: dict[str, list[tuple[int, int]]] = {}
    for r in small.groupBy("category", "size").agg(F.count("*").alias("many")).collect():
        histogram.setdefault(r["category"], []).append((r["size"], r["many"]))
    got = {s: dict.fromkeys(totals, 0.0) for s in shares}
    for group, split in placed.items():
        for c, n in large[group].items():
            got[split][c] += n
    biggest = max(shares, key=lambda s: (shares[s], s))
    rows: list[tuple[str, int, str, int]] = []
    order = sorted(histogram, key=lambda c: (sum(s * m for s, m in histogram[c]), c))
    for c in order:
        have = sum(s * m for s, m in histogram[c])
        if c == order[-1]:
            goals = {s: max(0.0, share * total - sum(got[s].values())) for s, share in shares.items()}
        else:
            goals = {s: max(0.0, wanted[s][c] - got[s][c]) for s in shares}
        # what is over or short of all goals falls to the largest split
        goals[biggest] = max(0.0, have - sum(v for s, v in goals.items() if s != biggest))
        chosen = choose_counts(histogram[c], {**goals, biggest: max(goals[biggest], *goals.values()) + 1}, max(1, -(-have // UNITS)))
        for split, counts in chosen.items():
            got[split][c] += sum(s * n for s, n in counts.items())
            rows += [(c, size, split, n) for size, n in counts.items() if n > 0]
        got[biggest][c] += have - sum(s * n for counts in chosen.values() for s, n in counts.items())
    spark = records.sparkSession
    quota = spark.createDataFrame(rows, "category string, size bigint, split string, quota bigint")
    one_by_one = spark.createDataFrame(list(placed.items()), "group_row_id bigint, split string")
    assigned = _assigned(small, quota, biggest).unionByName(one_by_one)
    return groups.join(assigned, "group_row_id").select("row_id", "group_row_id", "split")


def _assigned(comps: DataFrame, quota: DataFrame, rest: str) -> DataFrame:
    """(group_row_id, split): of each category and size, quota components per split in the order of a hash, the rest to one split.

    The place of a component comes in two steps, so that no task sorts all
    components of one size: places are counted per hash bucket, and numbered
    within the bucket only.
    """
    key = ["category", "size"]
    dealt = comps.withColumn("bucket", F.pmod(F.xxhash64("group_row_id"), F.lit(1024)))
    counts = dealt.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(*key, "bucket", (F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")) - F.col("n")).alias("before"))
    within = Window.partitionBy(*key, "bucket").orderBy(F.xxhash64("group_row_id"), "group_row_id")
    placed = dealt.withColumn("place", F.row_number().over(within)).join(offsets, [*key, "bucket"])
    spans = quota.withColumn("upto", F.sum("quota").over(Window.partitionBy(*key).orderBy("split"))).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("upto", "split"))).alias("spans"))
    mine = F.filter("spans", lambda s: F.col("before") + F.col("place") <= s["upto"])
    return placed.join(spans, key, "left").select("group_row_id", F.coalesce(F.get(mine, F.lit(0))["split"], F.lit(rest)).alias("split"))


def read(arrays: DataFrame) -> DataFrame:
    return arrays.select("row_id", genome_key(F.col("genome_id")).alias("genome"), rank(F.col("taxonomy"), 6).alias("genus"), subtype(F.col("cas_subtype")).alias("subtype"))


def found(arrays: DataFrame) -> DataFrame:
    return bound_groups(written(read(arrays), "read"), "row_id", ["genome", "genus"])


def array_splits(arrays: DataFrame) -> DataFrame:
    return grouped_splits(written(read(arrays), "read"), "row_id", ["genome", "genus"], "subtype")


def split_report(arrays: DataFrame) -> DataFrame:
    """Rows and share of every split, overall (category null) and per subtype."""
    splits = array_splits(arrays).join(read(arrays), "row_id")
    counted = splits.groupBy("split", F.coalesce("subtype", F.lit("none")).alias("subtype")).agg(F.count("*").alias("n"))
    per = Window.partitionBy("subtype")
    return counted.select("split", "subtype", F.col("n").alias("rows"), (F.col("n") / F.sum("n").over(per)).alias("share_of_subtype"))
