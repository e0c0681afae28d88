import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import capping, grouped_split, packing, proportions
from arrayloom.llm.components import components

rng = random.Random(9)


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("edges", [[(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 150)] + [(500, 500)], []])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "a bigint, b bigint")
    assert {r.vertex: r.root for r in components(df).collect()} == roots(edges)


SCHEMA = "row_id bigint, genome string, genus string, subtype string, v string"


def bound_rows(n=300):
    return [(i, rng.choice([None, *(f"g{k}" for k in range(120))]), rng.choice([None, *(f"u{k}" for k in range(60))]), rng.choice(["I-E", "II-A", None]), "x") for i in range(n)]


def test_bound_groups_and_splits(spark):
    rows = bound_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = roots([(("a", r[0]), ("a", r[0])) for r in rows] + [e for r in rows for e in ((("a", r[0]), ("b", r[1])) if r[1] else None, (("a", r[0]), ("c", r[2])) if r[2] else None) if e])
    first = {}
    for r in rows:
        first.setdefault(want["a", r[0]], r[0])
    got = {r.row_id: r.group_row_id for r in grouped_split.bound_groups(df, "row_id", ["genome", "genus"]).collect()}
    assert got == {r[0]: first[want["a", r[0]]] for r in rows}
    assert grouped_split.bound_groups(df.limit(0), "row_id", ["genome", "genus"]).count() == 0


def test_splits_meet_shares(spark):
    rows = [(i, f"g{i // rng.choice([1, 2, 5])}-{i % 3}", None, rng.choice(["I-E", "II-A"]), "x") for i in range(600)]
    got = grouped_split.grouped_splits(spark.createDataFrame(rows, SCHEMA), "row_id", ["genome", "genus"], "subtype").collect()
    assert len(got) == 600
    per = {}
    for r in got:
        per.setdefault(r.group_row_id, set()).add(r.split)
    assert all(len(s) == 1 for s in per.values())
    counts = {s: sum(r.split == s for r in got) for s in ("train", "validation", "test")}
    assert counts == {"train": 480, "validation": 60, "test": 60}


def test_subset_sums():
    chosen = grouped_split.choose_counts([(3, 5), (7, 2), (50, 1)], {"a": 20.0, "b": 13.0, "c": 46.0})
    assert sum(s * n for s, n in chosen["b"].items()) == 13 and sum(s * n for s, n in chosen["a"].items()) in (19, 20, 21, 22, 18, 9, 12, 16)
    for size in (3, 7, 50):
        assert sum(c.get(size, 0) for c in chosen.values()) <= {3: 5, 7: 2, 50: 1}[size]


def kept_by_sort(rows, cap):
    out = set()
    for who in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == who), key=lambda r: (-(r[2] if r[2] is not None else -(1 << 63)), r[0]))
        out |= {r[0] for r in mine[:cap]}
    return out


CAP = "row_id bigint, who string, score bigint, _who string"


@pytest.mark.parametrize("cap", [0, 1, 7, 100, 10_000])
def test_caps(spark, cap):
    rows = [(i - 150, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, -5, 0, 3, 70_000, 1 << 60, -(1 << 62)]), "x") for i in range(400)]
    got = capping.cap_contributors(spark.createDataFrame(rows, CAP), "who", "score", "row_id", max_rows=cap)
    assert got.columns == ["row_id", "who", "score", "_who"]
    assert {r.row_id for r in got.collect()} == kept_by_sort(rows, cap)


def test_share_caps_and_empty(spark):
    rows = [(i, w, i % 10, "x") for i, w in enumerate(["a"] * 300 + ["b"] * 60 + ["c"] * 40 + ["d"] * 10)]
    df = spark.createDataFrame(rows, CAP)
    kept = capping.cap_contributors(df, "who", "score", "row_id", max_share=0.4).groupBy("who").count().collect()
    n = {r["who"]: r["count"] for r in kept}
    assert max(n.values()) <= 0.4 * sum(n.values()) and n == {"a": 73, "b": 60, "c": 40, "d": 10}
    assert capping.cap_contributors(df, "who", "score", "row_id", max_share=0.1).count() == 0
    assert capping.cap_contributors(df.limit(0), "who", "score", "row_id", max_rows=3).count() == 0
    twice = df.filter("who = 'd'").unionByName(df.filter("who = 'd'"))
    assert capping.cap_contributors(twice, "who", "score", "row_id", max_rows=3).count() == 2
    with pytest.raises(ValueError):
        capping.cap_contributors(df, "who", "score", "row_id")


TARGETS = [("s", "I-A", 0.5, 2), ("s", "I-B", 0.3, 2), ("s", "II-A", 0.2, 10), ("p", "X", 0.6, 1), ("p", "Y", 0.4, 5)]


def sample(spark, rows, fraction=0.25):
    df = spark.createDataFrame(rows, "row_id bigint, sub string, phy string, first string")
    targets = spark.createDataFrame(TARGETS, "field_name string, category string, target_share double, min_rows int")
    return [f(df, "row_id", "sub", "phy", targets, ("s", "p"), fraction).collect() for f in (proportions.proportional_sample, proportions.missed_targets)]


def test_sample_meets_targets(spark):
    rows = [(i, rng.choice(["I-A", "I-B", "II-A", "III-A", None]), rng.choice(["X", "X", "Y", "Z", None]), "x") for i in range(1200)]
    drawn, report = sample(spark, rows)
    assert len(drawn) == 300 == len({r.row_id for r in drawn})
    assert all(r.share_met and r.minimum_met for r in report if r.field_name == "s")
    assert all(abs(r.drawn - r.target_share * 300) <= 3 for r in report)


def test_unmet_quota_goes_to_siblings_first(spark):
    rows = [(i, "I-A", "X", "x") for i in range(10)] + [(100 + i, "I-B", "Y", "x") for i in range(500)] + [(1000 + i, "II-A", "X", "x") for i in range(500)]
    drawn, report = sample(spark, rows, 200 / 1010)
    n = {c: sum(r["first"] == c for r in drawn) for c in ("I-A", "I-B", "II-A")}
    assert n == {"I-A": 10, "I-B": 150, "II-A": 40}
    assert [r.share_met for r in report if r.category == "I-A"] == [False]


def test_sample_of_little(spark):
    drawn, report = sample(spark, [(1, "I-A", None, "x"), (2, None, "X", "x")], 1.0)
    assert [r.row_id for r in drawn] == [1] and not all(r.minimum_met for r in report)
    drawn, report = sample(spark, [], 1.0)
    assert drawn == [] and len(report) == 5


def test_packing_is_tight():
    sizes = np.array([rng.choice([1, 5, 40, 700, 2047, rng.randint(1, 900), rng.randint(1, 900), rng.randint(1, 900)]) for _ in range(3000)])
    bins, places = packing.pack(sizes, 2048)
    loads = np.bincount(bins, weights=sizes)
    assert loads.max() <= 2048 and (bins >= 0).all()
    assert len(loads) <= sizes.sum() / 2048 * 1.01 + 1
    assert len({(b, p) for b, p in zip(bins, places)}) == len(sizes)


def test_two_replace_one():
    bins, _ = packing.pack(np.array([6, 3, 4, 4]), 10)
    assert sorted(np.bincount(bins, weights=[6, 3, 4, 4])) == [7, 10]


def test_containers(spark):
    rows = [(1, 0), (2, None), (3, 5000), (4, 2048), (5, 1), (6, 100), (6, 100)]
    got = packing.pack_items(spark.createDataFrame(rows, "doc bigint, n bigint"), "doc", "n").collect()
    assert sorted((r["item"], r.part, r.size) for r in got) == [(1, 1, 0), (2, 1, 0), (3, 1, 2048), (3, 2, 2048), (3, 3, 904), (4, 1, 2048), (5, 1, 1), (6, 1, 100), (6, 1, 100)]
    assert {r["item"] for r in got if r.container is None} == {1, 2}
    by = {}
    for r in got:
        if r.container:
            by.setdefault(r.container, []).append((r.place, r.offset, r.size))
    for parts in by.values():
        at = 0
        for place, (p, offset, size) in enumerate(sorted(parts), 1):
            assert (p, offset) == (place, at)
            at += size
        assert at <= 2048
    assert packing.pack_items(spark.createDataFrame([], "doc bigint, n bigint"), "doc", "n").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("<|endoftext|>",), ("é" * 20_000,)], "t string")
    got = [r[0] for r in df.select(packing.token_count(F.col("t"))).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] > 1 and got[4] > 0


def test_splits_spread_categories(spark):
    """Large components of different sizes and small ones: every category comes near its shares, the totals nearer still."""
    own = random.Random(4)
    rows, at = [], 0
    for k in range(400):
        size = own.choice([1, 1, 2, 3, 5, 8, 13, 40, 90]) + k % 4
        kind = own.choices(["I-E", "II-A", "V-A", None], [6, 3, 2, 1])[0]
        for _ in range(size):
            rows.append((at, f"g{k}", None, kind if own.random() < 0.9 else "I-E", "x"))
            at += 1
    got = grouped_split.grouped_splits(spark.createDataFrame(rows, SCHEMA), "row_id", ["genome", "genus"], "subtype").collect()
    kind_of = {r[0]: r[3] for r in rows}
    for kind in ("I-E", "II-A", "V-A", None):
        mine = [r.split for r in got if kind_of[r.row_id] == kind]
        for split, share in grouped_split.SHARES.items():
            assert abs(mine.count(split) / len(mine) - share) < 0.03, (kind, split)
    for split, share in grouped_split.SHARES.items():
        assert abs(sum(r.split == split for r in got) - share * at) <= 3, split
    assert len(got) == at and len({(r.group_row_id, r.split) for r in got}) == len({r.group_row_id for r in got})


def test_units_leave_no_remainder():
    own = random.Random(5)
    sizes = [(s, own.randint(1, 400)) for s in range(1, 60)] + [(own.randint(1000, 9000), 1) for _ in range(40)]
    total = sum(s * n for s, n in sizes)
    chosen = grouped_split.choose_counts(sizes, {"a": 0.1 * total, "b": 0.1 * total, "c": 0.8 * total}, unit=37)
    for split in "ab":
        assert abs(sum(s * n for s, n in chosen[split].items()) - 0.1 * total) <= 0.5
    assert all(sum(c.get(s, 0) for c in chosen.values()) <= n for s, n in dict(sizes).items())


def test_capping_without_scores(spark):
    df = spark.createDataFrame([(i, "a", None, "x") for i in range(9)] + [(20, None, -(1 << 63), "x"), (21, None, (1 << 63) - 1, "x"), (22, None, None, "x")], CAP)
    got = {r.row_id for r in capping.cap_contributors(df, "who", "score", "row_id", max_rows=2).collect()}
    assert got == {0, 1, 21, 20}


def test_missed_share_of_a_small_category(spark):
    df = spark.createDataFrame([(i, "I-E", "P") for i in range(1000)], "row_id bigint, subtype string, phylum string")
    targets = spark.createDataFrame([("s", "I-E", 0.998, 1), ("s", "VI-B", 0.002, 1)], "field_name string, category string, target_share double, min_rows int")
    got = {r.category: r.share_met for r in proportions.missed_targets(df, "row_id", "subtype", "phylum", targets, ("s", "p"), 1.0).collect()}
    assert got == {"I-E": True, "VI-B": False}
