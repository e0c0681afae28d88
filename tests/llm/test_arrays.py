import random

import pytest
from pyspark.sql import functions as F

from arrayloom.llm import overlap, survivors
from arrayloom.llm.arrays import bases, genome_key, rank, same_bases, subtype

rng = random.Random(4)


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("v")).head().v


def test_readings(spark):
    ids = ["GV00000007.1.fna", "gv_00000007", "ref|GV00000007.2|", " bacteria/GV00000007.1.fasta", "GV000000071", "V00000007", "", None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "g string").select(genome_key(F.col("g"))).collect()]
    assert got == ["GV00000007"] * 4 + [None] * 4
    assert one(spark, bases(F.col("r")), r=" acg-u N\t") == "ACGTN"
    assert one(spark, bases(F.col("r")), r=" - ") is None
    assert one(spark, rank(F.col("t"), 6), t=" d__A; p__B;;; e ; g__Genus ;") == "genus"
    assert one(spark, rank(F.col("t"), 6), t="A|B|C|D|E") is None
    assert one(spark, rank(F.col("t"), 6), t="A,B,C,D,E,") is None
    assert [one(spark, subtype(F.col("s")), s=s) for s in ("CAS-I-E", "ie", "Type II-C", "V–A ", "III-A", "unknown", "")] == ["I-E", "I-E", "II-C", "V-A", "III-A", None, None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def worn(s, n):
    s = list(s)
    for _ in range(n):
        at, what = rng.randrange(len(s) + 1), rng.choice("xid")
        if what == "i":
            s.insert(at, rng.choice("ACGTN"))
        elif s:
            at = min(at, len(s) - 1)
            s[at : at + 1] = [rng.choice("ACGTN")] if what == "x" else []
    return "".join(s)


def repeats(n):
    """Families of repeats of all lengths, worn by up to three edits, on either strand."""
    out = []
    for _ in range(n):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 2, 3, 4, 7, 9, 12, 18, 21, 23, 24, 26, 28, 32, 33, 34, 36, 47, 95, 97, 110])))
        for _ in range(rng.randint(1, 5)):
            s = worn(base, rng.randint(0, 3))
            out.append(rc(s) if rng.random() < 0.4 else s)
    return out


def same(a, b):
    return min(edits(a, b), edits(rc(a), b)) <= 2


def test_overlaps_are_complete(spark):
    rows = [(i, f"GV0000000{rng.randint(1, 3)}", s, rng.choice(["train", "train", "validation", "test", None])) for i, s in enumerate(repeats(90))]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "row_id bigint, genome string, bases string, split string")
    got = {(r.train_row, r.other_row) for r in overlap.cross_split_overlaps(df, "bases", "genome", "split", "row_id").collect()}
    train, other = [r for r in rows if r[3] == "train" and r[2]], [r for r in rows if r[3] in ("validation", "test") and r[2]]
    assert got == {(a[0], b[0]) for a in train for b in other if a[1] == b[1] and same(a[2], b[2])}


SCHEMA = "row_id bigint, split string, genome_id string, repeat_sequence string, array_start bigint, genome string, text string"


def test_overlap_edge_cases(spark):
    rows = [(1, "train", "GV00000001", "ACGTACGTACGTACGTACGTACGT", 5, "x", "y"), (2, "test", "GV00000001.2", "acgtacgtacgtacguacgtacgt", 5, "x", "y"), (3, "test", None, "ACGTACGTACGTACGTACGTACGT", 5, "x", "y"), (4, None, "GV00000001", "ACGTACGTACGTACGTACGTACGT", 5, "x", "y"), (5, "test", "GV00000001", "", 5, "x", "y"), (6, "test", "GV00000001", "ACGT" * 9_000, 5, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in overlap.found(df).collect()] == [(1, 2)]
    assert overlap.found(df.limit(0)).count() == 0
    pairs = overlap.array_overlaps(df).collect()
    assert 0 < pairs[0].overlap <= 1


@pytest.mark.parametrize("crowd", [200, 2])
def test_same_array_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(survivors, "CROWD", crowd)
    rows = [(i, "train", rng.choice(["GV00000001", "GW00000001"]), s, rng.choice([None, *range(100, 300, 7)])) for i, s in enumerate(repeats(60)) if s]
    rows += [(900 + i, *rows[i][1:]) for i in range(0, 40, 3)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    want = {
        (min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and a[4] is not None and b[4] is not None and abs(a[4] - b[4]) <= 50 and same(a[3], b[3])
    }
    got = [tuple(r) for r in survivors.found(df).collect()]
    assert set(got) == want and len(got) == len(want)
    groups = {r.row_id: r.group_id for r in survivors.groups(df).collect()}
    assert set(groups) == {x for p in want for x in p} and all(groups[a] == groups[b] for a, b in want)
    assert survivors.found(df.limit(0)).count() == 0


def test_copies_are_found(spark):
    """Sources that share false values depend on each other; those that share true ones only do not."""
    rows = []
    for g in range(80):
        bad = f"w{g}" if g % 4 == 0 else f"v{g}"
        rows += [(g, "f", s, v, v == f"v{g}") for s, v in (("good1", f"v{g}" if g % 9 else f"x{g}"), ("good2", f"v{g}" if g % 7 else f"y{g}"), ("bad", bad), ("copy", bad))]
    judged = spark.createDataFrame(rows, "pattern bigint, field string, s string, no string, is_best boolean").withColumn("weight", F.lit(1))
    accuracy = judged.groupBy("s").agg(F.avg(F.col("is_best").cast("double")).alias("accuracy"))
    got = {frozenset((r.s, r.s2)): r.dependent for r in survivors._dependence(judged, accuracy).collect()}
    assert got[frozenset(("bad", "copy"))] > 0.99
    assert max(v for k, v in got.items() if k != frozenset(("bad", "copy"))) < 0.1


def test_copied_votes_count_less(spark):
    """Four copies don't outvote five independent sources that are right more often."""
    rows = []
    for g in range(120):
        rows += [(g, f"good{k}", f"v{g}" if rng.random() < 0.85 else f"e{rng.random()}") for k in range(5)]
        rows += [(g, f"copy{k}", f"w{g}" if g % 3 == 0 else f"v{g}") for k in range(4)]
    df = spark.createDataFrame([(*r, 1, g % 5) for g, r in enumerate(rows)], "grp bigint, source string, field string, trust int, at int")
    got = {r.grp: r.value for r in survivors.fuse(df, "grp", "source", ["field"], "trust", "at").collect()}
    votes = {}
    for g, _, v in rows:
        votes.setdefault(g, []).append(v)
    majority = sum(max(sorted(set(v)), key=v.count) == f"v{g}" for g, v in votes.items())
    assert sum(got[g] == f"v{g}" for g in range(120)) > majority


def test_fusion_edge_cases(spark):
    rows = [(1, "a", None, 1, 1), (1, None, "x", 2, 1), (1, None, "x", 2, 1), (2, "a", None, 1, 1), (3, "a", "p", 1, 1), (3, "b", "q", 1, 9), (4, "a", "p", 5, 1), (4, "b", "q", 1, 9)]
    df = spark.createDataFrame(rows, "grp bigint, source string, field string, trust int, at int")
    got = {r.grp: r.value for r in survivors.fuse(df, "grp", "source", ["field"], "trust", "at", rounds=1).collect()}
    assert got == {1: "x", 3: "q", 4: "p"}
    assert survivors.fuse(df.limit(0), "grp", "source", ["field"], "trust", "at", rounds=1).count() == 0
    assert spark.range(1).select(same_bases(F.lit("AC"), F.lit("AC"))).head()[0]
