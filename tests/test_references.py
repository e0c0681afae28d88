from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arrayloom.operators.references import cell_values, find_orphans, last_path_element, orphan_counts

REF = "id int, a string, b string, at timestamp"
REG = "x string, y string, since timestamp, until timestamp"
T = [datetime(2024, m, 1) for m in range(1, 13)]
KEYS = {"a": "x", "b": "y"}


def orphans(spark, refs, regs, **kw):
    found = find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(regs, REG), KEYS, **kw)
    return sorted(r.id for r in found.collect())


REFS = [(1, "p", "q", T[5]), (2, "p", None, T[5]), (3, None, "q", T[5]), (4, None, None, T[5]), (5, "p", "z", T[5]), (6, "n", None, T[5])]
REGS = [("p", "q", T[0], None)]


@pytest.mark.parametrize("match, want", [("partial", [5, 6]), ("simple", [5]), ("full", [2, 3, 5, 6])])
def test_match_semantics(spark, match, want):
    assert orphans(spark, REFS, REGS, match=match) == want


def test_live_at_the_time(spark):
    regs = [("p", "q", T[3], T[6]), ("p", "q", T[8], None), ("p", "w", None, None)]
    refs = [(m, "p", "q", T[m]) for m in range(12)] + [(20, "p", "q", None), (21, "p", "w", T[5])]
    got = orphans(spark, refs, regs, as_of="at", live_from="since", live_until="until")
    assert got == [0, 1, 2, 6, 7, 20, 21]


def test_empty_tables_and_extra_columns(spark):
    refs = spark.createDataFrame([(1, "p", None, T[0], "m")], REF + ", x string")
    empty = spark.createDataFrame([], REG)
    assert [r.id for r in find_orphans(refs, empty, KEYS).collect()] == [1]
    assert find_orphans(refs, empty, KEYS).columns == refs.columns
    assert find_orphans(refs.limit(0), empty, KEYS).count() == 0


def test_repeated_references_stay(spark):
    assert orphans(spark, [(1, "n", None, T[0])] * 3, REGS) == [1, 1, 1]


def test_cells(spark):
    df = spark.createDataFrame([(1, ' "A.1" ; b|, \'c d\' ;A.1'), (2, ""), (3, None)], "k int, c string")
    got = {r.k: r.v for r in df.select("k", cell_values(F.col("c")).alias("v")).collect()}
    assert got == {1: ["A.1", "b", "c d"], 2: [], 3: None}
    paths = spark.createDataFrame([("a/b\\c.fa",), ("c.fa",), ("a/",)], "p string").select(last_path_element(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["c.fa", "c.fa", ""]


def test_counts_keep_unknown_months(spark):
    df = spark.createDataFrame([("f", T[0]), ("f", T[0]), ("f", None)], "field string, at timestamp")
    assert {(r.field, r.month): r.orphans for r in orphan_counts(df, "field", "at").collect()} == {("f", "2024-01"): 2, ("f", None): 1}
