import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrayloom.operators.unpack import known_values, packed_values, segment, unpack

KNOWN = ["Key_1", "Key-2", "Key_1; erratum", "Key | table 5"]


def automaton(known=KNOWN):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in known:
        a.add_word(w, len(w))
    if known:
        a.make_automaton()
    return a


@pytest.mark.parametrize(
    "cell, want",
    [
        ("Key_1;Key-2", ["Key_1", "Key-2"]),
        ("Key_1; erratum", ["Key_1", "erratum"]),
        ('"Key_1; erratum"', ["Key_1; erratum"]),
        ("'Key | table 5'/Key_1", ["Key | table 5", "Key_1"]),
        ('["Key_1", "new, one"]', ["Key_1", "new, one"]),
        (" Key_1 \n other & more+x\t; ;;", ["Key_1", "other", "more", "x"]),
        ('"open; Key_1', ["open", "Key_1"]),
        ("it's fine", ["it", "s", "fine"]),
        ("", []),
        (";;|", []),
        ("9lives", []),
        ('""', []),
        ('" [a b] "', ["a b"]),
    ],
)
def test_segments(cell, want):
    assert segment(cell, automaton()) == want


def test_without_dictionary():
    assert segment("a,b", automaton([])) == ["a", "b"]


bare = st.from_regex(r"[A-Za-z][A-Za-z0-9_.\-]{0,8}", fullmatch=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(bare, st.text("abc ;,|/", min_size=1, max_size=8).map(lambda t: f"x{t}x")), max_size=6), st.sampled_from([";", ", ", " | ", "/", "\n"]))
def test_round_trip(values, delimiter):
    cell = delimiter.join(f'"{v}"' if not v.replace("_", "").replace(".", "").replace("-", "").isalnum() else v for v in values)
    assert segment(cell, automaton([v for v in values if v])) == values


def test_rows(spark):
    df = spark.createDataFrame([(1, "a;b"), (2, None), (3, ""), (4, "a;;a"), (5, "x" * 50_000 + ";y")], "k bigint, c string").withColumn("row_key", F.lit(9))
    got = unpack(df, "k", "c", ["a"], "t").collect()
    assert sorted((r.row_key, r.value_position, r.value_text[:3]) for r in got) == [(1, 1, "a"), (1, 2, "b"), (4, 1, "a"), (4, 2, "a"), (5, 1, "xxx"), (5, 2, "y")]
    assert unpack(df.limit(0), "k", "c", [], "t").count() == 0
    assert [r[0] for r in df.filter("k = 2").select(packed_values(F.col("c"), [])).collect()] == [None]


def test_dictionary_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",), (" a ",), (None,), ("",)], "v string")
    assert known_values(df, "v") == ["a", "b"]
    with pytest.raises(ValueError):
        known_values(df, "v", at_most=1)
