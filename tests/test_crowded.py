"""Hit queries over a registry in which many records share their spacers."""

from collections import Counter

import pytest

from arrayloom.plans import interactions, sequences

BACTERIA, PHAGES = 40, 12


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Bacteria and phages of two classes."""
    folder = tmp_path_factory.mktemp("crowded")
    rows = [(997 * 4 * i + c, "bacterium") for i in range(1, BACTERIA + 1) for c in (0, 1)] + [(997 * 4 * i + c - 1, "phage") for i in range(1, PHAGES + 1) for c in (0, 1)]
    spark.createDataFrame(rows, "record_id bigint, record_type string").coalesce(1).write.parquet(f"{folder}/downloaded_records.parquet")
    return str(folder)


def searched(monkeypatch):
    """What matching looks for: the numbers of queries that it sent to the tiles."""
    sent, look = [], sequences.matching._looked_up
    monkeypatch.setattr(sequences.matching, "_looked_up", lambda target, rows, *more: sent.append(len(rows)) or look(target, rows, *more))
    return sent


def test_hit_alignments(spark, crowded, monkeypatch):
    sent = searched(monkeypatch)
    rows = interactions.hit_alignments(spark, crowded).collect()
    assert sent == [12]  # three spacers of two classes, both strands
    # every spacer has its five best of the twelve phages
    assert Counter(Counter(r.spacer_id for r in rows).values()) == {5: 2 * 3 * BACTERIA}
    assert {(r.marks.count("|"), len(r.marks)) for r in rows} == {(32, 32), (30, 32)}


def test_hit_targeting_features(spark, crowded, monkeypatch):
    sent = searched(monkeypatch)
    rows = sequences.hit_targeting_features(spark, crowded).collect()
    assert sent == [12]
    assert sum(r.fuzzy_spacer_candidate_count for r in rows) == 5 * 2 * 3 * BACTERIA
    assert {r.best_fuzzy_spacer_mismatches for r in rows} == {0}


def test_hit_long_fuzzy(spark, crowded, monkeypatch):
    sent = searched(monkeypatch)
    rows = sequences.hit_long_fuzzy(spark, crowded).collect()
    # record numbers of the classes are divisible by four or leave one: 32 and 21 bases
    assert sent == [4]
    assert Counter(Counter(r.spacer_id for r in rows).values()) == {5: 2 * BACTERIA}
    assert {(r.spacer_length, r.mismatches, r.strand) for r in rows} == {(32, 0, "+"), (21, 0, "+")}


def test_hit_long_exact(spark, crowded, monkeypatch):
    sent = searched(monkeypatch)
    rows = sequences.hit_long_exact(spark, crowded).collect()
    assert sent == [4]
    assert Counter(Counter(r.spacer_id for r in rows).values()) == {PHAGES: 2 * BACTERIA}
    assert len({(r.spacer_id, r.phage_id, r.start) for r in rows}) == len(rows)


def judged(monkeypatch):
    """How many rows the PAM rules were tried on, per call."""
    tried = []
    for place in (sequences.pam, sequences.evidence):
        whole = place.with_evaluation
        monkeypatch.setattr(place, "with_evaluation", lambda df, *more, whole=whole: tried.append(df.count()) or whole(df, *more))
    return tried


def test_pam_evaluations(spark, crowded, monkeypatch):
    tried = judged(monkeypatch)
    rows = sequences.pam_evaluations(spark, crowded).collect()
    # two spacers of a class are exact in its phages; eight rules
    assert tried == [2 * 2 * PHAGES * 8]
    assert len(rows) == len({(r.spacer_id, r.phage_id, r.start, r.rule) for r in rows}) == 2 * 2 * PHAGES * 8 * BACTERIA


def test_pam_subtype_support(spark, crowded, monkeypatch):
    want = {r.array_id: r for r in sequences.evidence.subtype_support(sequences._annotated(spark, crowded).withColumn("hit_no", sequences.F.struct("spacer_id", "phage_id", "strand", "start"))).collect()}
    tried = judged(monkeypatch)
    got = {r.array_id: r for r in sequences.pam_subtype_support(spark, crowded).collect()}
    assert tried == [2 * 2 * PHAGES * 5]
    assert got == want and len(got) == 2 * BACTERIA


def test_pairs_of_texts(spark, crowded, monkeypatch):
    """Pairs counted by texts equal those counted by hits, and rules are tried once per text, place and rule."""
    want = {(r.bacterium, r.phage): r for r in sequences.matrix_pairs(spark, crowded).collect()}
    tried = judged(monkeypatch)
    named = sequences._known_spacers(spark, crowded).join(sequences._predictions(spark, crowded), "array_id", "left")
    spacers = named.select("spacer_id", sequences.F.upper("spacer").alias("own"), "bacterium", "cas_subtype", "confidence")
    places = sequences._flanked_texts(sequences._known_spacers(spark, crowded), sequences.phages(spark, crowded))
    got = {(r.bacterium, r.phage): r for r in sequences.evidence.pair_evidence_of_texts(places, spacers).collect()}
    assert tried[0] <= 2 * 2 * PHAGES * 6 < 2 * 2 * PHAGES * BACTERIA
    assert got == want and len(want) > 0
