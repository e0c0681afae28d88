import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arrayloom.functions import dna
from arrayloom.operators import detect, evidence, matching, pam

rng = random.Random(1)


def bases(n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def rc(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def brute_arrays(seq):
    found = []
    for size in range(23, 48):
        places = {}
        for i in range(len(seq) - size + 1):
            w = seq[i : i + size]
            if set(w) <= set("ACGT"):
                places.setdefault(w, []).append(i)
        for w, ps in places.items():
            if max(w.count(b) for b in "ACGT") / size > 0.8 or not 0.2 <= (w.count("G") + w.count("C")) / size <= 0.8:
                continue
            chain = [ps[0]]
            for p in [*ps[1:], None]:
                if p is not None and 20 <= p - chain[-1] - size <= 72:
                    chain.append(p)
                    continue
                if len(chain) >= 3:
                    found.append(((-len(chain), -(chain[-1] + size - chain[0]), -size, ps[0], chain[0]), chain[0] + 1, chain[-1] + size, w))
                chain = [p]
    kept = []
    for _, s, e, w in sorted(found):
        if all(max(0, min(e, b) - max(s, a) + 1) / min(e - s + 1, b - a + 1) <= 0.5 for a, b, _ in kept):
            kept.append((s, e, w))
    return sorted(kept)


def test_detection_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(detect, "TILE", 64)
    rows = [("g", "c", 0, bases(500)), ("g", "c", 1, ""), ("g", "c", 2, None), ("g", "c", 3, "A" * 300)]
    for i in range(4, 16):
        r = bases(rng.randint(23, 47), "ACGT")
        many = rng.randint(2, 6)
        body = "".join(r + bases(rng.randint(15, 80), "ACGTN" if i % 3 == 0 else "ACGT") for _ in range(many)) + r
        rows.append(("g", "c", i, bases(rng.randint(0, 90)) + body + bases(rng.randint(0, 90)) + (body if i % 4 == 0 else "")))
    df = spark.createDataFrame(rows, "genome_id string, contig_id string, record_no bigint, sequence string")
    got = {}
    for r in detect.detect_arrays(df).collect():
        got.setdefault(r.record_no, []).append((r.start, r.end, r.repeat_consensus))
        assert r.repeat_count == len(r.spacers) + 1
    assert {k: sorted(v) for k, v in got.items()} == {r[2]: brute_arrays(r[3]) for r in rows if r[3] and brute_arrays(r[3])}
    assert detect.detect_arrays(df.limit(0)).count() == 0


def test_four_repeats_three_spacers(spark):
    repeat, spacers = "GTTCACTGCCGTATAGGCAGCTAAGAAA", [bases(32) for _ in range(3)]
    seq = bases(8) + repeat + "".join(s + repeat for s in spacers) + bases(8)
    df = spark.createDataFrame([("g", "c", 0, seq.lower())], "genome_id string, contig_id string, record_no bigint, sequence string")
    (a,) = detect.detect_arrays(df).collect()
    assert a.array_id == "g|c|array_1" and a.repeat_count == 4 and len(a.spacers) == 3
    assert [r.spacer_id for r in detect.spacer_table(detect.detect_arrays(df)).orderBy("spacer_index").collect()] == [f"g|c|array_1|spacer_{i}" for i in (1, 2, 3)]


def test_exact_and_fuzzy_equal_brute_force(spark):
    spacers = [(f"s{i}", bases(rng.choice([3, 9, 20, 31, 32]))) for i in range(12)] + [("pal", "ACGTACGTACGTACGTACGTACGT"), ("none", "")]
    phages = []
    for i in range(8):
        seq = bases(40)
        for sid, s in rng.sample(spacers[:-1], 4):
            worn = list(s)
            for _ in range(rng.choice([0, 0, 1, 3, 4, 5])):
                worn[rng.randrange(len(worn))] = rng.choice("ACGT")
            w = "".join(worn)
            seq += (w if rng.random() < 0.5 else rc(w)) + bases(rng.randint(0, 12))
        phages.append((f"p{i}", "c", seq))
    s = spark.createDataFrame(spacers, "spacer_id string, spacer string")
    p = spark.createDataFrame(phages, "phage_id string, phage_contig string, sequence string")
    want, near = set(), {}
    for sid, q in spacers:
        for strand, text in (("+", q), ("-", rc(q))):
            if not q or (strand == "-" and text == q):
                continue
            for pid, _, seq in phages:
                for at in range(len(seq) - len(q) + 1):
                    there = seq[at : at + len(q)]
                    if there == text:
                        want.add((sid, pid, strand, at + 1, at + len(q)))
                    mm = sum(a != b for a, b in zip(text, there))
                    if len(q) >= 8 and mm <= 4 and 1 - mm / len(q) >= 0.85:
                        e = min(sum(a != b for a, b in zip(text[:8], there[:8])), sum(a != b for a, b in zip(text[-8:], there[-8:])))
                        near.setdefault(sid, []).append((mm, e, pid, "c", strand, at))
    got = {(r.spacer_id, r.phage_id, r.strand, r.start, r.end) for r in matching.exact_hits(s, p).collect()}
    assert got == want
    fuzzy = {}
    for r in matching.fuzzy_hits(s, p).collect():
        fuzzy.setdefault(r.spacer_id, []).append((r.mismatches, r.edge_mismatches, r.phage_id, "c", r.strand, r.start - 1))
    assert {k: sorted(v) for k, v in fuzzy.items()} == {k: sorted(v)[:5] for k, v in near.items()}


def test_flanks(spark):
    s = spark.createDataFrame([("s", "ACGTACGGTTCA")], "spacer_id string, spacer string")
    p = spark.createDataFrame([("a", "c", "TTTT" + "ACGTACGGTTCA" + "GGGG"), ("b", "c", "TTTT" + rc("ACGTACGGTTCA") + "GGGG")], "phage_id string, phage_contig string, sequence string")
    got = {r.phage_id: r for r in matching.with_flanks(matching.exact_hits(s, p), p).collect()}
    assert (got["a"].strand, got["a"].start, got["a"].flank_5p, got["a"].flank_3p) == ("+", 5, "TTTT", "GGGG")
    assert (got["b"].strand, got["b"].flank_5p, got["b"].flank_3p, got["b"].protospacer) == ("-", "CCCC", "AAAA", "ACGTACGGTTCA")


@pytest.mark.parametrize(
    "rule, want",
    [
        ("5prime:AWG", ("AAG", True, "compatible", 1.0, 0)),
        ("3prime:NGG", ("TGG", True, "compatible_nearby", 1.0, 1)),
        ("3prime:CCC", ("ATG", False, "not_supported", 0.0, 0)),
        ("3P:ACG", ("ATG", False, "not_supported", 0.666667, 0)),
        ("genomic_3prime:GG", ("GG", True, "compatible", 1.0, 0)),
        ("5prime:NNNNNNNNNN", ("TTAAG", None, "insufficient_flank", None, None)),
        ("sideways:NGG", ("", None, "invalid_rule", None, None)),
        ("NGG", ("", None, "invalid_rule", None, None)),
        ("3prime:NXG", ("", None, "invalid_rule", None, None)),
        ("", ("", None, "not_evaluated", None, None)),
        (None, ("", None, "not_evaluated", None, None)),
    ],
)
def test_pam_rules(spark, rule, want):
    df = spark.createDataFrame([(rule, "TTAAG", "ATGGC", "CCCC", "GGAA")], "rule string, f5 string, f3 string, up string, down string")
    got = pam.with_evaluation(df, F.col("rule"), "f5", "f3", "up", "down").head().pam
    assert tuple(got) == want


def test_seed(spark):
    df = spark.createDataFrame([("AAAACCCC", "ATAACCCG")], "a string, b string")
    five = df.select(matching.seed_mismatches(F.col("a"), F.col("b"), F.lit("5prime"), 4).alias("s")).head().s
    three = df.select(matching.seed_mismatches(F.col("a"), F.col("b"), F.lit("3prime"), 4).alias("s")).head().s
    assert tuple(five) == ("5prime:1-4", 4, 1, "2") and tuple(three) == ("3prime:5-8", 4, 1, "4")
    assert df.select(matching.seed_mismatches(F.col("a"), F.col("b"), F.lit("")).alias("s")).head().s is None


HIT = "bacterium string, phage string, spacer_id string, identity double, coverage double, pam_match boolean, pam_support_level string, pam_compatibility_score double, seed_mismatches int, confidence double"


def test_scores(spark):
    plain = ("a", "x", "s1", 1.0, 1.0, None, "not_evaluated", None, None, None)
    rows = [plain, ("b", "x", *plain[2:]), ("b", "x", "s2", *plain[3:]), ("c", "x", "s1", 1.0, 1.0, False, "not_supported", 0.3, 0, 1.0), ("d", "x", "s1", 1.0, 1.0, True, "compatible", 1.0, 0, 1.0)]
    grid = evidence.evidence_matrix(spark.createDataFrame(rows, HIT), spark.createDataFrame([(b,) for b in "abcde"], "bacterium string"), spark.createDataFrame([("x",), ("y",)], "phage string"))
    got = {(r.bacterium, r.phage): r for r in grid.collect()}
    assert len(got) == 10
    assert [got[b, "x"].crispr_targeting_score for b in "abcde"] == [43.0, 53.53, 28.0, 83.0, 0.0]
    assert got["d", "x"].current_evidence_level.startswith("strong") and got["e", "y"].pam_support_level == "not_applicable"
    wide = evidence.heatmap(grid, ["x", "y"]).orderBy("bacterium").collect()
    assert [tuple(r) for r in wide[:2]] == [("a", 1, 0), ("b", 2, 0)]
    assert [r.bacterium for r in evidence.top_pairs(grid, 2).collect()] == ["d", "b"]


def test_accessions_and_hash(spark):
    df = spark.createDataFrame([("ref|NC_000001.1|", "x"), ("contig", "(CP012345.1), complete"), ("", "nothing"), ("GV00000007.1", "")], "a string, b string")
    assert [r[0] for r in df.select(dna.extract_accession(F.col("a"), F.col("b"))).collect()] == ["NC_000001.1", "CP012345.1", "", "GV00000007.1"]
    h = spark.createDataFrame([("ac gt",), ("ACGT",), ("ACGTé",)], "s string").select(dna.sequence_hash(F.col("s"))).distinct().count()
    assert h == 1


def test_structure(spark):
    df = spark.createDataFrame([("GAATTC",), ("AAAACCCCGTTTTT",), ("",), (None,)], "s string")
    got = [tuple(r)[1:] for r in dna.with_structure(df, "s").collect()]
    assert got[0] == (1.0, 3, 0.0) and got[1][1] == 4 and got[2] == (0.0, 0, 0.0) == got[3]


@pytest.mark.parametrize("few", [0, 40_000])
def test_equal_spacers_are_one_query(spark, few):
    """Members of a text come out alike, each with its best places; few queries travel, more are joined."""
    text = [bases(32), bases(21), "ACGN" * 6]
    rows = [(f"s{i}", text[i % 3].lower() if i % 2 else text[i % 3]) for i in range(60)]
    s = spark.createDataFrame(rows, "spacer_id string, spacer string")
    worn = text[0][:9] + text[0][9].translate(str.maketrans("ACGT", "CGTA")) + text[0][10:]
    long = bases(detect.TILE - 10) + text[0] + bases(detect.TILE) + rc(worn) + bases(3)
    p = spark.createDataFrame([("p1", "c", long), ("p2", "c", text[1] + "é" + text[2]), ("p3", "c", ""), ("p4", "c", None)], "phage_id string, phage_contig string, sequence string")
    exact = Counter((r.spacer_id, r.phage_id, r.strand, r.start) for r in matching.exact_hits(s, p, few).collect())
    assert exact == Counter([(f"s{i}", *((("p1", "+", detect.TILE - 9), ("p2", "+", 1), ("p2", "+", 23))[i % 3])) for i in range(60)])
    fuzzy = Counter((r.spacer_id, r.phage_id, r.strand, r.start, r.mismatches) for r in matching.fuzzy_hits(s, p, few=few).collect())
    at = 2 * detect.TILE + 23
    assert fuzzy == Counter([x for i in range(60) if i % 3 < 2 for x in ([(f"s{i}", "p1", "+", detect.TILE - 9, 0), (f"s{i}", "p1", "-", at, 1)], [(f"s{i}", "p2", "+", 1, 0)])[i % 3]])


def test_equal_spacers_meet_phages_once(spark):
    """Texts are looked for, not ids: the searched table has one row per text and place."""
    own = spark.createDataFrame([("ACGTTGCAGGTA",)] * 50, "own string")
    p = spark.createDataFrame([("p", "c", "TT" + "ACGTTGCAGGTA" + "CC")], "phage_id string, phage_contig string, sequence string")
    assert [(r.own, r.strand, r.start, r.end) for r in matching.exact_places(own, p).collect()] == [("ACGTTGCAGGTA", "+", 3, 14)]


def test_better_chains_equal_greedy_choice():
    """Stretch by stretch with a look-up of neighbours, ties by the repeat's first place: the same as one by one over all chains."""
    own = random.Random(7)
    for _ in range(200):
        sequence = "".join(own.choice("AC") for _ in range(400))
        chains = []
        for _ in range(own.randint(1, 25)):
            first, size, step = own.randrange(300), own.choice([3, 4]), own.choice([8, 9])
            places = [first + k * step for k in range(own.randint(3, 6))]
            chains.append((places[0] + 1, places[-1] + size, size, sequence[first : first + size], places))
        kept = []
        for c in sorted(chains, key=lambda c: (-len(c[4]), c[0] - c[1], -c[2], sequence.find(c[3]), c[0], c[1], c[3], c[4])):
            shared = [max(0, min(c[1], k[1]) - max(c[0], k[0]) + 1) / min(c[1] - c[0] + 1, k[1] - k[0] + 1) for k in kept]
            if all(x <= 0.5 for x in shared):
                kept.append(c)
        assert detect._better(list(chains), sequence) == sorted(kept, key=lambda c: (c[0], c[1]))


def test_contig_of_many_arrays(spark):
    """A contig of many tiles and 2,000 arrays with one repeat: each is found, in the order of its place."""
    repeat = "GTTCACTGCCGTATAGGCAGCTAAGAAA"
    one = "T" + repeat + "".join(x + repeat for x in ("A" + bases(30) + "C", "C" + bases(30) + "G", "G" + bases(30) + "T")) + "C" + bases(80, "AG")
    df = spark.createDataFrame([("g", "c", 0, one * 2000)], "genome_id string, contig_id string, record_no bigint, sequence string")
    got = detect.detect_arrays(df).select("start", "end", "repeat_consensus", "array_id").orderBy("start").collect()
    assert [(r.start, r.end, r.repeat_consensus) for r in got] == [(i * len(one) + 2, (i + 1) * len(one) - 81, repeat) for i in range(2000)]
    assert [r.array_id for r in got] == [f"g|c|array_{i}" for i in range(1, 2001)]
