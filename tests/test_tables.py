import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from arrayloom.operators import curation, intervals, metrics, training
from arrayloom.operators.neighbours import neighbour_features
from arrayloom.sources import sequences, sinks, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 first one\r\nacg\r\nTT\r\n>r2\n\n>r3 x>y\nAC\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write("\n>z\nGG\n")
    (tmp_path / "c.fa").write_text("")
    got = rows(sequences.fasta(spark, str(tmp_path)), "record_id")
    assert got == [("a.fasta", "r1", "r1 first one", "ACGTT"), ("a.fasta", "r2", "r2", ""), ("a.fasta", "r3", "r3 x>y", "AC"), ("b.fa.gz", "z", "z", "GG")]
    ordered = sequences.fasta_in_order(spark, str(tmp_path / "a.fasta")).orderBy("record_no").collect()
    assert [(r.record_no, r.record_id, r.sequence) for r in ordered] == [(0, "r1", "ACGTT"), (1, "r2", ""), (2, "r3", "AC")]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.fa", ">a b\nac\ngt\n>c\nTT")
    assert rows(sequences.fasta_in_zip(spark, str(tmp_path / "a.zip"), "x.fa")) == [(0, "a", "ACGT"), (1, "c", "TT")]
    with pytest.raises(Exception, match="x.fa"):
        sequences.fasta_in_zip(spark, str(tmp_path / "a.zip"), "nope").collect()


def test_genbank(spark, tmp_path):
    (tmp_path / "p.gb").write_text(
        "LOCUS       PH1 100 bp\nACCESSION   PH1\nFEATURES             Location/Qualifiers\n     source          1..100\n     CDS             1..30\n"
        '                     /product="phage\n                     Integrase"\n                     /gene="int"\n     CDS             40..60\n                     /product="tail fiber"\n     gene            1..2\n                     /gene="holin"\nORIGIN\n        1 acgt\n//\n'
    )
    features = sequences.genbank_features(spark, str(tmp_path / "p.gb"))
    assert [(r.accession, r.text) for r in features.orderBy("feature_no").collect()] == [("PH1", "phage integrase int"), ("PH1", "tail fiber")]
    counted = sequences.keyword_counts(features, "accession", {"tail": ("tail", "fiber"), "int": ("integrase",)}).head()
    assert (counted.features, counted.tail_count, counted.int_count) == (2, 1, 1)


def test_dump(spark, tmp_path):
    (tmp_path / "d.sql").write_text("--\nCOPY public.region (id, category, sequence) FROM stdin;\n1\t3\tACG\\n\n2\t\\N\tTT\n\\.\n\nCOPY public.strain (id, refseq) FROM stdin;\n7\tNC\n\\.\n")
    path = str(tmp_path / "d.sql")
    assert rows(tables.sql_dump(spark, path, "region")) == [("1", "3", "ACG"), ("2", "", "TT")]
    assert rows(tables.sql_dump(spark, path, "strain")) == [("7", "NC")]
    with pytest.raises(ValueError):
        tables.sql_dump(spark, path, "none")


def test_alignments_and_reports(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("s\tp\t100.0\t19\t0\t0\t1\t19\t30\t12\t1e-5\t40\tACGT\ns\tp\t100.0\t18\t0\t0\t1\t18\t1\t18\t1e-5\t40\tAAA\tCCC\n")
    spacers = spark.createDataFrame([("s", "A" * 20)], "spacer_id string, spacer string")
    (hit,) = tables.alignments(spark, str(tmp_path / "h.tsv"), spacers).collect()
    assert (hit.strand, hit.start, hit.end, hit.coverage, hit.aligned_protospacer, hit.aligned_spacer) == ("-", 12, 30, 0.95, "ACGT", None)
    (tmp_path / "r.txt").write_text("Sequence 'c1' (900 bp)\n\nCRISPR 1   Range: 10 - 90\nPOSITION\tREPEAT\t\tSPACER\n--------\n10\t\tACGT\t\tTTTA\t[ 4, 4 ]\n20\t\tACGT\t\tGGGA\t[ 4, 4 ]\n30\t\tACGA\t\t\n--------\nSequence 'c2' (9 bp)\nNo arrays\n")
    (a,) = tables.array_report(spark, str(tmp_path / "r.txt")).collect()
    assert (a.contig_id, a.array_no, a.start, a.end, a["repeat"], a.spacers) == ("c1", 1, 10, 90, "ACGT", ["TTTA", "GGGA"])


def test_text_tables(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\n1\t\n\tx\n")
    assert rows(tables.manifest(spark, str(tmp_path / "m.tsv"), ["a"])) == [("", "x"), ("1", "")]
    with pytest.raises(ValueError):
        tables.manifest(spark, str(tmp_path / "m.tsv"), ["c"])
    df = spark.createDataFrame([(1, "A", 1), (1, None, 2), (1, "B", 3), (1, None, 4)], "g int, s string, o int")
    assert [r.s for r in tables.filled_down(df, "s", "o", ["g"]).orderBy("o").collect()] == ["A", "A", "B", "B"]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("f", "NC_000001.1", "", "ACGT"), ("f", "b", "", "acgt"), ("g", "c", "", "")], "source_file string, record_id string, description string, sequence string")
    sinks.save_run(str(tmp_path / "run"), {"records": records.withColumn("list", F.array(F.lit("a"), F.lit("b")))}, {"seed": 8})
    assert spark.read.parquet(str(tmp_path / "run/parquet/records")).count() == 3
    assert tables.strings(spark, str(tmp_path / "run/csv/records"), ",").select("list").distinct().head()[0] == "a,b"
    with pytest.raises(Exception, match="exist"):
        sinks.save_run(str(tmp_path / "run"), {"records": records}, {})
    (dup,) = sinks.duplicate_records(records, "record_id").collect()
    assert (dup.records, dup.kept_record, dup.other_records) == (2, "f:NC_000001.1", "f:b")
    assert [(r.length_bp, r.gc_percent, r.accession) for r in sinks.record_summary(records).orderBy("record_id").collect()] == [(4, 50.0, "NC_000001.1"), (4, 50.0, ""), (0, 0.0, "")]


def test_efficiency_texts(spark):
    texts = ["<1e-6", "0.25", "0.04±0.02", "not reported", "≤ 0.5", "0.1 - 0.5", "25%", None, "0", ".7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(curation.parse_efficiency(F.col("t")).alias("e"))
    got = [(r[0], r[1], r[2]) for r in df.select("e.relation", "e.value", curation.efficiency_class(F.col("e.relation"), F.col("e.value"))).collect()]
    assert got == [("<", 1e-6, "none"), ("=", 0.25, "medium"), ("=", 0.04, "low"), ("not_reported", None, "not_reported"), ("<=", 0.5, "high"), ("range", None, "not_reported"), ("not_reported", None, "not_reported"), ("not_reported", None, "not_reported"), ("=", 0.0, "none"), ("=", 0.7, "high")]


def test_wildcard_links(spark):
    links = spark.createDataFrame([("e", "A", "*", "exact", "x"), ("e", "A", "1", "not_found", ""), ("e", "B", "*", "exact", " ")], "kind string, name string, strain string, linkage_status string, accession string")
    asked = spark.createDataFrame([(1, "e", "A", "1"), (2, "e", "A", "2"), (3, "e", "B", "2"), (4, "e", "C", "2"), (5, "e", None, None)], "id int, k string, n string, s string")
    got = curation.linked(asked, links, {"k": "kind", "n": "name"}, ("s", "strain"), ("exact",), "ok")
    assert [(r.id, r.ok) for r in got.orderBy("id").collect()] == [(1, False), (2, True), (3, False), (4, False), (5, False)]


def test_intervals(spark):
    a = spark.createDataFrame([(1, "c", 100, 200), (2, "c", 90_000, 90_100), (3, "d", 5, 5), (4, "c", None, 7)], "id int, c string, start int, end int")
    b = spark.createDataFrame([(7, "c", 250, 300), (8, "c", 40, 50), (9, "c", 150, 99_999), (10, "d", 26_000, 26_001)], "id int, c string, start int, end int")
    near = intervals.nearest(a, b, "c", "id", "id").select("a.id", F.col("b.id").alias("b"), "distance")
    assert sorted(map(tuple, near.collect())) == [(1, 9, 0), (2, 9, 0)]
    assert sorted((r.a.id, r.b.id) for r in intervals.overlapping(a, b, "c").collect()) == [(1, 9), (2, 9)]


def test_value_issues(spark):
    df = spark.createDataFrame([(1, "p", "ok"), (2, "p", None), (3, None, "bad")], "id int, k string, s string")
    got = training.value_issues(df, "id", "k", ["s"], {"s": ("ok", "")})
    assert rows(got) == [(2, "k is repeated"), (2, "s is empty"), (3, "k is empty"), (3, "s is not allowed: bad")]


def test_metrics(spark):
    p = spark.createDataFrame([("a", "a", 0.95), ("a", "b", 0.55), ("b", "b", 1.0), ("c", "a", 0.0)], "true_label string, predicted_label string, confidence double").withColumn("correct", F.col("true_label") == F.col("predicted_label"))
    assert rows(metrics.class_scores(p)) == [("a", 0.5, 0.5, 0.5, 2), ("b", 0.5, 1.0, 2 / 3, 1), ("c", 0.0, 0.0, 0.0, 1)]
    bins = metrics.confidence_bins(p).orderBy("bin_lower").collect()
    assert [b.row_count for b in bins] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 2] and bins[1].calibration_gap == -0.15
    assert metrics.accuracy_by_threshold(p).orderBy("confidence_threshold").collect()[-1].row_count == 1
    assert metrics.accuracy_by_threshold(p.limit(0)).count() == 21
    s = spark.createDataFrame([("x", True, 0.9), ("x", True, 0.4), ("x", False, 0.4), ("x", False, 0.1), ("y", True, 1.0)], "label string, is_positive boolean, score double")
    assert rows(metrics.one_versus_rest_auc(s)) == [("x", 2, 2, 0.875)]


def test_neighbours(spark):
    refs = spark.createDataFrame([(1, "ACGTACGTAC", "A", "k1"), (2, "ACGTACGTAA", "B", "k2"), (3, "TTTTTTTTTT", "B", "k3"), (4, None, "B", "k4")], "ref_id bigint, text string, label string, array_key string")
    asks = spark.createDataFrame([(10, "ACGTACGTAC", "k1"), (11, "ACGTACGTAC", "q"), (12, "", "q")], "row_id bigint, text string, array_key string")
    got = {r.row_id: r for r in neighbour_features(asks, refs, block=1).collect()}
    assert set(got) == {10, 11}
    assert (got[10].nearest_ref_id, got[10].neighbor_best_identity, got[10].neighbor_close_count_90) == (2, 0.9, 1)
    assert (got[11].nearest_ref_id, got[11].neighbor_best_identity, got[11].neighbor_second_identity, got[11].neighbor_subtype_entropy_90) == (1, 1.0, 0.9, 1.0)


def test_entry_needs_no_training_data_package():
    import __spark_entry__ as e
    from arrayloom.plans import registry

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert not any(m.__name__.startswith("arrayloom.llm") for m in registry._MODULES)


def test_neighbours_of_a_block():
    """A block of queries meets a block of references without a table of all their pairs; keys shut out their own rows only."""
    import tracemalloc
    from random import Random

    import pandas as pd

    from arrayloom.operators.neighbours import _compare

    r = Random(3)
    bases = ["".join(r.choices("ACGT", k=r.choice((24, 28, 36)))) for _ in range(20_000)]
    refs = pd.DataFrame({"text": bases, "label": [f"I-{k % 3}" for k in range(20_000)], "array_key": [f"k{k}" for k in range(20_000)], "n": 1, "ref_id": range(20_000)})
    asks = pd.DataFrame({"q_text": bases[:600], "q_key": [f"k{k + k % 2}" for k in range(600)]})
    tracemalloc.start()
    got = _compare(refs, asks, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 12 million pairs
    like = lambda a, b: sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))
    for k in (0, 1, 599):
        found = sorted(((-round(like(bases[k], b), 6), i) for i, b in enumerate(bases) if i != k + k % 2))[:2]
        one = got[(got["q_text"] == bases[k]) & (got["q_key"] == f"k{k + k % 2}")].iloc[0]
        assert (one["ref_id"], round(one["best"], 6), round(one["second"], 6)) == (found[0][1], -found[0][0], -found[1][0])
        assert one["votes"] == ({} if k % 2 == 0 else {f"I-{k % 3}": 1})
