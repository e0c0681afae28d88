import pytest
from pyspark.sql import functions as F

from arrayloom.functions import labels
from arrayloom.operators import evidence, interactions, models, neighbours, repeat_features, reports, training
from arrayloom.sources import sequences, sinks, tables


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_numbers_as_text(spark):
    values = [0.0, 0.5, 1.25, 123456789.0, 1e-5, 0.00012345678912, -2.5, 1e100, 12345678.0, None, float("nan"), 100.0]
    assert column(spark, values, labels.general_number, "double") == [None if v is None else f"{v:.8g}" for v in values]


def test_names(spark):
    assert column(spark, ["I-E", "type i-e", "IE", "CAS-I–E", "x", None, "III-A/B", ""], labels.subtype) == ["I-E"] * 4 + [None] * 4
    assert column(spark, ["TRUE", " yes", "1", "no", None], labels.truthy) == [True, True, True, False, False]
    assert column(spark, ["a b/c", "__x__", ""], labels.safe_name) == ["a_b_c", "x", ""]
    assert column(spark, ["12a", "12e", "a", "0.5d"], labels.without_footnote) == ["12", "12e", "a", "0.5"]
    assert column(spark, ["# Infraspecific name:  strain=K-12 \nx", "no"], labels.reported_strain) == ["K-12", ""]
    df = spark.createDataFrame([("Escherichia coli K", None), ("", "a;b; c"), (None, None), ("One", "x;y")], "o string, t string")
    assert [tuple(r) for r in df.select(labels.genus(F.col("o"), F.col("t")), labels.species(F.col("o"), F.col("t"))).collect()] == [("Escherichia", "Escherichia coli"), ("c", "c"), ("unknown", "unknown"), ("One", "One")]


def test_normalising_fills_blanks_only(spark):
    rows = [("a", "<0.01", "", "", "", "unknown"), ("b", "0.5", "=", "0.7", "low", "resistant"), ("c", "text", "", "", "", "unknown"), ("d", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "interaction_id string, raw_eop string, eop_relation string, eop_value string, eop_class string, susceptibility_label string")
    got = {r.interaction_id: r for r in interactions.normalized(df).collect()}
    assert (got["a"].eop_relation, got["a"].eop_value, got["a"].eop_class, got["a"].susceptibility_label) == ("<", "0.01", "low", "reduced_susceptibility")
    assert (got["b"].eop_value, got["b"].eop_class, got["b"].susceptibility_label) == ("0.7", "low", "resistant")
    assert (got["c"].eop_relation, got["c"].eop_value, got["c"].eop_class) == ("not_reported", "", "not_reported")
    assert got["d"].eop_relation == "not_reported" and list(interactions.normalized(df).columns) == list(interactions.COLUMNS)
    assert interactions.normalized(df.limit(0)).count() == 0


def test_issue_tables_need_columns(spark):
    with pytest.raises(ValueError, match="raw_eop"):
        interactions.interaction_issues(spark.createDataFrame([("a",)], "interaction_id string"), "interaction_id")
    link = spark.createDataFrame([("l", "phage", "s", "n", "x", "exact", "high", "", "available"), ("m", "phage", "s", "n", "x", "unresolved", "high", "A1", "not_found")], "linkage_id string, entity_type string, source_key string, display_name string, strain_or_isolate string, linkage_status string, confidence string, accession string, sequence_status string")
    got = {(r.linkage_id, r.issue) for r in interactions.link_issues(link, "linkage_id").collect()}
    assert got == {("l", "the linkage requires an accession"), ("m", "accession conflicts with sequence_status not_found")}


def test_genome_stats_reach_over_records(spark):
    rows = [("p", 0, "ACN"), ("p", 1, "G"), ("p", 2, "TTT"), ("q", 0, ""), ("r", 0, None)]
    got = {r.path: r for r in interactions.genome_stats(spark.createDataFrame(rows, "path string, record_no int, sequence string"), "path", 3).collect()}
    joined = "ACGTTT"
    for i in range(4):
        assert got["p"][f"kmer_3_{joined[i : i + 3]}_fraction"] == 0.25
    assert (got["p"].record_count, got["p"].total_bp, got["p"].ambiguous_fraction) == (3, 6, round(1 / 7, 8))
    assert got["q"].gc_percent == 0.0 and got["q"].kmer_3_AAA_fraction == 0.0


def test_genome_stats_count_without_a_row_per_kmer(spark):
    from random import Random

    r = Random(5)
    rows = [(f"p{i % 40}", i, r.choice("ACGT") + "".join(r.choices("ACGTNa", k=r.randrange(30)))) for i in range(100)] + [("runs", 0, "AAAAA"), ("runs", 1, "AAA"), ("none", 0, None)]
    got = interactions.genome_stats(spark.createDataFrame(rows, "path string, record_no int, sequence string"), "path", 2)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    wholes = {}
    for path, _, s in sorted(rows, key=lambda x: x[:2]):
        wholes[path] = wholes.get(path, "") + (s or "").upper().replace("N", "")
    found = {x.path: x.asDict() for x in got.collect()}
    assert found.keys() == wholes.keys() and found["runs"]["kmer_2_AA_fraction"] == 1.0
    for path, s in wholes.items():
        every = [s[i : i + 2] for i in range(len(s) - 1)]
        assert {k[7:9]: v for k, v in found[path].items() if k.startswith("kmer_") and v} == {x: round(every.count(x) / len(every), 8) for x in set(every)}


def test_links_of_a_crowded_name_are_chosen_before_they_meet_rows(spark):
    links = [(n, "bacterium", "s", f"b{n % 2}", "*" if n % 3 else f"x{n % 7}", ("reference_proxy", "exact", "maybe")[n % 5 % 3], f"a{n}", f"f{n}" if n % 4 else " ") for n in range(300)]
    rows = [(i, "s", f"b{i % 3}", f"x{i % 9}" if i % 4 else "*") for i in range(300)]
    of = spark.createDataFrame(links, "no int, entity_type string, source_key string, display_name string, strain_or_isolate string, linkage_status string, accession string, local_path string")
    got = interactions.chosen_links(spark.createDataFrame(rows, "row int, source_key string, name string, strain string"), of, "row", "bacterium", "name", "strain", ("exact", "reference_proxy"), "no")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")
    want = {}
    for row, _, name, strain in rows:
        met = [(x[5] != "exact", x[0], x[6]) for x in links if x[3] == name and x[4] in (strain, "*") and x[5] != "maybe" and x[7].strip()]
        if met:
            want[row] = min(met)[2]
    assert {r.row: r.link.accession for r in got.collect()} == want and len(want) == 200


def test_models_read_written_vectors(spark):
    rows = [(f"i{k}", f"p{k % 20}" if k % 11 else None, "high", "susceptible" if k % 2 else "resistant", float(k % 2)) for k in range(200)]
    df = spark.createDataFrame(rows, "interaction_id string, phage string, eop_class string, binary_susceptibility string, size double")
    got = interactions.host_baselines(df, "interaction_id", methods=("majority",))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    held = {r.grp for r in training.group_holdout(df, "phage", 0.3, 42).filter("held_out").collect()} - {None}
    assert {r.interaction_id for r in got.collect()} == {r[0] for r in rows if r[1] in held}


def test_features_baselines_and_numeric_columns(spark):
    rows = [(f"i{k}", f"p{k % 20}", "high" if k % 2 else "none", "susceptible" if k % 2 else "resistant", float(k % 2) + (k % 5) * 0.01, bool(k % 3)) for k in range(200)] + [("x", "p1", "not_reported", "susceptible", 0.0, True), ("y", "p2", "high", "unknown", 0.0, True)]
    df = spark.createDataFrame(rows, "interaction_id string, phage string, eop_class string, binary_susceptibility string, size double, flag boolean")
    assert interactions.numeric_columns(df) == ["size", "flag"]
    assert interactions.modelling_table(df).count() == 200
    for group in ("phage", None):
        got = interactions.host_baselines(df, "interaction_id", group, methods=("majority", "logistic", "forest"), trees=5).collect()
        per = {m: [r.correct for r in got if r.method == m] for m in ("majority", "logistic", "forest")}
        assert len({len(v) for v in per.values()}) == 1 and 40 <= len(per["forest"]) <= 80
        assert sum(per["forest"]) == len(per["forest"]) == sum(per["logistic"])
    with pytest.raises(ValueError, match="two classes"):
        interactions.modelling_table(df.filter("eop_class = 'high'"))


def test_links_promotions_and_overrides(spark):
    rows = [("A1", "f", "K-12", "Escherichia coli", "Escherichia coli K12", "# Infraspecific name:  strain=k12\nGenome representation: full", 1), ("A2", "f", "K-12", "Escherichia coli", "Escherichia coli K12", "# Infraspecific name:  strain=k12\nGenome representation: full", 2), ("", "f", "K", "x", "x", "", 3), ("A4", "f", "K", "coli", "other", "# Infraspecific name:  strain=k\n", 4)]
    df = spark.createDataFrame(rows, "accession string, path string, strain string, bacterium string, organism string, report string, no int")
    got = {r.no: r.decision for r in interactions.review_candidates(df, "strain", "no").collect()}
    assert got == {1: "promoted", 2: "already_promoted", 3: "accession or path is missing", 4: "organism differs"}
    hits = spark.createDataFrame([("a1", "b1"), ("a2", "b1"), ("a3", "b2")], "array_id string, bacterium string").withColumns({c: F.lit("ACGTACGTAC") for c in ("spacer", "protospacer", "flank_5p", "flank_3p", "genomic_upstream", "genomic_downstream")})
    said = spark.createDataFrame([("a1", "I-E", 0.95, "3prime:NGG"), ("a2", "I-E", 0.95, ""), ("a3", "I-E", 0.95, None)], "array_id string, cas_subtype string, confidence double, override_rule string")
    rules = spark.createDataFrame([("b1", "5prime:CCN"), ("b2", " ")], "bacterium string, rule string")
    got = {r.array_id: (r.pam_rule, r.pam_rule_source) for r in evidence.annotate(hits, said, bacterium_rules=rules).collect()}
    assert got == {"a1": ("3prime:NGG", "array_override"), "a2": ("5prime:CCN", "bacterium_override"), "a3": ("5prime:AWG", "curated_subtype_catalog")}


def test_named_features(spark):
    df = spark.createDataFrame([(1, "ACGTNACGTTTTACGGA", 3, 30.0), (2, None, None, None), (3, "", 0, float("nan")), (4, "AC", 1, 5.0)], "row_id int, repeat_sequence string, spacer_count int, mean_spacer_length double")
    names = repeat_features.names()
    assert len(names) == 708
    vectors = {r.row_id: r.features for r in repeat_features.feature_vectors(df).collect()}
    long = {}
    for r in repeat_features.long_features(df, "row_id").collect():
        long.setdefault(r.row_id, {})[r.feature] = r.value
    for row in (1, 2, 3, 4):
        assert [long[row].get(n, 0.0) for n in names] == list(vectors[row].toArray())
    assert long[1]["kmer_2_AC"] == 3 / 15 and long[1]["array_length_estimate"] == 17 * 4 + 90 and long[2]["repeat_length"] == 0


def test_named_features_of_many_rows(spark):
    """Shares are counted for batches of rows, not looked up k-mer by k-mer, and are those of the plain count."""
    from random import Random

    r = Random(4)
    texts = ["".join(r.choices("ACGTN", k=r.randrange(0, 48))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 2, 30.0) for i, t in enumerate(texts)], "row_id int, repeat_sequence string, spacer_count int, mean_spacer_length double")
    vectors = repeat_features.feature_vectors(df)
    assert "ArrowEvalPython" in vectors._jdf.queryExecution().executedPlan().toString()
    names = repeat_features.names()
    for row in vectors.collect():
        plain = row.repeat_sequence.replace("N", "")
        got = dict(zip(names, row.features.toArray()))
        for kind, of in (("kmer", plain), ("terminal_kmer", plain[:8] + plain[-8:])):
            for k in (2, 3, 4):
                every = [of[i : i + k] for i in range(len(of) - k + 1)]
                assert {n: v for n, v in got.items() if n.startswith(f"{kind}_{k}_") and v} == {f"{kind}_{k}_{x}": every.count(x) / len(every) for x in set(every)}


def test_predicted_subtypes_and_blocks(spark):
    arrays = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGTACGTAA"), (3, "TTTTTTTTTT"), (4, None), (5, "acgtacgtac")], "array_id int, repeat_consensus string")
    known = spark.createDataFrame([(9, "ACGTACGTAC", "I-E"), (3, "ACGTACGTAC", "I-F"), (4, "TTTTTTTTAA", "II-A"), (5, "", "V-A"), (6, "CCCCCCCCCC", "")], "ref_id bigint, text string, label string")
    for block in (1, 4000):
        got = {r.array_id: (r.cas_subtype, r.confidence) for r in neighbours.predicted_subtypes(arrays, known, block=block).collect()}
        assert got == {1: ("I-F", 1.0), 2: ("I-F", 0.9), 3: ("II-A", 0.8), 4: (None, None), 5: ("I-F", 1.0)}


def test_reports(spark):
    records = spark.createDataFrame([("f", "r1", "ACGT"), ("f", "r2", "AC"), ("g", "r1", "acgt")], "source_file string, record_id string, sequence string")
    files = spark.createDataFrame([("f", 1_234_567), ("h", 10)], "file_name string, bytes bigint")
    assert {tuple(r) for r in reports.file_summary(files, records).collect()} == {("f", 1.235, 2, 6, "parsed"), ("h", 0.0, 0, 0, "no FASTA records found")}
    assert {tuple(r) for r in reports.run_summary(records, records.limit(0)).collect()} == {("bacteria", 2, 3), ("phages", 0, 0)}
    assert [r.rows for r in reports.stage_table({"PAM analysis": records}).orderBy("stage_no").collect()] == [None] * 4 + [3, None]
    saved = spark.createDataFrame([("12", "99.5", "", None, "x"), ("", None, "3", "NaN", None)], "start string, identity_percent string, seed_mismatches string, cas_subtype_confidence string, strand string")
    assert [tuple(r) for r in reports.saved_hits(saved).select("start", "identity", "seed_mismatches", "cas_subtype_confidence", "strand").collect()] == [(12, 0.995, None, None, "x"), (0, 0.0, 3, None, "")]
    pairs = spark.createDataFrame([("ACGT", "ACCTT"), (None, "AC"), ("acg", "ACG")], "a string, b string")
    assert [r[0] for r in pairs.select(reports.marker_line(F.col("a"), F.col("b"))).collect()] == ["||.| ", "  ", "|||"]
    assert [r.sequence for r in reports.longest_records(records, 3, 1, "record_id").collect()][0].upper() == "ACGT"
    with pytest.raises(ValueError, match="f "):
        reports.refuse_fragmented(records, 2)
    titles = spark.createDataFrame([("E. coli, complete genome", 4_000_000), ("x complete genome shotgun", 4_000_000), ("x complete genome", 10), (None, None)], "t string, n bigint")
    assert [r[0] for r in titles.select(reports.looks_complete(F.col("t"), F.col("n"))).collect()] == [True, False, False, False]
    arrays = spark.createDataFrame([("g1", "c", 1, 90, "ACGT", 4, ["A", "C"], 1.0)], "genome_id string, contig_id string, start int, end int, repeat_consensus string, repeat_length int, spacers array<string>, mean_spacer_length double").withColumn("array_id", F.lit("a"))
    manifest = spark.createDataFrame([("g1", " ", "Type I", "I-E", "lit", "high")], "genome_id string, source string, cas_type string, cas_subtype string, label_source string, label_confidence string")
    row = reports.training_rows(arrays, manifest).first()
    assert (row.source, row.spacer_count, row.cas_subtype, row.pam_rule) == ("curated_minced", 2, "I-E", "")
    assert reports.feature_input(arrays).first().cas_subtype == ""
    assert reports.stratified(spark.range(50).select(F.col("id").alias("r"), (F.col("id") % 2).alias("l")), "l", "r", 5).count() == 10
    assert column(spark, [0, 1, 2, 7], reports.legacy_score, "int") == [0.0, 35.0, 55.0, 75.0]
    assert [r.issue for r in reports.evaluation_issues(records.limit(0), "record_id").collect()] == ["no rows"]
    named = records.withColumn("accession", F.lit("NC_1"))
    assert reports.accession_conflicts(named.withColumn("no", F.col("record_id")), "no").first().distinct_sequence_hashes == 2


def test_files_of_any_kind(spark, tmp_path):
    import gzip

    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "plain.fa").write_text(">a x\nAC\nGT\n")
    (tmp_path / "in" / "sub" / "hidden.fasta").write_bytes(gzip.compress(b">b\nTT\n>c\n\n"))
    (tmp_path / "in" / "empty.fna").write_text("")
    (tmp_path / "in" / "other.txt").write_text("x")
    got = {(r.source_file, r.record_id, r.sequence) for r in sequences.fasta_any(spark, [str(tmp_path / "in" / "plain.fa"), str(tmp_path / "in" / "sub" / "hidden.fasta")]).collect()}
    assert got == {("plain.fa", "a", "ACGT"), ("hidden.fasta", "b", "TT"), ("hidden.fasta", "c", "")}
    assert [(r.name, r.group) for r in sequences.discovered(spark, str(tmp_path / "in")).collect()] == [("plain.fa", "un_grouped"), ("hidden.fasta", "sub")]
    assert sequences.genome_records(spark, str(tmp_path / "in" / "plain.fa"), "G1").first().source_file == "G1"
    with pytest.raises(ValueError, match="no records"):
        sequences.genome_records(spark, str(tmp_path / "in" / "empty.fna"), "G2")


def test_caller_folders_and_saved_runs(spark, tmp_path):
    for genome, file, text in (("g1", "CRISPR_Cas.tab", "Contig\tSubtype\nc1\tI-E\n"), ("g1", "crisprs_all.tab", "Contig\tSubtype\nc1\tx\n"), ("g2", "crisprs_all.tab", "Contig\tSubtype\nc2\tx\nc3\tx\n")):
        (tmp_path / "calls" / genome).mkdir(parents=True, exist_ok=True)
        (tmp_path / "calls" / genome / file).write_text(text)
    manifest = spark.createDataFrame([("g1", "I-E"), ("g2", "II-A")], "genome_id string, cas_subtype string")
    got = {(r.genome_id, r.Contig, r.Subtype, r.found_in) for r in tables.caller_tables(spark, manifest, str(tmp_path / "calls")).collect()}
    assert got == {("g1", "c1", "I-E", "near_cas"), ("g2", "c2", "II-A", "all_arrays"), ("g2", "c3", "II-A", "all_arrays")}
    with pytest.raises(FileNotFoundError, match="g3"):
        tables.caller_tables(spark, manifest.union(spark.createDataFrame([("g3", "")], "a string, b string")), str(tmp_path / "calls"))
    run = str(tmp_path / "run")
    sinks.save_run(run, {"hits": manifest}, {"a": 1})
    assert set(sinks.saved_run(spark, run, ("hits",), ("arrays",))) == {"hits"}
    assert sinks.saved_run(spark, run, ("evidence",)) is None
    sinks.save_tables(run, {"audit": manifest})
    assert tables.strings(spark, run + "/audit").count() == 2
    table = tmp_path / "t.csv"
    table.write_text("source,genome_id,organism,taxonomy,assembly_level,contig_id,array_start,array_end,repeat_sequence,repeat_length,spacer_count,mean_spacer_length,cas_type,cas_subtype,label_source,label_confidence,pam_rule\ns,g,o,t,a,c,1,2,ACGT,4,1,30.0,Type I,I-E,l,high,\n")
    assert tables.training_table(spark, str(table)).count() == 1
    table.write_text(table.read_text().replace("ACGT,4", "ACGT,5"))
    with pytest.raises(ValueError, match="repeat_length"):
        tables.training_table(spark, str(table))


def test_models_are_saved_and_probed(spark, tmp_path):
    df = spark.createDataFrame([(i, "ACGT" * 6 if i % 2 else "GGCCA" * 5, "x" if i % 2 else "y") for i in range(40)], "row_id int, repeat_sequence string, label string")
    vectors = repeat_features.feature_vectors(df).select("row_id", "label", "features")
    model = models.fitted(vectors, "logistic")
    known = models.save_model(model, str(tmp_path / "m"), {"method": "logistic", "rows": 40}, spark)
    assert models.model_status(spark, str(tmp_path / "m")) == {"available": True, "hash": known, "method": "logistic", "rows": 40}
    assert models.model_status(spark, str(tmp_path / "none"))["available"] is False
    again = models.load_model(str(tmp_path / "m")).transform(vectors)
    assert again.filter("prediction = index").count() == 40
    numbers = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(100)], "row_id int, a double, b double")
    accuracy = lambda d: d.filter("a = row_id % 7").count() / 100
    got = {c: (m, s) for c, m, s in models.permutation_importance(numbers, accuracy, ["a", "b"], 2)}
    assert got["a"][0] > 0.5 and got["b"] == (0.0, 0.0)
