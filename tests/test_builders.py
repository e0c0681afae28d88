from pyspark.sql import functions as F

from arrayloom.operators import builders


def test_caller_rows(spark):
    calls = spark.createDataFrame(
        [
            ("g", "c1", "10", "90", "acgtn", "4", "32.5", "TRUE", "I-E;I-F", "", ""),
            ("g", "c1", "10", "x", "ACGT", "", None, "False", "", "II-A", "0.95"),
            ("g", "c1", "1", "2", "ACGTX", "3", "1", "True", "I-E", "", ""),
            ("h", "c1", "1", "2", "ACGT", "3", "1", "True", "Ambiguous", "", ""),
            ("h", "c1", "1.0", "2", "ACGT", "0", "1", "false", "V-A", "", "0.5"),
        ],
        "genome_id string, Contig string, Start string, End string, Consensus_repeat string, N_repeats string, Spacer_len_avg string, Trusted string, Subtype string, Prediction string, Subtype_probability string",
    )
    manifest = spark.createDataFrame([("g", "O o", None, "complete")], "genome_id string, organism string, taxonomy string, assembly_level string")
    got = builders.from_caller(calls, manifest, {"I-E": "5prime:AWG"}).orderBy("cas_subtype").collect()
    assert [c for c in got[0].asDict()] == builders.COLUMNS
    assert [(r.cas_subtype, r.cas_type, r.spacer_count, r.label_confidence, r.pam_rule, r.array_end, r.repeat_length) for r in got] == [
        ("I-E", "Type I", 3, "high", "5prime:AWG", 90, 5), ("II-A", "Type II", 0, "high", "", None, 4), ("V-A", "Type V", 0, "medium", "", 2, 4),
    ]


def test_spacer_rows(spark):
    r = "ACGT" * 7
    data = [(s, r.lower(), "A1", "CAS-TypeIE", near, "G", "P", "") for s in ("AAAA", "AAAAAA", "AAAA") for near in ("CAS-TypeIE;CAS-TypeIF",)] + [("TT", r, "A2", "CAS-TypeIE", "x", "G", "P", ""), ("TT", r, "A3", "CAS-TypeIE", "CAS-TypeIE", "G", "P", "")]
    df = spark.createDataFrame(data, "spacers string, repeats string, accessionnrs string, subtype string, subtypesinproximity string, genus string, phylum string, PAM string")
    (one,) = builders.from_spacers(df, 5).collect()
    assert (one.genome_id, one.cas_subtype, one.spacer_count, one.cas_type) == ("A1", "I-E", 2, "Type I")


def test_loci(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = builders.from_loci(
        table([("L1", "S1", "R1", "100", "50", "4"), ("L2", "S1", "R1", "90000", "5", "4"), ("L3", "S1", "R1", "100", "50", "2"), ("L4", "S2", "R2", "1", "5", "4")], "id string, sequence string, drconsensus string, start string, length string, evidencelevel string"),
        table([("L1", "R3", "30"), ("L1", "R4", "33"), ("L1", "R1", "28")], "crisprlocus string, region string, length string"),
        table([("R1", "1", "acgt" * 7), ("R2", "1", "ACGT"), ("R3", "3", "A"), ("R4", "3", "C")], "id string, category string, sequence string"),
        table([("S1", "T1")], "id string, strain string"),
        table([("T1", "", "GB1", "complete")], "id string, refseq string, genbank string, assembly_status string"),
        table([("5", "S1", "CAS-TypeI-E", "1000", "10"), ("6", "S1", "CAS-TypeII-A", "160", "5"), ("7", "S1", "unknown", "120", "5")], "id string, sequence string, class string, start string, length string"),
    ).collect()
    assert [(r.locus, r.genome_id, r.cas_subtype, r.distance, r.spacer_count, r.mean_spacer_length) for r in got] == [("L1", "GB1", "II-A", 10, 2, 31.5)]


def test_links_and_genomes(spark):
    links = spark.createDataFrame([("a", "exact", "", 1), ("a", "reference_proxy", "p1", 2), ("a", "strain_alias", "p2", 3), ("b", "not_found", "p", 4)], "k string, linkage_status string, local_path string, o int")
    assert [r.local_path for r in builders.best_links(links, ["k"], "o", ("exact", "strain_alias", "reference_proxy")).collect()] == ["p2"]
    records = spark.createDataFrame([("f", "ACGN"), ("f", "GG"), ("e", "")], "path string, sequence string")
    got = {r.path: (r.bases, r.gc_percent, r.shares) for r in builders.genome_kmers(records, "path", 2).collect()}
    assert got == {"f": (5, 80.0, {"AC": 0.33333333, "CG": 0.33333333, "GG": 0.33333333}), "e": (0, 0.0, None)}


def test_warnings_profiles_and_promotions(spark):
    records = spark.createDataFrame([("f", "NNNN" + "A" * 20)] * 3 + [("g", "A" * 600)], "source_file string, sequence string")
    assert sorted(map(tuple, builders.fragmented(records, most=3).collect())) == [("f", "ambiguous bases"), ("f", "many records"), ("f", "mostly short records")]
    profiles = spark.createDataFrame([("I-E", [["cas3"], ["cse1", "cas8e"]]), ("II-A", [["cas9"]])], "profile string, groups array<array<string>>")
    texts = spark.createDataFrame([(1, "CAS3 and Cas8e"), (2, "cas9 cas3 cse1"), (3, "none"), (4, None)], "id int, t string")
    assert [(r.id, r.profile) for r in builders.matching_profiles(texts, "t", profiles).collect()] == [(1, "I-E")]
    c = spark.createDataFrame([("s", 1, "draft"), ("s", 2, "complete"), ("s", 3, "complete"), ("t", 4, "complete")], "strain string, o int, level string")
    got = builders.first_accepted(c, "strain", "o", [("not_complete", F.col("level") != "complete")])
    assert [r.decision for r in got.orderBy("o").collect()] == ["not_complete", "promoted", "already_promoted", "promoted"]
