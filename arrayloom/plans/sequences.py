"""Sequence queries: arrays, spacers, hits and evidence, over DNA that is derived from the download registry.

The registry names bacterial and phage records but holds no sequences, so they
are spelt from digests of its ids, by expressions that Spark and the checking
SQL both understand: a bacterium has one array of four repeats and three
spacers, shared within a class of records, and a phage of the class (its id is one less) carries
these spacers forwards, backwards and with two exchanged bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions.dna import reverse_complement
from arrayloom.operators import builders, detect, evidence, matching, neighbours, pam
from arrayloom.plans.training import _LAB, labelled
from arrayloom.runtime import table, written

CLASSES = 997
SUBTYPES = ("I-E", "I-F", "I-A", "II-A", "V-A", "III-B", "")


def dna(text: Column) -> Column:
    """32 bases spelt from a digest."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def _join(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def bacteria(spark: SparkSession, folder: str, registry: DataFrame | None = None, *more: str) -> DataFrame:
    """(genome_id, contig_id, record_no, sequence, bacterium) of bacterial records, and more columns of the registry."""
    rid = F.col("record_id")
    cls = rid % CLASSES
    repeat = F.substring(dna(_join("r", rid % 5)), 1, 28)
    spacer = [dna(_join("c", cls, "s", F.lit(i))) for i in (1, 2, 3)]
    sequence = F.concat(dna(_join("a", rid)), repeat, spacer[0], repeat, spacer[1], repeat, spacer[2], repeat, dna(_join("z", rid)))
    rows = (registry or table(spark, folder, "downloaded_records")).filter("record_type = 'bacterium'")
    return rows.select(_join("b", rid).alias("genome_id"), F.lit("c1").alias("contig_id"), rid.alias("record_no"), sequence.alias("sequence"), _join("strain_", rid % 40).alias("bacterium"), *more)


def phages(spark: SparkSession, folder: str, registry: DataFrame | None = None, *more: str) -> DataFrame:
    """(phage_id, phage_contig, record_no, sequence, phage) of phage records, and more columns of the registry."""
    rid = F.col("record_id")
    cls = (rid + 1) % CLASSES
    one, two, three = (dna(_join("c", cls, "s", F.lit(i))) for i in (1, 2, 3))
    worn = F.concat(F.substring(three, 1, 11), F.translate(F.substring(three, 12, 1), "ACGT", "CGTA"), F.substring(three, 13, 9), F.translate(F.substring(three, 22, 1), "ACGT", "CGTA"), F.substring(three, 23, 10))
    sequence = F.concat(dna(_join("f", rid)), one, dna(_join("g", rid)), reverse_complement(two), dna(_join("h", rid)), worn, dna(_join("i", rid)))
    rows = (registry or table(spark, folder, "downloaded_records")).filter("record_type = 'phage'")
    return rows.select(_join("p", rid).alias("phage_id"), F.lit("c1").alias("phage_contig"), rid.alias("record_no"), sequence.alias("sequence"), _join("clade_", rid % 30).alias("phage"), *more)


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    # the registry is one small file: its records are dealt out before their DNA is looked at
    dealt = bacteria(spark, folder).select("genome_id", "contig_id", "record_no", "sequence").repartition(spark.sparkContext.defaultParallelism)
    return detect.detect_arrays(dealt)


def seq_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return _arrays(spark, folder).select("array_id", "genome_id", "start", "end", "repeat_consensus", "repeat_length", "repeat_count", F.array_join("spacers", ",").alias("spacers"), "mean_spacer_length")


def seq_spacers(spark: SparkSession, folder: str) -> DataFrame:
    return detect.spacer_table(_arrays(spark, folder)).drop("contig_id")


def long_bacteria(spark: SparkSession, folder: str) -> DataFrame:
    """One contig per strain: the contigs of its records in order, in one sequence of several tiles; arrays run on from one to the next but for every third."""
    rows = bacteria(spark, folder).groupBy("bacterium").agg(F.sort_array(F.collect_list(F.struct("record_no", "sequence"))).alias("all"))
    return rows.select(F.col("bacterium").alias("genome_id"), F.lit("c1").alias("contig_id"), F.lit(0).cast("bigint").alias("record_no"), F.array_join(F.transform("all", lambda x: F.concat(x["sequence"], F.when(x["record_no"] % 3 == 0, dna(_join("j", x["record_no"]))).otherwise(""))), "").alias("sequence"))


def long_phages(spark: SparkSession, folder: str) -> DataFrame:
    """One sequence per clade, of all its records."""
    rows = phages(spark, folder).groupBy("phage").agg(F.sort_array(F.collect_list(F.struct("record_no", "sequence"))).alias("all"))
    return rows.select(F.col("phage").alias("phage_id"), F.lit("c1").alias("phage_contig"), F.array_join(F.transform("all", lambda x: x["sequence"]), "").alias("sequence"))


def seq_long_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Detection in contigs that hold many arrays with the same few repeats."""
    return detect.detect_arrays(long_bacteria(spark, folder)).select("array_id", "genome_id", "start", "end", "repeat_consensus", "repeat_count", F.array_join("spacers", ",").alias("spacers"))


def _mixed_spacers(spark: SparkSession, folder: str) -> DataFrame:
    """The first spacers of all records, cut to 32, 21, 13 and 7 bases in turn."""
    rid = F.col("record_no")
    cut = F.element_at(F.array(F.lit(32), F.lit(21), F.lit(13), F.lit(7)), (rid % 4 + 1).cast("int"))
    return bacteria(spark, folder).select("record_no", F.concat("genome_id", F.lit("|1")).alias("spacer_id"), dna(_join("c", rid % CLASSES, "s", F.lit(1))).substr(F.lit(1), cut).alias("spacer"))


def hit_long_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Spacers of several lengths, short ones too, in sequences of several tiles."""
    return matching.exact_hits(_mixed_spacers(spark, folder), long_phages(spark, folder)).drop("phage_contig")


def hit_long_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    """Spacers of 32 and 21 bases within two mismatches, in the same sequences."""
    some = _mixed_spacers(spark, folder).filter(F.length("spacer") > 13)
    return matching.fuzzy_hits(some, long_phages(spark, folder), max_mismatches=2).drop("phage_contig")


def _known_spacers(spark: SparkSession, folder: str) -> DataFrame:
    """The spacers as they were laid into the records, for queries that start after detection."""
    rid = F.col("record_no")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), dna(_join("c", rid % CLASSES, "s", F.lit(i))).alias("spacer")) for i in (1, 2, 3)]))
    rows = bacteria(spark, folder).select("genome_id", "record_no", "bacterium", each.alias("x"))
    array_id = F.concat("genome_id", F.lit("|c1|array_1"))
    return rows.select(array_id.alias("array_id"), F.concat(array_id, F.lit("|spacer_"), F.col("x.i").cast("string")).alias("spacer_id"), "record_no", "bacterium", "x.spacer")


def hit_exact(spark: SparkSession, folder: str) -> DataFrame:
    return matching.exact_hits(_known_spacers(spark, folder), phages(spark, folder)).drop("phage_contig")


def hit_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return matching.fuzzy_hits(_known_spacers(spark, folder), phages(spark, folder)).drop("phage_contig")


def _flanked_texts(spacers: DataFrame, target: DataFrame) -> DataFrame:
    """Exact places of the different texts own of spacers, with flanks and the phage's name: no row per spacer."""
    places = matching.with_flanks(matching.exact_places(spacers.select(F.upper("spacer").alias("own")), target), target)
    return places.join(target.select("phage_id", "phage"), "phage_id")


def _flanked(spark: SparkSession, folder: str) -> DataFrame:
    spacers, target = _known_spacers(spark, folder), phages(spark, folder)
    hits = matching.with_flanks(matching.exact_hits(spacers, target), target)
    return hits.join(spacers, "spacer_id").join(target.select("phage_id", "phage"), "phage_id")


def hit_flanks(spark: SparkSession, folder: str) -> DataFrame:
    return _flanked(spark, folder).select("spacer_id", "phage_id", "strand", "start", "protospacer", "genomic_upstream", "genomic_downstream", "flank_5p", "flank_3p")


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    rid = F.col("record_no")
    subtype = F.element_at(F.array(*[F.lit(s) for s in SUBTYPES]), (rid % len(SUBTYPES) + 1).cast("int"))
    rows = bacteria(spark, folder)
    return rows.select(F.concat("genome_id", F.lit("|c1|array_1")).alias("array_id"), F.when(subtype != "", subtype).alias("cas_subtype"), ((rid % 21) / 20.0).alias("confidence"))


def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.annotate(_flanked(spark, folder), _predictions(spark, folder)).withColumns({"identity": F.lit(1.0), "coverage": F.lit(1.0)})


def pam_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Every curated rule, a nonsense one and a too long one over the flanks of every hit."""
    rules = F.explode(F.array(*[F.lit(r) for r in (*pam.CURATED_RULES.values(), "sideways:NGG", "3prime:NNNNNNNNNNNN", "downstream: n g g")]))
    spacers, target = _known_spacers(spark, folder), phages(spark, folder)
    # flanks are judged once per text; ids are put back last
    rows = _flanked_texts(spacers, target).repartition("own").withColumn("rule", rules)
    judged = pam.with_evaluation(rows, F.col("rule"), "flank_5p", "flank_3p", "genomic_upstream", "genomic_downstream", "e")
    return judged.join(spacers.select("spacer_id", F.upper("spacer").alias("own")), "own").select("spacer_id", "phage_id", "strand", "start", "rule", "e.*")


def hit_annotated(spark: SparkSession, folder: str) -> DataFrame:
    return _annotated(spark, folder).select(
        "spacer_id", "phage_id", "strand", "start", "cas_subtype", "pam_rule", "pam_rule_source", "pam_match", "pam_support_level", "pam_compatibility_score", "pam_offset", "seed_region", "seed_mismatches"
    )


def pam_subtype_support(spark: SparkSession, folder: str) -> DataFrame:
    spacers = _known_spacers(spark, folder).withColumn("own", F.upper("spacer"))
    return evidence.subtype_support_of_texts(_flanked_texts(spacers, phages(spark, folder)), spacers, _predictions(spark, folder))


def matrix_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.pair_evidence(_annotated(spark, folder))


def matrix_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.evidence_matrix(_annotated(spark, folder), bacteria(spark, folder), phages(spark, folder))


def matrix_top_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.top_pairs(matrix_pairs(spark, folder)).select("bacterium", "phage", "crispr_targeting_score", "unique_matching_spacers", "spacer_hits")


def matrix_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    clades = [f"clade_{i}" for i in range(30)]
    return evidence.heatmap(matrix_evidence(spark, folder), clades)


def hit_targeting_features(spark: SparkSession, folder: str) -> DataFrame:
    spacers, target = _known_spacers(spark, folder), phages(spark, folder)
    hits = matching.fuzzy_hits(spacers, target).join(spacers.select("spacer_id", "bacterium"), "spacer_id").join(target.select("phage_id", "phage"), "phage_id")
    return evidence.targeting_features(hits)


def seq_genome_kmers(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of 2-mers in all contigs of a strain."""
    rows = builders.genome_kmers(bacteria(spark, folder), "bacterium", 2)
    return rows.select("bacterium", "bases", "gc_percent", F.explode("shares").alias("kmer", "share"))


def seq_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays, spacers and bases per strain, from detection on."""
    arrays = _arrays(spark, folder).groupBy("genome_id").agg(F.count("*").alias("arrays"), F.sum(F.size("spacers")).alias("spacers"))
    rows = bacteria(spark, folder).join(arrays, "genome_id", "left")
    return rows.groupBy("bacterium").agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("bases"), F.coalesce(F.sum("arrays"), F.lit(0)).alias("arrays"), F.coalesce(F.sum("spacers"), F.lit(0)).alias("spacers"))


#: Subtypes of the five repeats that arrays are laid with; the last two stand in the training table with another last base.
PLANTED = ("I-E", "I-F", "I-A", "II-A", "V-A")


def _known_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """(ref_id, text, label): all labelled training repeats, and one for each repeat that arrays are laid with."""
    known = labelled(spark, folder).filter("split = 'train'").select(F.col("row_id").alias("ref_id"), F.col("repeat_sequence").alias("text"), F.col("cas_subtype").alias("label"))
    k = F.col("id")
    repeat = F.substring(dna(_join("r", k)), 1, 28)
    last = F.when(k > 2, F.translate(F.right(repeat, F.lit(1)), "ACGT", "CGTA")).otherwise(F.right(repeat, F.lit(1)))
    planted = spark.range(len(PLANTED)).select((k - 10).alias("ref_id"), F.concat(F.left(repeat, F.lit(27)), last).alias("text"), F.element_at(F.array(*[F.lit(x) for x in PLANTED]), (k + 1).cast("int")).alias("label"))
    return known.unionByName(planted)


def seq_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The subtype of every detected array from its nearest labelled repeat."""
    return neighbours.predicted_subtypes(_arrays(spark, folder).select("array_id", "repeat_consensus"), _known_repeats(spark, folder))


def detected_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: detection, prediction of subtypes, exact matching, annotation, scored pairs."""
    found = written(_arrays(spark, folder), "arrays")
    arrays = written(detect.spacer_table(found), "spacers")
    said = neighbours.predicted_subtypes(found.select("array_id", "repeat_consensus"), _known_repeats(spark, folder))
    named = arrays.join(bacteria(spark, folder).select("genome_id", "bacterium"), "genome_id").join(said, "array_id", "left")
    spacers = named.select("spacer_id", F.upper("spacer").alias("own"), "bacterium", "cas_subtype", "confidence")
    return evidence.pair_evidence_of_texts(_flanked_texts(arrays, phages(spark, folder)), spacers)


QUERIES = {
    f.__name__: f
    for f in (seq_predictions, seq_long_arrays, hit_long_exact, hit_long_fuzzy, seq_arrays, seq_spacers, hit_exact, hit_fuzzy, hit_flanks, pam_evaluations, hit_annotated, pam_subtype_support, matrix_pairs, matrix_evidence, matrix_top_pairs, matrix_heatmap, hit_targeting_features, seq_genome_kmers, seq_composition, detected_matrix)
}

_DNA = "translate(md5({0}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _d(expr: str) -> str:
    return _DNA.format(expr)


_S = [_d(f"'c' || (record_id % {CLASSES}) || 's{i}'") for i in (1, 2, 3)]
_P = [_d(f"'c' || ((record_id + 1) % {CLASSES}) || 's{i}'") for i in (1, 2, 3)]
_R = f"substr({_d(chr(39) + 'r' + chr(39) + ' || (record_id % 5)')}, 1, 28)"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


def _even(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}.0, 0) / {10**digits}.0"


DATA_SQL = f"""bact AS (SELECT record_id, 'b' || record_id AS genome_id, 'strain_' || (record_id % 40) AS bacterium, {_S[0]} AS s1, {_S[1]} AS s2, {_S[2]} AS s3, {_R} AS r,
    {_d("'a' || record_id")} AS fa, {_d("'z' || record_id")} AS fz FROM downloaded_records WHERE record_type = 'bacterium'),
  phag AS (SELECT 'p' || record_id AS phage_id, 'clade_' || (record_id % 30) AS phage,
    {_d("'f' || record_id")} || {_P[0]} || {_d("'g' || record_id")} || {_rc(_P[1])} || {_d("'h' || record_id")}
    || substr({_P[2]}, 1, 11) || translate(substr({_P[2]}, 12, 1), 'ACGT', 'CGTA') || substr({_P[2]}, 13, 9) || translate(substr({_P[2]}, 22, 1), 'ACGT', 'CGTA') || substr({_P[2]}, 23, 10)
    || {_d("'i' || record_id")} AS seq FROM downloaded_records WHERE record_type = 'phage'),
  spac AS (SELECT genome_id || '|c1|array_1' AS array_id, genome_id || '|c1|array_1|spacer_' || i AS spacer_id, record_id, bacterium, spacer
    FROM (SELECT *, unnest([1, 2, 3]) AS i, unnest([s1, s2, s3]) AS spacer FROM bact)),
  strands AS (SELECT spacer_id, spacer AS query, '+' AS strand FROM spac UNION ALL SELECT spacer_id, {_rc('spacer')}, '-' FROM spac WHERE {_rc('spacer')} <> spacer)"""

# Brute force: every window of every length, without the shortest-window filter.
_ARRAYS = f"""{DATA_SQL},
  recs AS (SELECT genome_id, fa || r || s1 || r || s2 || r || s3 || r || fz AS seq FROM bact),
  reps AS (SELECT genome_id, seq, size, p AS pos, substr(seq, p + 1, size) AS rep FROM recs, range(23, 48) l(size), range(0, 240) w(p) WHERE p + size <= length(seq)),
  often AS (SELECT *, count(*) OVER (PARTITION BY genome_id, rep) AS n, min(pos) OVER (PARTITION BY genome_id, rep) AS first_at,
    pos - lag(pos) OVER (PARTITION BY genome_id, rep ORDER BY pos) - size AS gap FROM reps),
  good AS (SELECT *, sum(CASE WHEN gap BETWEEN 20 AND 72 THEN 0 ELSE 1 END) OVER (PARTITION BY genome_id, rep ORDER BY pos) AS chain FROM often WHERE n >= 3
    AND greatest(size - length(replace(rep, 'A', '')), size - length(replace(rep, 'C', '')), size - length(replace(rep, 'G', '')), size - length(replace(rep, 'T', ''))) / size <= 0.8
    AND (size - length(translate(rep, 'GC', ''))) / size BETWEEN 0.2 AND 0.8),
  chains AS (SELECT genome_id, seq, rep, size, first_at, list(pos ORDER BY pos) AS places FROM good GROUP BY genome_id, seq, rep, size, first_at, chain HAVING count(*) >= 3),
  cands AS (SELECT genome_id, seq, list({{'few': -len(places), 'short': places[1] + 1 - (places[len(places)] + size), 'narrow': -size, 'first_at': first_at, 's': places[1] + 1, 'e': places[len(places)] + size, 'rep': rep, 'places': places}}
    ORDER BY -len(places), places[1] + 1 - (places[len(places)] + size), -size, first_at, places[1]) AS cs FROM chains GROUP BY genome_id, seq),
  kept AS (SELECT genome_id, seq, unnest(list_reduce(list_transform(cs, lambda c: [c]), lambda acc, c:
    CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(c[1].e, k.e) - greatest(c[1].s, k.s) + 1) / least(c[1].e - c[1].s + 1, k.e - k.s + 1) > 0.5)) > 0 THEN acc ELSE list_concat(acc, c) END)) AS c FROM cands),
  arrays AS (SELECT genome_id, genome_id || '|c1|array_' || row_number() OVER (PARTITION BY genome_id ORDER BY c.s, c.e) AS array_id, c.s AS start, c.e AS "end", c.rep AS repeat_consensus, length(c.rep) AS repeat_length,
    len(c.places) AS repeat_count, list_transform(range(1, len(c.places)), lambda i: substr(seq, c.places[i] + length(c.rep) + 1, c.places[i + 1] - c.places[i] - length(c.rep))) AS spacers FROM kept)"""

_HITS = f"""{DATA_SQL},
  hits AS (SELECT spacer_id, phage_id, phage, seq, query, strand, p + 1 AS start, p + length(query) AS "end" FROM (SELECT *, unnest(range(0, 300)) AS p FROM strands JOIN phag ON contains(seq, query)) WHERE substr(seq, p + 1, length(query)) = query),
  flanked AS (SELECT *, substr(seq, greatest(start - 10, 1), start - greatest(start - 10, 1)) AS up, substr(seq, "end" + 1, 10) AS down FROM hits),
  placed AS (SELECT *, CASE WHEN strand = '-' THEN {_rc('query')} ELSE query END AS protospacer, CASE WHEN strand = '-' THEN {_rc('down')} ELSE up END AS flank_5p, CASE WHEN strand = '-' THEN {_rc('up')} ELSE down END AS flank_3p FROM flanked)"""

# Rules as (side, motif, regular expression per motif letter).
_LETTERS = {"A": "[A]", "C": "[C]", "G": "[G]", "T": "[T]", "W": "[AT]", "N": "[ACGT]"}


def _rules(rules) -> str:
    rows = []
    for rule, side, motif in rules:
        rx = "".join(_LETTERS[m] for m in motif) if side else ""
        rows.append(f"('{rule}', '{side}', '{motif}', '^{rx}$')")
    return "rules(rule, side, motif, rx) AS (VALUES " + ", ".join(rows) + ")"


_CURATED = (("5prime:AWG", "5", "AWG"), ("genomic_3prime:GG", "g3", "GG"), ("5prime:CCN", "5", "CCN"), ("3prime:NGG", "3", "NGG"), ("5prime:TTTN", "5", "TTTN"))
_ALL_RULES = (*_CURATED, ("sideways:NGG", "", "NGG"), ("3prime:NNNNNNNNNNNN", "3", "N" * 12), ("downstream: n g g", "3", "NGG"))

_JUDGE = """tried AS (SELECT *, CASE side WHEN '5' THEN flank_5p WHEN '3' THEN flank_3p WHEN 'g5' THEN up WHEN 'g3' THEN down ELSE '' END AS flank, length(motif) AS k FROM {0}),
  windowed AS (SELECT *, list_transform(range(0, greatest(length(flank) - k, 0) + 1), lambda i: CASE WHEN side IN ('5', 'g5') THEN substr(flank, length(flank) - k - i + 1, k) ELSE substr(flank, i + 1, k) END) AS wins FROM tried),
  located AS (SELECT *, list_filter(range(0, len(wins)), lambda i: regexp_matches(wins[i + 1], rx))[1] AS pos FROM windowed),
  chosen AS (SELECT *, wins[coalesce(pos, 0) + 1] AS win FROM located),
  judged AS (SELECT *, CASE WHEN side = '' THEN '' WHEN length(flank) < k THEN flank ELSE win END AS pam_sequence,
    CASE WHEN side = '' OR length(flank) < k THEN NULL ELSE pos IS NOT NULL END AS pam_match,
    CASE WHEN side = '' THEN 'invalid_rule' WHEN length(flank) < k THEN 'insufficient_flank' WHEN pos = 0 THEN 'compatible' WHEN pos > 0 THEN 'compatible_nearby' ELSE 'not_supported' END AS support,
    CASE WHEN side <> '' AND length(flank) >= k THEN round_even(list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN (substr(motif, i, 1) IN ('N', substr(win, i, 1))) OR (substr(motif, i, 1) = 'W' AND substr(win, i, 1) IN ('A', 'T')) THEN 1.0 ELSE 0.0 END)) / k * 1000000.0, 0) / 1000000.0 END AS score,
    CASE WHEN side <> '' AND length(flank) >= k THEN coalesce(pos, 0) END AS "offset" FROM chosen)"""

_PRED_RULE = f"pred AS (SELECT genome_id || '|c1|array_1' AS array_id, nullif([{', '.join(f"'{s}'" for s in SUBTYPES)}][record_id % {len(SUBTYPES)} + 1], '') AS cas_subtype, (record_id % 21) / 20.0 AS confidence FROM bact)"
# Brute force: every different detected repeat against all training repeats and those that arrays are laid with.
_NEAREST = f"""{_ARRAYS[len(DATA_SQL) + 1:]}, {_LAB}, five AS (SELECT k, substr({_d("'r' || k")}, 1, 28) AS t FROM range(0, 5) r(k)), asked AS (SELECT DISTINCT repeat_consensus AS q FROM arrays),
  refs AS (SELECT row_id AS ref_id, repeat_sequence AS t, cas_subtype AS label FROM cur UNION ALL SELECT k - 10, left(t, 27) || CASE WHEN k > 2 THEN translate(right(t, 1), 'ACGT', 'CGTA') ELSE right(t, 1) END, {list(PLANTED)}[k + 1] FROM five),
  alike AS (SELECT q, ref_id, label, round_even((least(length(q), length(t)) - hamming(substr(q, 1, least(length(q), length(t))::BIGINT), substr(t, 1, least(length(q), length(t))::BIGINT))) / greatest(length(q), length(t)) * 1000000.0, 0) / 1000000.0 AS i FROM asked, refs),
  top AS (SELECT q, label, i FROM alike QUALIFY row_number() OVER (PARTITION BY q ORDER BY i DESC, ref_id) = 1), nearest AS (SELECT array_id, label AS cas_subtype, i AS confidence FROM arrays JOIN top ON q = repeat_consensus)"""
_SUBTYPE_LIST = "[" + ", ".join(f"'{s}'" for s in SUBTYPES) + "]"
_ANNOTATED = f"""{_HITS}, {_rules(_CURATED)},
  subs(cas_subtype, rule) AS (VALUES ('I-E', '5prime:AWG'), ('I-F', 'genomic_3prime:GG'), ('I-A', '5prime:CCN'), ('II-A', '3prime:NGG'), ('V-A', '5prime:TTTN')),
  pred AS (SELECT genome_id || '|c1|array_1' AS array_id, nullif({_SUBTYPE_LIST}[record_id % {len(SUBTYPES)} + 1], '') AS cas_subtype, (record_id % 21) / 20.0 AS confidence FROM bact),
  ruled AS (SELECT placed.*, spac.array_id, spac.bacterium, spac.spacer, pred.cas_subtype, pred.confidence, CASE WHEN confidence >= 0.9 THEN subs.rule END AS pam_rule
    FROM placed JOIN spac USING (spacer_id) LEFT JOIN pred USING (array_id) LEFT JOIN subs ON subs.cas_subtype = pred.cas_subtype),
  withrule AS (SELECT ruled.*, coalesce(rules.side, 'none') AS side, coalesce(rules.motif, '') AS motif, coalesce(rules.rx, '') AS rx FROM ruled LEFT JOIN rules ON rules.rule = ruled.pam_rule),
  {_JUDGE.format('withrule')},
  ann AS (SELECT * EXCLUDE (pam_match, score, "offset", support), CASE WHEN pam_rule IS NULL THEN 'not_evaluated' ELSE support END AS pam_support_level,
    CASE WHEN pam_rule IS NOT NULL THEN pam_match END AS pam_match, CASE WHEN pam_rule IS NOT NULL THEN score END AS pam_compatibility_score, CASE WHEN pam_rule IS NOT NULL THEN "offset" END AS pam_offset,
    CASE WHEN pam_rule IS NOT NULL THEN CASE WHEN side = '5' THEN '5prime:1-8' ELSE '3prime:25-32' END END AS seed_region, CASE WHEN pam_rule IS NOT NULL THEN 0 END AS seed_mismatches FROM judged)"""

_EVIDENCE = f"""{_ANNOTATED},
  agg AS (SELECT bacterium, phage, count(*) AS spacer_hits, count(DISTINCT spacer_id) AS n, count(*) FILTER (pam_match) AS sup, count(pam_match) AS ev, max(pam_compatibility_score) AS best,
    sum(CAST(round_even(pam_compatibility_score * 1000000.0, 0) AS BIGINT)) / (count(pam_compatibility_score) * 1000000.0) AS mean, count(seed_mismatches) AS se, min(seed_mismatches) AS seed, max(confidence) AS conf FROM ann GROUP BY ALL),
  scored AS (SELECT *, {_even("least(CASE WHEN sup = 0 AND ev > 0 THEN 39.0 ELSE 100.0 END, greatest(0.0, least(35.0, log2(n + 1) * 18.0) + 25.0 + CASE WHEN sup > 0 THEN 20.0 WHEN ev > 0 THEN -25.0 ELSE 0.0 END + CASE WHEN sup > 0 AND seed = 0 THEN 10.0 ELSE 0.0 END + greatest(0.0, least(10.0, conf * 10.0))))", 2)} AS score,
    {_even("least(CASE WHEN best IS NULL OR best >= 1 THEN 100.0 WHEN best >= 0.75 THEN 70.0 WHEN best >= 0.5 THEN 55.0 ELSE 39.0 END, greatest(0.0, least(35.0, log2(n + 1) * 18.0) + 25.0 + coalesce(" + _even("20.0 * best + 10.0 * mean - 15.0", 6) + ", 0.0) + CASE WHEN best >= 1 AND seed = 0 THEN 10.0 ELSE 0.0 END + greatest(0.0, least(10.0, conf * 10.0))))", 2)} AS wscore FROM agg),
  pairs AS (SELECT bacterium, phage, score AS crispr_targeting_score, wscore AS experimental_pam_weighted_score, spacer_hits, n AS unique_matching_spacers, CAST(100 AS DOUBLE) AS best_identity_percent, CAST(100 AS DOUBLE) AS best_coverage_percent,
    sup AS pam_supported_hits, ev AS pam_evaluated_hits, CASE WHEN sup > 0 THEN 'compatible' WHEN ev > 0 THEN 'not_supported' ELSE 'not_evaluated' END AS pam_support_level, {_even('best', 6)} AS best_pam_compatibility_score,
    {_even('mean', 6)} AS mean_pam_compatibility_score, se AS seed_evaluated_hits, seed AS best_seed_mismatches,
    CASE WHEN score >= 75 THEN 'strong candidate CRISPR targeting evidence' WHEN score >= 50 THEN 'moderate candidate CRISPR targeting evidence' WHEN score > 0 THEN 'weak candidate CRISPR targeting evidence' ELSE 'no spacer-match evidence' END AS current_evidence_level FROM scored)"""

_GRID = f"""{_EVIDENCE}, grid AS (SELECT * FROM (SELECT DISTINCT bacterium FROM bact), (SELECT DISTINCT phage FROM phag)),
  matrix AS (SELECT bacterium, phage, coalesce(crispr_targeting_score, 0) AS crispr_targeting_score, coalesce(experimental_pam_weighted_score, 0) AS experimental_pam_weighted_score, coalesce(spacer_hits, 0) AS spacer_hits,
    coalesce(unique_matching_spacers, 0) AS unique_matching_spacers, coalesce(best_identity_percent, 0) AS best_identity_percent, coalesce(best_coverage_percent, 0) AS best_coverage_percent, coalesce(pam_supported_hits, 0) AS pam_supported_hits,
    coalesce(pam_evaluated_hits, 0) AS pam_evaluated_hits, coalesce(pam_support_level, 'not_applicable') AS pam_support_level, best_pam_compatibility_score, mean_pam_compatibility_score, coalesce(seed_evaluated_hits, 0) AS seed_evaluated_hits,
    best_seed_mismatches, coalesce(current_evidence_level, 'no spacer-match evidence') AS current_evidence_level FROM grid LEFT JOIN pairs USING (bacterium, phage))"""

_FUZZY = f"""{DATA_SQL}, cand AS (SELECT spacer_id, phage_id, phage, query, strand, p, substr(seq, p + 1, 32) AS there FROM strands, phag, range(0, 193) w(p) WHERE hamming(query, substr(seq, p + 1, 32)) <= 4),
  meas AS (SELECT *, hamming(query, there) AS mm, least(hamming(substr(query, 1, 8), substr(there, 1, 8)), hamming(substr(query, 25, 8), substr(there, 25, 8))) AS edge FROM cand),
  near AS (SELECT *, row_number() OVER (PARTITION BY spacer_id ORDER BY mm, edge, phage_id, strand, p) AS place FROM meas WHERE 1 - mm / 32.0 >= 0.85),
  fuzzy AS (SELECT spacer_id, phage_id, phage, strand, p + 1 AS start, p + 32 AS "end", 1 - mm / 32.0 AS identity, mm AS mismatches, 32 AS spacer_length, edge AS edge_mismatches, mm - edge AS distal_mismatches FROM near WHERE place <= 5)"""

_LONG = f"""{DATA_SQL}, recs AS (SELECT bacterium AS genome_id, string_agg(fa || r || s1 || r || s2 || r || s3 || r || fz || CASE WHEN record_id % 3 = 0 THEN {_d("'j' || record_id")} ELSE '' END, '' ORDER BY record_id) AS seq FROM bact GROUP BY 1),
  places AS (SELECT genome_id, seq, unnest(range(0, length(seq) - 22)) AS pos FROM recs),
  reps AS (SELECT genome_id, size, pos, substr(seq, pos + 1, size) AS rep FROM places, range(23, 48) l(size) WHERE pos + size <= length(seq)),
  often AS (SELECT *, count(*) OVER (PARTITION BY genome_id, rep) AS n, min(pos) OVER (PARTITION BY genome_id, rep) AS first_at, pos - lag(pos) OVER (PARTITION BY genome_id, rep ORDER BY pos) - size AS gap FROM reps),
  good AS (SELECT *, sum(CASE WHEN gap BETWEEN 20 AND 72 THEN 0 ELSE 1 END) OVER (PARTITION BY genome_id, rep ORDER BY pos) AS chain FROM often WHERE n >= 3
    AND greatest(size - length(replace(rep, 'A', '')), size - length(replace(rep, 'C', '')), size - length(replace(rep, 'G', '')), size - length(replace(rep, 'T', ''))) / size <= 0.8
    AND (size - length(translate(rep, 'GC', ''))) / size BETWEEN 0.2 AND 0.8),
  chains AS (SELECT genome_id, rep, size, first_at, list(pos ORDER BY pos) AS places FROM good GROUP BY genome_id, rep, size, first_at, chain HAVING count(*) >= 3),
  cands AS (SELECT genome_id, list({{'few': -len(places), 'short': places[1] + 1 - (places[len(places)] + size), 'narrow': -size, 'first_at': first_at, 's': places[1] + 1, 'e': places[len(places)] + size, 'rep': rep, 'places': places}}
    ORDER BY -len(places), places[1] + 1 - (places[len(places)] + size), -size, first_at, places[1]) AS cs FROM chains GROUP BY genome_id),
  kept AS (SELECT genome_id, unnest(list_reduce(list_transform(cs, lambda c: [c]), lambda acc, c:
    CASE WHEN len(list_filter(acc, lambda k: greatest(0, least(c[1].e, k.e) - greatest(c[1].s, k.s) + 1) / least(c[1].e - c[1].s + 1, k.e - k.s + 1) > 0.5)) > 0 THEN acc ELSE list_concat(acc, c) END)) AS c FROM cands),
  arrays AS (SELECT genome_id, genome_id || '|c1|array_' || row_number() OVER (PARTITION BY genome_id ORDER BY c.s, c.e) AS array_id, c FROM kept)"""
_MIXED = f"""{DATA_SQL}, clades AS (SELECT phage AS phage_id, string_agg(seq, '' ORDER BY CAST(substr(phage_id, 2) AS BIGINT)) AS seq FROM phag GROUP BY 1),
  cut AS (SELECT genome_id || '|1' AS spacer_id, substr(s1, 1, [32, 21, 13, 7][record_id % 4 + 1]) AS spacer FROM bact),
  both_strands AS (SELECT spacer_id, spacer AS query, '+' AS strand FROM cut UNION ALL SELECT spacer_id, {_rc('spacer')}, '-' FROM cut WHERE {_rc('spacer')} <> spacer),
  wins AS (SELECT phage_id, p, n, substr(seq, p + 1, n) AS there FROM (SELECT phage_id, seq, unnest(range(0, length(seq))) AS p FROM clades), (VALUES (32), (21), (13), (7)) l(n) WHERE p + n <= length(seq))"""
ORACLE = {
    "seq_long_arrays": f"""WITH {_LONG} SELECT array_id, a.genome_id, c.s AS start, c.e AS "end", c.rep AS repeat_consensus, len(c.places) AS repeat_count,
      array_to_string(list_transform(range(1, len(c.places)), lambda i: substr(seq, c.places[i] + length(c.rep) + 1, c.places[i + 1] - c.places[i] - length(c.rep))), ',') AS spacers FROM arrays a JOIN recs USING (genome_id)""",
    "hit_long_exact": f"WITH {_MIXED} SELECT spacer_id, phage_id, strand, p + 1 AS start, p + n AS \"end\" FROM both_strands JOIN wins ON there = query",
    "hit_long_fuzzy": f"""WITH {_MIXED}, c AS (SELECT spacer_id, phage_id, strand, p, n, hamming(query, there) AS mm, least(hamming(substr(query, 1, 8), substr(there, 1, 8)), hamming(right(query, 8), right(there, 8))) AS edge FROM both_strands, wins WHERE length(query) = n AND n > 13 AND hamming(query, there) <= 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY spacer_id ORDER BY mm, edge, phage_id, strand, p) AS no FROM c WHERE 1 - mm / n >= 0.85)
      SELECT spacer_id, phage_id, strand, p + 1 AS start, p + n AS "end", 1 - mm / n AS identity, mm AS mismatches, n AS spacer_length, edge AS edge_mismatches, mm - edge AS distal_mismatches FROM r WHERE no <= 5""",
    "seq_arrays": f"WITH {_ARRAYS} SELECT array_id, genome_id, start, \"end\", repeat_consensus, repeat_length, repeat_count, array_to_string(spacers, ',') AS spacers, list_sum(list_transform(spacers, lambda s: length(s))) / len(spacers) AS mean_spacer_length FROM arrays",
    "seq_spacers": f"WITH {_ARRAYS}, s AS (SELECT array_id, genome_id, unnest(range(1, len(spacers) + 1)) AS spacer_index, unnest(spacers) AS spacer FROM arrays) SELECT array_id || '|spacer_' || spacer_index AS spacer_id, array_id, genome_id, spacer_index, spacer, length(spacer) AS spacer_length FROM s",
    "seq_genome_kmers": f"""WITH {DATA_SQL}, recs AS (SELECT bacterium, fa || r || s1 || r || s2 || r || s3 || r || fz AS s FROM bact),
      k AS (SELECT bacterium, kmer, count(*) AS n FROM (SELECT bacterium, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS kmer FROM recs) GROUP BY ALL),
      z AS (SELECT bacterium, CAST(sum(length(s)) AS BIGINT) AS bases, round_even(sum(length(s) - length(translate(s, 'GC', ''))) * 100 / sum(length(s)) * 1000000.0, 0) / 1000000.0 AS gc_percent FROM recs GROUP BY 1)
      SELECT bacterium, bases, gc_percent, kmer, round_even(n / sum(n) OVER (PARTITION BY bacterium) * 100000000.0, 0) / 100000000.0 AS share FROM k JOIN z USING (bacterium)""",
    "seq_composition": f"""WITH {_ARRAYS}, per AS (SELECT genome_id, count(*) AS a, sum(len(spacers)) AS n FROM arrays GROUP BY 1)
      SELECT bacterium, count(*) AS records, CAST(sum(length(fa || r || s1 || r || s2 || r || s3 || r || fz)) AS BIGINT) AS bases, CAST(coalesce(sum(a), 0) AS BIGINT) AS arrays, CAST(coalesce(sum(n), 0) AS BIGINT) AS spacers FROM bact LEFT JOIN per USING (genome_id) GROUP BY 1""",
    "hit_exact": f"WITH {_HITS} SELECT spacer_id, phage_id, strand, start, \"end\" FROM hits",
    "hit_fuzzy": f"WITH {_FUZZY} SELECT * EXCLUDE (phage) FROM fuzzy",
    "hit_flanks": f"WITH {_HITS} SELECT spacer_id, phage_id, strand, start, protospacer, up AS genomic_upstream, down AS genomic_downstream, flank_5p, flank_3p FROM placed",
    "pam_evaluations": f"WITH {_HITS}, {_rules(_ALL_RULES)}, crossed AS (SELECT * FROM placed, rules), {_JUDGE.format('crossed')} SELECT spacer_id, phage_id, strand, start, rule, pam_sequence, pam_match, support, score, \"offset\" FROM judged",
    "hit_annotated": f"""WITH {_ANNOTATED} SELECT spacer_id, phage_id, strand, start, cas_subtype, pam_rule, CASE WHEN pam_rule IS NOT NULL THEN 'curated_subtype_catalog' WHEN cas_subtype IS NULL THEN 'not_available' WHEN confidence < 0.9 THEN 'subtype_confidence_below_threshold' ELSE 'no_curated_rule' END AS pam_rule_source,
      pam_match, pam_support_level, pam_compatibility_score, pam_offset, seed_region, seed_mismatches FROM ann""",
    "matrix_pairs": f"WITH {_EVIDENCE} SELECT * FROM pairs",
    "detected_matrix": f"WITH {_EVIDENCE.replace(_PRED_RULE, f'{_NEAREST}, pred AS (SELECT * FROM nearest)')} SELECT * FROM pairs",
    "seq_predictions": f"WITH {DATA_SQL}, {_NEAREST} SELECT * FROM nearest",
    "matrix_evidence": f"WITH {_GRID} SELECT * FROM matrix",
    "matrix_top_pairs": f"WITH {_EVIDENCE} SELECT bacterium, phage, crispr_targeting_score, unique_matching_spacers, spacer_hits FROM pairs ORDER BY crispr_targeting_score DESC, unique_matching_spacers DESC, spacer_hits DESC, bacterium, phage LIMIT 10",
    "matrix_heatmap": f"WITH {_GRID} SELECT bacterium, " + ", ".join(f"coalesce(max(unique_matching_spacers) FILTER (phage = 'clade_{i}'), 0) AS clade_{i}" for i in range(30)) + " FROM matrix GROUP BY bacterium",
    "pam_subtype_support": f"""WITH {_ANNOTATED},
      tries AS (SELECT a.array_id, s.cas_subtype AS subtype, r.rule, r.motif, r.rx, CASE r.side WHEN '5' THEN a.flank_5p WHEN '3' THEN a.flank_3p ELSE a.down END AS fl FROM ann a, rules r JOIN subs s ON s.rule = r.rule),
      counts AS (SELECT array_id, subtype, count(*) AS n FROM tries WHERE len(list_filter(range(1, length(fl) - length(motif) + 2), lambda i: regexp_matches(substr(fl, i, length(motif)), rx))) > 0 GROUP BY ALL),
      listed AS (SELECT array_id, list(subtype ORDER BY n DESC, subtype) AS subtypes, max(n) AS top_n FROM counts GROUP BY array_id),
      firsts AS (SELECT array_id, count(*) AS hit_count, any_value(cas_subtype) AS predicted, any_value(confidence) AS conf FROM ann GROUP BY array_id)
      SELECT f.array_id, hit_count AS spacer_hit_count, coalesce(predicted, '') AS repeat_predicted_cas_subtype, conf AS repeat_prediction_confidence, coalesce(subtypes[1], '') AS top_pam_supported_subtype, coalesce(top_n, 0) AS top_pam_support_count,
        coalesce(c.n, 0) AS repeat_predicted_subtype_pam_support_count, coalesce(array_to_string(subtypes, ';'), '') AS pam_supported_subtypes,
        CASE WHEN subtypes IS NULL THEN 'no_pam_subtype_support' WHEN predicted IS NULL THEN 'no_repeat_subtype_prediction' WHEN coalesce(c.n, 0) <= 0 THEN 'repeat_prediction_not_pam_supported' WHEN predicted = subtypes[1] THEN 'agrees_top_subtype'
          WHEN c.n = top_n THEN 'agrees_tied_subtype' ELSE 'conflicts_with_top_subtype' END AS repeat_pam_subtype_agreement
      FROM firsts f LEFT JOIN listed l ON f.array_id = l.array_id LEFT JOIN counts c ON c.array_id = f.array_id AND c.subtype = f.predicted""",
    "hit_targeting_features": f"""WITH {_FUZZY}, named AS (SELECT fuzzy.*, bacterium FROM fuzzy JOIN spac USING (spacer_id)),
      agg AS (SELECT bacterium, phage, count(*) AS fuzzy_spacer_candidate_count, count(DISTINCT spacer_id) AS fuzzy_unique_spacers, 1 AS fuzzy_targeted_phage_contig_count, max(identity) AS best_fuzzy_spacer_identity, min(mismatches) AS best_fuzzy_spacer_mismatches,
        min(edge_mismatches) AS best_fuzzy_seed_edge_mismatches, arg_min(distal_mismatches, edge_mismatches * 1000 + mismatches) AS best_fuzzy_distal_mismatches, count(*) FILTER (edge_mismatches = 0) AS fuzzy_seed_perfect_hit_count,
        count(*) FILTER (mismatches <= 2) AS fuzzy_near_perfect_hit_count, count(*) FILTER (identity >= 0.9 AND edge_mismatches = 0 AND mismatches <= 3) AS fuzzy_high_confidence_hit_count FROM named GROUP BY ALL)
      SELECT *, {_even("least(100.0, greatest(0.0, best_fuzzy_spacer_identity * 35.0 + CASE WHEN best_fuzzy_seed_edge_mismatches = 0 THEN 25.0 ELSE greatest(0.0, 15.0 - best_fuzzy_seed_edge_mismatches * 5.0) END + greatest(0.0, 20.0 - best_fuzzy_spacer_mismatches * 4.0) + least(20.0, log2(fuzzy_unique_spacers + 1) * 10.0)))", 2)} AS graded_crispr_interference_score FROM agg""",
}
