"""Queries over the table of labelled repeats, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions import dna
from arrayloom.functions.labels import subtype
from arrayloom.operators import intervals, metrics, training
from arrayloom.operators.neighbours import neighbour_features
from arrayloom.runtime import table

MOST = 100
HOLDOUT_SEED, HOLDOUT_SHARE = 7, 0.25


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cctyper_validation_repeats_cas_types")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a repeat in upper case and a decided subtype, read as one class however it is written."""
    rows = _arrays(spark, folder).withColumn("repeat_sequence", F.upper(F.trim("repeat_sequence"))).withColumn("cas_subtype", subtype(F.col("cas_subtype")))
    return training.with_hash(rows.filter(training.is_usable(F.col("repeat_sequence")) & ~training.is_ambiguous(F.col("cas_subtype"))))


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = labelled(spark, folder)
    return rows.filter("split = 'train'"), rows.filter("split in ('validation', 'test')")


def train_issues(spark: SparkSession, folder: str) -> DataFrame:
    return training.repeat_issues(_arrays(spark, folder))


def train_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _arrays(spark, folder).select(
        "row_id",
        training.cas_type(F.col("cas_subtype")).alias("type_of_subtype"),
        training.is_ambiguous(F.col("cas_subtype")).alias("is_ambiguous"),
        training.is_usable(F.upper(F.trim("repeat_sequence"))).alias("is_usable"),
        training.is_trusted(F.col("label_confidence")).alias("is_trusted"),
    )


def train_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return training.conflicts(labelled(spark, folder), "row_id")


def train_novel(spark: SparkSession, folder: str) -> DataFrame:
    current, candidates = _both(spark, folder)
    return training.novel(candidates, current, "row_id").select("row_id", "repeat_hash", "cas_subtype")


def train_balanced(spark: SparkSession, folder: str) -> DataFrame:
    return training.balanced(labelled(spark, folder), MOST).select("row_id", "cas_subtype", "spacer_count")


def train_audit(spark: SparkSession, folder: str) -> DataFrame:
    current, candidates = _both(spark, folder)
    return training.audit_summary(current, candidates, MOST, "row_id")


def train_subtype_delta(spark: SparkSession, folder: str) -> DataFrame:
    current, candidates = _both(spark, folder)
    return training.subtype_delta(current, candidates, MOST, "row_id")


def train_frequent_classes(spark: SparkSession, folder: str) -> DataFrame:
    return training.frequent_classes(labelled(spark, folder), "cas_subtype", 50).select("row_id", "cas_subtype")


def train_group_holdout(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder).withColumn("genus", F.coalesce(F.nullif(F.split_part(F.trim("organism"), F.lit(" "), F.lit(1)), F.lit("")), F.lit("unknown")))
    return training.group_holdout(rows, "genus", HOLDOUT_SHARE, HOLDOUT_SEED)


def train_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one genome, repeat and subtype as one, with their distinct arrays as spacers."""
    rows = labelled(spark, folder).withColumn("place", F.concat_ws(":", "contig_id", F.col("array_start").cast("string")))
    return training.collapse_spacers(rows, ["genome_id", "repeat_sequence", "cas_subtype", "taxonomy"], "place", "spacer_count")


def train_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with equal sequence: the first is kept, the others are listed."""
    rows = _arrays(spark, folder).filter("repeat_sequence <> ''").select("row_id", "genome_id", "source", dna.sequence_hash(F.col("repeat_sequence")).alias("sequence_hash"))
    named = rows.withColumn("name", F.concat_ws(":", "source", "genome_id"))
    per = named.groupBy("sequence_hash").agg(F.count("*").alias("records"), F.min("row_id").alias("kept_row"), F.countDistinct("genome_id").alias("genomes"), F.max("name").alias("last_name"))
    return per.filter("records > 1")


def train_accessions(spark: SparkSession, folder: str) -> DataFrame:
    """Accession in each record's id, and how many different sequences share it."""
    rows = _arrays(spark, folder).select("row_id", dna.extract_accession(F.coalesce("genome_id", F.lit(""))).alias("accession"), dna.sequence_hash(F.col("repeat_sequence")).alias("h"))
    per = rows.filter("accession <> ''").groupBy("accession").agg(F.count("*").alias("records"), F.countDistinct("h").alias("sequences"))
    return per.filter("sequences > 1")


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cas clusters beside arrays whose label came from a nearby operon, placed by a rule from the row's id."""
    rows = _arrays(spark, folder).filter("label_source = 'nearby_cas_operon' and array_end is not null")
    start = F.col("array_end") + F.col("row_id") * 37 % 30_000
    return rows.select("row_id", "contig_id", start.alias("start"), (start + 8_000).alias("end"), "cas_subtype")


def train_nearest_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """For every array the nearest Cas cluster on its contig within 20 kb."""
    loci = _arrays(spark, folder).select("row_id", "contig_id", F.col("array_start").alias("start"), F.col("array_end").alias("end"))
    found = intervals.nearest(loci, _clusters(spark, folder), "contig_id", "row_id", "row_id")
    return found.select(F.col("a.row_id").alias("row_id"), F.col("b.row_id").alias("cluster_row"), F.col("b.cas_subtype").alias("cas_subtype"), "distance")


def train_overlapping_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of the SQL dump and of the caller that overlap on one contig."""
    rows = _arrays(spark, folder).select("row_id", "contig_id", "source", F.col("array_start").alias("start"), F.col("array_end").alias("end"))
    pairs = intervals.overlapping(rows.filter("source = 'sql_dump'"), rows.filter("source = 'cctyper'"), "contig_id")
    return pairs.select(F.col("a.row_id").alias("dump_row"), F.col("b.row_id").alias("caller_row"))


def train_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbour features of every row whose id is divisible by 20, against all training rows."""
    rows = labelled(spark, folder).withColumn("array_key", F.concat_ws("|", "genome_id", "contig_id", F.col("array_start").cast("string")))
    asks = rows.filter("row_id % 20 = 0").select("row_id", F.col("repeat_sequence").alias("text"), "array_key")
    refs = rows.filter("split = 'train'").select(F.col("row_id").alias("ref_id"), F.col("repeat_sequence").alias("text"), F.col("cas_subtype").alias("label"), "array_key")
    return neighbour_features(asks, refs)


def train_repeat_features(spark: SparkSession, folder: str) -> DataFrame:
    """Composition and structure of every repeat."""
    rows = dna.with_structure(_arrays(spark, folder).select("row_id", F.coalesce("repeat_sequence", F.lit("")).alias("u")), "u").withColumn("s", dna.plain_bases(F.col("u")))
    start, end = F.substring("s", 1, 4), F.expr("right(s, 6)")
    return rows.select(
        "row_id", dna.gc_percent(F.col("u")).alias("gc_percent"), dna.at_percent(F.col("u")).alias("at_percent"), dna.gc_skew(F.col("u")).alias("gc_skew"), "self_identity", "inverted_stem", "hairpin_score",
        dna.gc_percent(start).alias("start_4_gc_percent"), dna.gc_percent(end).alias("end_6_gc_percent"),
    )


def train_kmers(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each 3-mer in the repeats of a subtype, repeats counted once."""
    rows = labelled(spark, folder).select("cas_subtype", "repeat_sequence").distinct()
    each = rows.select("cas_subtype", F.explode(dna.kmers(F.col("repeat_sequence"), 3)).alias("kmer")).groupBy("cas_subtype", "kmer").agg(F.count("*").alias("n"))
    totals = each.groupBy("cas_subtype").agg(F.sum("n").alias("total"))
    return each.join(totals, "cas_subtype").select("cas_subtype", "kmer", "n", (F.col("n") / F.col("total")).alias("share"))


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Each held-out row predicted by the majority of training rows with its repeat; confidence is the majority's share."""
    current, candidates = _both(spark, folder)
    votes = current.groupBy("repeat_hash", "cas_subtype").agg(F.count("*").alias("n"))
    best = votes.groupBy("repeat_hash").agg(F.min_by("cas_subtype", F.struct((-F.col("n")).alias("minus"), "cas_subtype")).alias("predicted_label"), (F.max("n") / F.sum("n")).alias("confidence"))
    joined = candidates.select("row_id", "repeat_hash", F.col("cas_subtype").alias("true_label")).join(best, "repeat_hash", "left")
    filled = joined.fillna({"predicted_label": "none", "confidence": 0.0})
    return filled.withColumn("correct", F.col("true_label") == F.col("predicted_label"))


def ml_majority_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, folder))


def ml_majority_classes(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.class_scores(_predictions(spark, folder))


def ml_majority_overall(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.overall(_predictions(spark, folder))


def ml_confidence_bins(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confidence_bins(_predictions(spark, folder))


def ml_calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.calibration_error(_predictions(spark, folder))


def ml_label_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.label_confidence(_predictions(spark, folder))


def ml_accuracy_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy_by_threshold(_predictions(spark, folder))


def ml_error_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.error_pairs(_predictions(spark, folder))


def ml_auc(spark: SparkSession, folder: str) -> DataFrame:
    """One label against the rest; a row's score for a label is its confidence if that label is predicted, else 0."""
    rows = _predictions(spark, folder)
    labels = rows.groupBy("true_label").agg(F.count("*").alias("n")).filter("n >= 20").select(F.col("true_label").alias("label"))
    per = rows.groupBy("true_label", "predicted_label", "confidence").agg(F.count("*").alias("w"))
    scored = per.join(labels).select(
        "label", (F.col("true_label") == F.col("label")).alias("is_positive"), F.when(F.col("predicted_label") == F.col("label"), F.col("confidence")).otherwise(0.0).alias("score"), F.explode(F.sequence(F.lit(1), F.col("w"))).alias("i")
    )
    return metrics.one_versus_rest_auc(scored)


def ml_threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Saying that a prediction is right from a confidence on."""
    rows = _predictions(spark, folder).select(F.col("correct").alias("positive"), F.col("confidence").alias("score"))
    return metrics.threshold_sweep(rows, [0.01, 0.25, 0.5, 0.75, 0.9, 1.0])


QUERIES = {
    f.__name__: f
    for f in (
        train_issues, train_flags, train_conflicts, train_novel, train_balanced, train_audit, train_subtype_delta, train_frequent_classes, train_group_holdout, train_collapsed,
        train_records, train_accessions, train_nearest_cluster, train_overlapping_calls, train_neighbours, train_repeat_features, train_kmers,
        ml_majority_confusion, ml_majority_classes, ml_majority_overall, ml_confidence_bins, ml_calibration_error, ml_label_confidence, ml_accuracy_by_threshold, ml_error_pairs, ml_auc, ml_threshold_sweep,
    )
}

_AMBIGUOUS = "(" + ", ".join(f"'{w}'" for w in training.AMBIGUOUS) + ")"
_T = "cctyper_validation_repeats_cas_types"
# A subtype as a list of known numerals and one letter, however it is written.
_LAB = f"""plain AS (SELECT *, regexp_replace(regexp_replace(upper(trim(cas_subtype)), '[–—]', '-', 'g'), '^(CAS-|TYPE )\\s*', '') AS said FROM {_T}),
  lab AS (SELECT * EXCLUDE (said) REPLACE (upper(trim(repeat_sequence)) AS repeat_sequence, regexp_extract(said, '^(III|II|IV|VI|I|V)-?([A-Z])$', 1) || '-' || regexp_extract(said, '^(III|II|IV|VI|I|V)-?([A-Z])$', 2) AS cas_subtype),
    sha256(upper(trim(repeat_sequence))) AS repeat_hash FROM plain WHERE regexp_matches(upper(trim(repeat_sequence)), '^[ACGTN]{{23,47}}$') AND regexp_matches(said, '^(III|II|IV|VI|I|V)-?([A-Z])$')),
  cur AS (SELECT * FROM lab WHERE split = 'train'), cand AS (SELECT * FROM lab WHERE split IN ('validation', 'test')),
  clash AS (SELECT repeat_hash FROM cand GROUP BY 1 HAVING count(DISTINCT cas_subtype) > 1),
  new AS (SELECT * FROM cand WHERE repeat_hash NOT IN (SELECT repeat_hash FROM clash) AND repeat_hash NOT IN (SELECT repeat_hash FROM cur)),
  bal AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY cas_subtype ORDER BY spacer_count DESC NULLS LAST, genome_id NULLS FIRST, repeat_sequence, row_id) <= {MOST})"""
_PRED = f"""{_LAB}, votes AS (SELECT repeat_hash, cas_subtype, count(*) AS n FROM cur GROUP BY ALL),
  best AS (SELECT repeat_hash, first(cas_subtype ORDER BY n DESC, cas_subtype) AS p, max(n) / sum(n) AS c FROM votes GROUP BY 1),
  pred AS (SELECT row_id, cas_subtype AS true_label, coalesce(p, 'none') AS predicted_label, CAST(coalesce(c, 0) AS DOUBLE) AS confidence, cas_subtype = coalesce(p, 'none') AS correct FROM cand LEFT JOIN best USING (repeat_hash))"""
_BINS = f"""{_PRED}, binned AS (SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS b, count(*) AS n, avg(confidence) AS m, avg(CAST(correct AS DOUBLE)) AS a FROM pred GROUP BY 1),
  bins AS (SELECT r.b / 10 AS bin_lower, (r.b + 1) / 10 AS bin_upper, coalesce(n, 0) AS row_count, round_even(coalesce(m, CAST((r.b * 2 + 1) / 20 AS DOUBLE)) * 1000000.0, 0) / 1000000.0 AS mean_confidence, round_even(coalesce(a, CAST(0 AS DOUBLE)) * 1000000.0, 0) / 1000000.0 AS accuracy FROM range(0, 10) r(b) LEFT JOIN binned USING (b))"""
_CLASSES = f"""{_PRED}, sides AS (SELECT true_label AS label, 1 AS t, 0 AS p, CAST(correct AS INTEGER) AS h FROM pred UNION ALL SELECT predicted_label, 0, 1, 0 FROM pred),
  sums AS (SELECT label, sum(t) AS support, sum(p) AS np, sum(h) AS h FROM sides GROUP BY 1),
  pr AS (SELECT label, CASE WHEN np = 0 THEN CAST(0 AS DOUBLE) ELSE h / np END AS precision, CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE h / support END AS recall, CAST(support AS BIGINT) AS support FROM sums),
  classes AS (SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM pr)"""
_PLAIN = "regexp_replace(upper(coalesce(repeat_sequence, '')), '[^ACGT]', '', 'g')"


def _pct(s: str, letters: str) -> str:
    return f"CASE WHEN length({s}) = 0 THEN CAST(0 AS DOUBLE) ELSE round_even((length({s}) - length(translate({s}, '{letters}', ''))) / length({s}) * 100 * 1000000.0, 0) / 1000000.0 END"


_SELF = "round_even(len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) = substr(rc, i, 1))) / length(s) * 1000000.0, 0) / 1000000.0"
_STEM = "coalesce(list_max(list_filter(range(2, least(12, length(s) // 2) + 1), lambda k: substr(s, 1, k) = substr(rc, 1, k))), 0)"
ORACLE = {
    "train_issues": f"""SELECT row_id, issue FROM (SELECT row_id, unnest([CASE WHEN NOT regexp_matches(upper(coalesce(repeat_sequence, '')), '^[ACGTN]+$') THEN 'repeat_sequence holds other letters than ACGTN' END,
      CASE WHEN coalesce(repeat_length <> length(coalesce(repeat_sequence, '')), true) THEN 'repeat_length differs from the sequence' END, CASE WHEN coalesce(spacer_count < 0, true) THEN 'spacer_count is missing or negative' END,
      CASE WHEN trim(coalesce(cas_type, '')) = '' THEN 'cas_type is empty' END, CASE WHEN trim(coalesce(cas_subtype, '')) = '' THEN 'cas_subtype is empty' END]) AS issue FROM {_T}) WHERE issue IS NOT NULL""",
    "train_flags": f"""SELECT row_id, CASE WHEN regexp_matches(upper(trim(cas_subtype)), '^(I|II|III|IV|V|VI)-') THEN 'Type ' || regexp_extract(upper(trim(cas_subtype)), '^(I|II|III|IV|V|VI)-', 1) ELSE 'Unknown' END AS type_of_subtype,
      lower(trim(coalesce(cas_subtype, ''))) IN {_AMBIGUOUS} OR contains(coalesce(cas_subtype, ''), '/') OR contains(coalesce(cas_subtype, ''), ',') AS is_ambiguous, coalesce(regexp_matches(upper(trim(repeat_sequence)), '^[ACGTN]{{23,47}}$'), false) AS is_usable,
      coalesce(lower(trim(label_confidence)) IN ('high', 'curated', 'cas_operon_supported'), false) AS is_trusted FROM {_T}""",
    "train_conflicts": f"WITH {_LAB} SELECT repeat_hash, array_to_string(list_sort(list(DISTINCT cas_subtype)), ';') AS subtypes, count(*) AS row_count, arg_min(repeat_sequence, row_id) AS example_repeat_sequence FROM lab GROUP BY 1 HAVING count(DISTINCT cas_subtype) > 1",
    "train_novel": f"WITH {_LAB} SELECT row_id, repeat_hash, cas_subtype FROM new",
    "train_balanced": f"WITH {_LAB} SELECT row_id, cas_subtype, spacer_count FROM lab QUALIFY row_number() OVER (PARTITION BY cas_subtype ORDER BY spacer_count DESC NULLS LAST, genome_id NULLS FIRST, repeat_sequence, row_id) <= {MOST}",
    "train_audit": f"""WITH {_LAB} SELECT 'current_rows' AS metric, (SELECT count(*) FROM cur) AS value UNION ALL SELECT 'candidate_rows', (SELECT count(*) FROM cand) UNION ALL SELECT 'current_unique_repeat_hashes', (SELECT count(DISTINCT repeat_hash) FROM cur)
      UNION ALL SELECT 'candidate_unique_repeat_hashes', (SELECT count(DISTINCT repeat_hash) FROM cand) UNION ALL SELECT 'overlapping_repeat_hashes', (SELECT count(DISTINCT repeat_hash) FROM cand WHERE repeat_hash IN (SELECT repeat_hash FROM cur))
      UNION ALL SELECT 'candidate_conflicting_repeat_hashes', (SELECT count(*) FROM clash) UNION ALL SELECT 'candidate_rows_after_conflict_filter', (SELECT count(*) FROM cand WHERE repeat_hash NOT IN (SELECT repeat_hash FROM clash))
      UNION ALL SELECT 'novel_nonconflicting_candidate_rows', (SELECT count(*) FROM new) UNION ALL SELECT 'balanced_candidate_rows', (SELECT count(*) FROM bal)""",
    "train_subtype_delta": f"""WITH {_LAB}, tagged AS (SELECT cas_subtype, 'a' AS t FROM cur UNION ALL SELECT cas_subtype, 'b' FROM cand UNION ALL SELECT cas_subtype, 'c' FROM new UNION ALL SELECT cas_subtype, 'd' FROM bal)
      SELECT cas_subtype, count(*) FILTER (t = 'a') AS current_count, count(*) FILTER (t = 'b') AS candidate_count, count(*) FILTER (t = 'c') AS novel_nonconflicting_count, count(*) FILTER (t = 'd') AS balanced_candidate_count FROM tagged GROUP BY 1""",
    "train_frequent_classes": f"WITH {_LAB} SELECT row_id, cas_subtype FROM lab QUALIFY count(*) OVER (PARTITION BY cas_subtype) >= 50",
    "train_group_holdout": f"""WITH {_LAB}, g AS (SELECT coalesce(nullif(split_part(trim(organism), ' ', 1), ''), 'unknown') AS grp, count(*) AS rows FROM lab GROUP BY 1)
      SELECT grp, rows, sum(rows) OVER (ORDER BY md5('{HOLDOUT_SEED}:' || grp), grp) - rows < round_even((SELECT sum(rows) FROM g) * {HOLDOUT_SHARE}, 0) AS held_out FROM g""",
    "train_collapsed": f"""WITH {_LAB} SELECT genome_id, repeat_sequence, cas_subtype, taxonomy, count(DISTINCT concat_ws(':', contig_id, array_start)) AS spacer_count, round_even(avg(spacer_count) * 1000000.0, 0) / 1000000.0 AS mean_spacer_length
      FROM lab GROUP BY genome_id, repeat_sequence, cas_subtype, taxonomy HAVING count(DISTINCT concat_ws(':', contig_id, array_start)) >= 2""",
    "train_records": f"""SELECT sha256(regexp_replace(upper(repeat_sequence), '\\s', '', 'g')) AS sequence_hash, count(*) AS records, min(row_id) AS kept_row, count(DISTINCT genome_id) AS genomes, max(concat_ws(':', source, genome_id)) AS last_name
      FROM {_T} WHERE repeat_sequence <> '' GROUP BY 1 HAVING count(*) > 1""",
    "train_accessions": f"""WITH words AS (SELECT row_id, sha256(regexp_replace(upper(repeat_sequence), '\\s', '', 'g')) AS h,
        coalesce(CASE WHEN contains(genome_id, '|') THEN list_filter(list_transform(string_split(trim(genome_id, E' \\t'), '|'), lambda p: trim(p, ' ,;()[]')), lambda p: regexp_matches(p, '^([A-Z]{{1,2}}_[0-9]{{5,9}}(\\.[0-9]+)?|[A-Z]{{1,4}}[0-9]{{5,9}}(\\.[0-9]+)?)$'))[1] END,
          list_filter(list_transform(string_split_regex(trim(genome_id, E' \\t'), '\\s+'), lambda p: trim(p, ' ,;()[]')), lambda p: regexp_matches(p, '^([A-Z]{{1,2}}_[0-9]{{5,9}}(\\.[0-9]+)?|[A-Z]{{1,4}}[0-9]{{5,9}}(\\.[0-9]+)?)$'))[1]) AS accession FROM {_T})
      SELECT accession, count(*) AS records, count(DISTINCT h) AS sequences FROM words WHERE accession <> '' GROUP BY 1 HAVING count(DISTINCT h) > 1""",
    "train_nearest_cluster": f"""WITH clusters AS (SELECT row_id, contig_id, array_end + row_id * 37 % 30000 AS s, array_end + row_id * 37 % 30000 + 8000 AS e, cas_subtype FROM {_T} WHERE label_source = 'nearby_cas_operon' AND array_end IS NOT NULL)
      SELECT l.row_id, c.row_id AS cluster_row, c.cas_subtype, greatest(0, c.s - l.array_end, l.array_start - c.e) AS distance FROM {_T} l JOIN clusters c ON l.contig_id = c.contig_id AND l.array_start <= l.array_end
      WHERE greatest(0, c.s - l.array_end, l.array_start - c.e) <= 20000 QUALIFY row_number() OVER (PARTITION BY l.row_id ORDER BY greatest(0, c.s - l.array_end, l.array_start - c.e), c.row_id) = 1""",
    "train_overlapping_calls": f"""SELECT a.row_id AS dump_row, b.row_id AS caller_row FROM {_T} a JOIN {_T} b ON a.contig_id = b.contig_id AND a.source = 'sql_dump' AND b.source = 'cctyper' AND a.array_start <= b.array_end AND b.array_start <= a.array_end
      AND a.array_start <= a.array_end AND b.array_start <= b.array_end""",
    "train_neighbours": f"""WITH {_LAB}, q AS (SELECT row_id, repeat_sequence AS t, concat_ws('|', genome_id, contig_id, array_start) AS self FROM lab WHERE row_id % 20 = 0),
      r AS (SELECT row_id AS ref_id, repeat_sequence AS t, cas_subtype AS label, concat_ws('|', genome_id, contig_id, array_start) AS self FROM cur),
      sim AS (SELECT q.row_id, ref_id, label, (least(length(q.t), length(r.t)) - hamming(substr(q.t, 1, least(length(q.t), length(r.t))::BIGINT), substr(r.t, 1, least(length(q.t), length(r.t))::BIGINT))) / greatest(length(q.t), length(r.t)) AS i FROM q JOIN r ON q.self <> r.self),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY i DESC, ref_id) AS no FROM sim),
      near AS (SELECT row_id, max(ref_id) FILTER (no = 1) AS nearest_ref_id, max(label) FILTER (no = 1) AS nearest_label, max(i) FILTER (no = 1) AS b, max(i) FILTER (no = 2) AS s FROM ranked WHERE no <= 2 GROUP BY 1),
      v AS (SELECT row_id, label, count(*) AS n FROM sim WHERE i >= 0.9 GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY row_id) AS p FROM v), e AS (SELECT row_id, sum(n) AS c, max(p) AS tv, sum(-p * log2(p)) AS h FROM p GROUP BY 1)
      SELECT q.row_id, nearest_ref_id, nearest_label, coalesce(round_even(b * 1000000.0, 0) / 1000000.0, 0) AS neighbor_best_identity, coalesce(round_even(s * 1000000.0, 0) / 1000000.0, 0) AS neighbor_second_identity, CAST(coalesce(c, 0) AS BIGINT) AS neighbor_close_count_90,
        coalesce(round_even(tv * 1000000.0, 0) / 1000000.0, 0) AS neighbor_top_vote_fraction_90, coalesce(round_even(h * 1000000.0, 0) / 1000000.0 + 0.0, 0) AS neighbor_subtype_entropy_90 FROM q LEFT JOIN near USING (row_id) LEFT JOIN e USING (row_id)""",
    "train_repeat_features": f"""WITH x AS (SELECT row_id, upper(coalesce(repeat_sequence, '')) AS u, {_PLAIN} AS s, reverse(translate({_PLAIN}, 'ACGT', 'TGCA')) AS rc FROM {_T}),
      y AS (SELECT *, CASE WHEN s = '' THEN CAST(0 AS DOUBLE) ELSE {_SELF} END AS self_identity, {_STEM} AS inverted_stem, length(u) - length(replace(u, 'G', '')) AS g, length(u) - length(replace(u, 'C', '')) AS c FROM x)
      SELECT row_id, {_pct('s', 'GC')} AS gc_percent, {_pct('s', 'AT')} AS at_percent, CASE WHEN g + c = 0 THEN CAST(0 AS DOUBLE) ELSE round_even((g - c) / (g + c) * 1000000.0, 0) / 1000000.0 END AS gc_skew, self_identity, CAST(inverted_stem AS INTEGER) AS inverted_stem,
        CASE WHEN length(s) < 8 THEN CAST(0 AS DOUBLE) ELSE round_even((inverted_stem / sqrt(length(s)) + self_identity) * 1000000.0, 0) / 1000000.0 END AS hairpin_score, {_pct('substr(s, 1, 4)', 'GC')} AS start_4_gc_percent, {_pct('right(s, 6)', 'GC')} AS end_6_gc_percent FROM y""",
    "train_kmers": f"""WITH {_LAB}, r AS (SELECT DISTINCT cas_subtype, regexp_replace(repeat_sequence, '[^ACGT]', '', 'g') AS s, repeat_sequence FROM lab), k AS (SELECT cas_subtype, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS kmer FROM r),
      n AS (SELECT cas_subtype, kmer, count(*) AS n FROM k GROUP BY ALL) SELECT cas_subtype, kmer, n, n / sum(n) OVER (PARTITION BY cas_subtype) AS share FROM n""",
    "ml_majority_confusion": f"WITH {_PRED} SELECT true_label, predicted_label, count(*) AS n FROM pred GROUP BY ALL",
    "ml_majority_classes": f"WITH {_CLASSES} SELECT * FROM classes",
    "ml_majority_overall": f"WITH {_CLASSES} SELECT (SELECT count(*) FROM pred) AS rows, round_even((SELECT avg(CAST(correct AS DOUBLE)) FROM pred) * 1000000.0, 0) / 1000000.0 AS accuracy, round_even(avg(f1) * 1000000.0, 0) / 1000000.0 AS macro_f1 FROM classes",
    "ml_confidence_bins": f"WITH {_BINS} SELECT *, round_even((accuracy - mean_confidence) * 1000000.0, 0) / 1000000.0 AS calibration_gap FROM bins",
    "ml_calibration_error": f"WITH {_BINS} SELECT CAST(sum(row_count) AS BIGINT) AS rows, round_even(sum(row_count * abs(accuracy - mean_confidence)) / sum(row_count) * 1000000.0, 0) / 1000000.0 AS expected_calibration_error FROM bins",
    "ml_label_confidence": f"WITH {_PRED} SELECT true_label, count(*) AS row_count, round_even(avg(CAST(correct AS DOUBLE)) * 1000000.0, 0) / 1000000.0 AS accuracy, round_even(avg(confidence) * 1000000.0, 0) / 1000000.0 AS mean_confidence, round_even(median(confidence) * 1000000.0, 0) / 1000000.0 AS median_confidence FROM pred GROUP BY 1",
    "ml_accuracy_by_threshold": f"""WITH {_PRED} SELECT t * 5 / 100 AS confidence_threshold, count(*) FILTER (confidence >= t * 5 / 100 - 1e-11) AS row_count, count(*) FILTER (confidence >= t * 5 / 100 - 1e-11) / count(*) AS coverage_fraction,
      round_even(coalesce(avg(CAST(correct AS DOUBLE)) FILTER (confidence >= t * 5 / 100 - 1e-11), 0) * 1000000.0, 0) / 1000000.0 AS accuracy FROM range(0, 21) r(t), pred GROUP BY t""",
    "ml_error_pairs": f"WITH {_PRED} SELECT true_label, predicted_label, count(*) AS errors FROM pred WHERE NOT correct GROUP BY ALL ORDER BY errors DESC, true_label, predicted_label LIMIT 15",
    "ml_auc": f"""WITH {_PRED}, labels AS (SELECT true_label AS label FROM pred GROUP BY 1 HAVING count(*) >= 20), s AS (SELECT label, true_label = label AS pos, CASE WHEN predicted_label = label THEN confidence ELSE 0 END AS score FROM pred, labels),
      per AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY score) - n AS below FROM per)
      SELECT label, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM w GROUP BY 1 HAVING sum(p) > 0 AND sum(n) > 0""",
    "ml_threshold_sweep": f"""WITH {_PRED}, c AS (SELECT t AS threshold, count(*) FILTER (confidence >= t AND correct) AS tp, count(*) FILTER (confidence >= t AND NOT correct) AS fp, count(*) FILTER (confidence < t AND correct) AS fn, count(*) FILTER (confidence < t AND NOT correct) AS tn
      FROM pred, (SELECT CAST(unnest([0.01, 0.25, 0.5, 0.75, 0.9, 1.0]) AS DOUBLE) AS t) GROUP BY t)
      SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END + CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END) / 2 AS macro_f1 FROM c""",
}
