"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm import capping, grouped_split, leaks, overlap, packing, proportions, shared_spans, survivors
from arrayloom.llm.arrays import array_records
from arrayloom.runtime import table, written


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found(array_records(spark, folder))


def p2_overlaps_by_split(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.by_split_and_source(array_records(spark, folder))


def p2_record_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every held-out record with a training twin: its twins, and how much of one's chunks it holds at most."""
    return overlap.overlaps_of_records(array_records(spark, folder))


#: Share of all records that the sample is to hold.
SAMPLE = 0.1


def _sampled(spark: SparkSession, folder: str, what) -> DataFrame:
    arrays = proportions.read(array_records(spark, folder))
    return what(arrays, "row_id", "subtype", "phylum", table(spark, folder, "sampling_targets"), ("cas_subtype", "phylum"), SAMPLE)


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _sampled(spark, folder, proportions.proportional_sample).withColumnsRenamed({"first": "cas_subtype", "second": "phylum"})


def p3_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _sampled(spark, folder, proportions.missed_targets)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.found(array_records(spark, folder))


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.surviving_records(array_records(spark, folder))


def p7_capped_by_count(spark: SparkSession, folder: str) -> DataFrame:
    """At most 1,000 records of each subtype."""
    return capping.cap_contributors(capping.read(array_records(spark, folder)), "subtype", "spacer_count", "row_id", max_rows=1000)


def p7_capped_by_share(spark: SparkSession, folder: str) -> DataFrame:
    """No subtype above an eighth of the records that remain."""
    return capping.cap_contributors(capping.read(array_records(spark, folder)), "subtype", "spacer_count", "row_id", max_share=0.125)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split.found(array_records(spark, folder))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split.array_splits(array_records(spark, folder))


def p6_split_report(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split.split_report(array_records(spark, folder))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every page, sizes in tokens of a public byte-level tokenizer."""
    pages = table(spark, folder, "documents").select("doc_id", packing.token_count(F.col("text")).alias("tokens"))
    return packing.pack_items(written(pages, "sizes"), "doc_id", "tokens").withColumnRenamed("item", "doc_id")


def p8_room_used(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.passage_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_passages"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).filter("kind = 'printed'").select("doc_id", "passage_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p9_leaks_by_task(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, folder), table(spark, folder, "eval_passages"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, folder, "documents"))


def p10_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_stretches(table(spark, folder, "documents"))


def p10_shared_part(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_part(table(spark, folder, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_overlaps_by_split": p2_overlaps_by_split,
    "p2_record_overlaps": p2_record_overlaps,
    "p3_sample": p3_sample,
    "p3_targets": p3_targets,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_split_report": p6_split_report,
    "p7_capped_by_share": p7_capped_by_share,
    "p7_capped_by_count": p7_capped_by_count,
    "p8_containers": p8_containers,
    "p8_room_used": p8_room_used,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_leaks_by_task": p9_leaks_by_task,
    "p10_found": p10_found,
    "p10_stretches": p10_stretches,
    "p10_shared_part": p10_shared_part,
}

_READ = """read AS (SELECT *, upper(regexp_extract(genome_id, '(?:^|[^A-Za-z0-9])([A-Za-z]{2})[_ \\-]?([0-9]{8})(?:[^0-9]|$)', 1))
    || regexp_extract(genome_id, '(?:^|[^A-Za-z0-9])([A-Za-z]{2})[_ \\-]?([0-9]{8})(?:[^0-9]|$)', 2) AS genome,
  replace(upper(regexp_replace(repeat_sequence, '[\\s\\-]', '', 'g')), 'U', 'T') AS bases
  FROM cctyper_validation_repeats_cas_types),
arrays AS (SELECT *, reverse(translate(bases, 'ACGTN', 'TGCAN')) AS rc FROM read WHERE genome <> '' AND bases <> '')"""

_SAME = "a.genome = b.genome AND abs(length(a.bases) - length(b.bases)) <= 2 AND (levenshtein(a.bases, b.bases) <= 2 OR levenshtein(a.rc, b.bases) <= 2)"

_TWINS = f"""{_READ}, twins AS (SELECT a.row_id AS train_row, b.row_id AS other_row FROM arrays a JOIN arrays b
  ON a.split = 'train' AND b.split IN ('validation', 'test') AND {_SAME})"""

# The least row id spreads over genome and genus until nothing changes.
_BOUND = f"""{_READ}, bound AS (SELECT row_id, nullif(genome, '') AS genome,
    nullif(trim(regexp_replace(lower(trim(string_split_regex(taxonomy, '[;|,>]')[6])), '^[a-z]__', '')), '') AS genus FROM read),
  vals AS (SELECT genome AS x, 'u:' || genus AS y FROM bound WHERE genome IS NOT NULL AND genus IS NOT NULL GROUP BY ALL),
  links AS (SELECT a.y AS x, b.y AS y FROM vals a JOIN vals b USING (x) GROUP BY ALL),
  walk(x, y) AS (SELECT x, y FROM links UNION SELECT w.x, l.y FROM walk w JOIN links l ON w.y = l.x),
  genus_root AS (SELECT x AS genus, min(y) AS root FROM walk GROUP BY x),
  genome_root AS (SELECT x AS genome, min(root) AS root FROM vals JOIN genus_root ON genus = y GROUP BY x),
  rooted AS (SELECT row_id, coalesce(g.root, u.root, 'u:' || b.genus, b.genome, CAST(row_id AS VARCHAR)) AS root
    FROM bound b LEFT JOIN genome_root g ON b.genome = g.genome LEFT JOIN genus_root u ON 'u:' || b.genus = u.genus)"""

# Every window of 300 characters that another document has too; stretches are windows that overlap or touch.
_STRETCHES = """windows AS (SELECT doc_id, i, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 298, 1))) AS i FROM documents)),
  shared AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id))),
  opened AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM shared),
  numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM opened),
  stretches AS (SELECT doc_id, min(i) - 1 AS begin, max(i) + 299 AS "end" FROM numbered GROUP BY doc_id, no)"""

_SUBTYPED = """plain AS (SELECT * REPLACE (CASE WHEN spacer_count >= 0 THEN CAST(spacer_count AS BIGINT) END AS spacer_count, strftime(called_at, '%Y-%m-%d %H:%M:%S') AS called_at, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at),
    regexp_replace(regexp_replace(upper(trim(cas_subtype)), '[–—]', '-', 'g'), '^(CAS-|TYPE )\\s*', '') AS s FROM cctyper_validation_repeats_cas_types),
  subtyped AS (SELECT * EXCLUDE (s), nullif(regexp_extract(s, '^(III|II|IV|VI|I|V)-?([A-Z])$', 1) || '-' || regexp_extract(s, '^(III|II|IV|VI|I|V)-?([A-Z])$', 2), '-') AS subtype FROM plain),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY spacer_count DESC NULLS LAST, row_id) AS place FROM subtyped)"""

ORACLE = {
    "p2_found": f"WITH {_TWINS} SELECT least(train_row, other_row) AS row_id_a, greatest(train_row, other_row) AS row_id_b FROM twins",
    "p2_overlaps_by_split": f"""WITH {_TWINS}, per AS (SELECT other_row, count(*) AS n FROM twins GROUP BY 1)
      SELECT split, source, count(*) AS rows, count(n) AS rows_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs
      FROM cctyper_validation_repeats_cas_types LEFT JOIN per ON row_id = other_row WHERE split IN ('validation', 'test') GROUP BY ALL""",
    "p4_found": f"""WITH {_READ} SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM arrays a JOIN arrays b
      ON a.row_id < b.row_id AND abs(a.array_start - b.array_start) <= 50 AND {_SAME}""",
    "p7_capped_by_count": f"WITH {_SUBTYPED} SELECT * EXCLUDE (place) FROM ranked WHERE place <= 1000",
    "p7_capped_by_share": f"""WITH {_SUBTYPED}, sizes AS (SELECT count(*) AS n FROM ranked GROUP BY subtype),
      fits AS (SELECT k FROM range(0, (SELECT max(n) + 1 FROM sizes)) r(k), sizes GROUP BY k HAVING k <= 0.125 * sum(least(n, k)) + 1e-9)
      SELECT * EXCLUDE (place) FROM ranked WHERE place <= (SELECT max(k) FROM fits)""",
    "p10_stretches": f"WITH {_STRETCHES} SELECT * FROM stretches",
    "p10_shared_part": f"""WITH {_STRETCHES}, sums AS (SELECT doc_id, count(*) AS n, CAST(sum("end" - begin) AS BIGINT) AS c FROM stretches GROUP BY 1)
      SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(n, 0) AS stretches, coalesce(c, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(c, 0) / length(text) ELSE CAST(0 AS DOUBLE) END AS shared
      FROM documents d LEFT JOIN sums USING (doc_id)""",
    "p10_found": """WITH windows AS (SELECT doc_id, md5(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text) - 298, 1))) AS i FROM documents))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM windows a JOIN windows b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p6_found": f"WITH RECURSIVE {_BOUND} SELECT row_id, min(row_id) OVER (PARTITION BY root) AS group_row_id FROM rooted",
}
