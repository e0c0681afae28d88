"""Queries of the general problems: orphan references and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.operators.references import cell_values, find_orphans, last_path_element, orphan_counts
from arrayloom.operators.unpack import known_values, unpack
from arrayloom.runtime import table

#: cited field -> (type of the record it cites, whether it names a file)
CITED = {
    "bacterial_accession": ("bacterium", False),
    "phage_accession": ("phage", False),
    "local_bacterium_file": ("bacterium", True),
}


def citations(labels: DataFrame) -> DataFrame:
    """One row per label, field and cited value, with the composite key (record type, accession, file)."""
    cited = F.array(
        *[
            F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.lit(is_file).alias("is_file"), cell_values(F.col(field)).alias("values"))
            for field, (kind, is_file) in CITED.items()
        ]
    )
    rows = labels.select("label_id", "labelled_at", F.explode(cited).alias("c")).select(
        "label_id", "labelled_at", "c.field_name", "c.kind", "c.is_file", F.explode("c.values").alias("ref_value")
    )
    written_so = F.lower(F.col("ref_value"))
    return rows.select(
        "label_id",
        "labelled_at",
        "field_name",
        "ref_value",
        "kind",
        F.when(~F.col("is_file"), written_so).alias("accession"),
        F.when(F.col("is_file"), F.trim(last_path_element(written_so))).alias("file"),
    )


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "downloaded_records").select(
        F.lower(F.trim("record_type")).alias("kind"),
        F.lower(F.regexp_replace("accession", r"^\s+|\s+$", "")).alias("accession"),
        F.lower(F.trim(last_path_element(F.regexp_replace("local_path", r"^\s+|\s+$", "")))).alias("file"),
        "downloaded_at",
        "withdrawn_at",
    )
    return find_orphans(
        citations(table(spark, folder, "benchmark_labels")),
        records,
        {"kind": "kind", "accession": "accession", "file": "file"},
        match="partial",
        as_of="labelled_at",
        live_from="downloaded_at",
        live_until="withdrawn_at",
    ).dropDuplicates(["label_id", "field_name", "ref_value"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("label_id", "field_name", "ref_value")


def p1_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder), "field_name", "labelled_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    keys = known_values(table(spark, folder, "literature_sources"), "source_key")
    subtypes = known_values(table(spark, folder, "sampling_targets").filter("field_name = 'cas_subtype'"), "category")
    parts = [
        unpack(table(spark, folder, name), key, cell, known, name)
        for name, key, cell, known in (
            ("benchmark_labels", "label_id", "source_keys", keys),
            ("proof_of_concept_pairs", "poc_id", "source_keys", keys),
            ("candidate_repeat_conflicts", "conflict_id", "subtypes", subtypes),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_values_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value is cited, over how many rows, and whether the dictionary lists it."""
    listed = table(spark, folder, "literature_sources").select(F.trim("source_key").alias("value_text")).distinct().withColumn("is_listed", F.lit(True))
    counted = p5_found(spark, folder).groupBy("table_name", "value_text").agg(F.count("*").alias("citations"), F.countDistinct("row_key").alias("rows_citing"))
    return counted.join(listed, "value_text", "left").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))


QUERIES = {
    "p1_found": p1_found,
    "p1_orphans_by_month": p1_orphans_by_month,
    "p5_found": p5_found,
    "p5_values_by_source": p5_values_by_source,
}

_CITED_SQL = """cited AS (
  SELECT DISTINCT label_id, labelled_at, field_name, kind, regexp_replace(v, '^[\\s"'']+|[\\s"'']+$', '', 'g') AS ref_value
  FROM (SELECT label_id, labelled_at, 'bacterial_accession' AS field_name, 'bacterium' AS kind, unnest(regexp_split_to_array(bacterial_accession, '[;,|]')) AS v FROM benchmark_labels
    UNION ALL SELECT label_id, labelled_at, 'phage_accession', 'phage', unnest(regexp_split_to_array(phage_accession, '[;,|]')) FROM benchmark_labels
    UNION ALL SELECT label_id, labelled_at, 'local_bacterium_file', 'bacterium', unnest(regexp_split_to_array(local_bacterium_file, '[;,|]')) FROM benchmark_labels)),
orphans AS (
  SELECT * FROM cited c WHERE ref_value <> '' AND NOT EXISTS (
    SELECT 1 FROM downloaded_records d WHERE lower(trim(d.record_type)) = c.kind
      AND d.downloaded_at <= c.labelled_at AND (d.withdrawn_at IS NULL OR d.withdrawn_at > c.labelled_at)
      AND CASE WHEN c.field_name = 'local_bacterium_file'
          THEN lower(trim(regexp_extract(trim(d.local_path), '([^/\\\\]*)$', 1))) = lower(trim(regexp_extract(c.ref_value, '([^/\\\\]*)$', 1)))
          ELSE lower(trim(d.accession)) = lower(c.ref_value) END))"""

_VALUES_SQL = """cells AS (
  SELECT 'benchmark_labels' AS table_name, label_id AS row_key, source_keys AS cell FROM benchmark_labels
  UNION ALL SELECT 'proof_of_concept_pairs', poc_id, source_keys FROM proof_of_concept_pairs
  UNION ALL SELECT 'candidate_repeat_conflicts', conflict_id, subtypes FROM candidate_repeat_conflicts),
pieces AS (SELECT table_name, row_key, list_filter(list_transform(
    regexp_extract_all(cell, '"[^"]*"|''[^'']*''|[A-Za-z][A-Za-z0-9_.\\-]*'),
    lambda p: trim(trim(p, '"'' '))), lambda p: p <> '') AS vals FROM cells WHERE cell <> ''),
found AS (SELECT table_name, row_key, unnest(range(1, len(vals) + 1)) AS value_position, unnest(vals) AS value_text FROM pieces)"""

ORACLE = {
    "p1_found": f"WITH {_CITED_SQL} SELECT label_id, field_name, ref_value FROM orphans",
    "p1_orphans_by_month": f"WITH {_CITED_SQL} SELECT field_name, strftime(labelled_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p5_found": f"WITH {_VALUES_SQL} SELECT table_name, row_key, value_position, value_text FROM found",
    "p5_values_by_source": f"""WITH {_VALUES_SQL} SELECT table_name, value_text, count(*) AS citations, count(DISTINCT row_key) AS rows_citing,
  value_text IN (SELECT trim(source_key) FROM literature_sources) AS is_listed FROM found GROUP BY table_name, value_text""",
}
