"""Queries for models, text features, streams and file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.operators import metrics, models, repeat_features, training
from arrayloom.plans.sequences import DATA_SQL, bacteria
from arrayloom.plans.training import labelled
from arrayloom.runtime import shared_folder, table, written
from arrayloom.sources import sequences, sinks
from arrayloom.streaming import events

TREES = 400  # of the reference, at each level of the hierarchy
LEAST = 20  # rows of a class

#: Groups of words counted in page lines. Fixed values.
KEYWORDS = {"trade": ("market", "price", "wharf"), "council": ("council", "mayor", "election"), "ship": ("harbour", "steamer", "cargo")}


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("split = 'train'").drop("split"), rows.filter("split in ('validation', 'test')").drop("split")


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = training.frequent_classes(labelled(spark, folder), "cas_subtype", LEAST).select("row_id", "split", "repeat_sequence", "cas_subtype", F.greatest("spacer_count", F.lit(0)).alias("spacer_count"), "mean_spacer_length")
    return _halves(written(repeat_features.feature_vectors(rows).select("row_id", "split", F.col("cas_subtype").alias("label"), "features"), "vectors"))


def _given(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """As _split, with what repeat_features.matrix reads for features. Labels are read once, and rows dealt among tasks, as the source may be one file."""
    rows = labelled(spark, folder).withColumn("spacer_count", F.greatest("spacer_count", F.lit(0))).select("row_id", "split", F.col("cas_subtype").alias("label"), repeat_features.as_given().alias("features"))
    rows = written(rows.repartition("row_id"), "rows")
    labels = [r.label for r in rows.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST).collect()]
    return _halves(rows.filter(F.col("label").isin(labels)))


def model_forest(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.overall(models.predict(*_given(spark, folder), "forest", TREES, repeat_features.matrix))


def model_logistic(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.overall(models.predict(*_split(spark, folder), "logistic"))


def model_hierarchical(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.overall(models.predict_hierarchical(*_given(spark, folder), training.cas_type, "forest", TREES, repeat_features.matrix))


def model_components(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _split(spark, folder)
    return models.principal_components(train)


def text_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page, and those with a word of each group."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("text"))
    return sequences.keyword_counts(lines, "doc_id", KEYWORDS)


def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of the event stream, read as a stream until all has arrived."""
    schema = table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counted = events.event_windows(arriving.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    done = events.drained(counted, spark, "complete")
    return done.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", (F.rint(F.col("total") * 100) / 100).alias("total"))


def file_fasta_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Bacterial records written as FASTA and read again, summarised."""
    path = f"{shared_folder(spark)}/arrayloom/fasta-{uuid.uuid4().hex}"
    sinks.write_fasta(bacteria(spark, folder).select(F.concat("genome_id", F.lit(" made for checks")).alias("record_id"), "sequence"), path)
    return sinks.record_summary(sequences.fasta(spark, path)).drop("source_file")


QUERIES = {f.__name__: f for f in (model_forest, model_logistic, model_hierarchical, model_components, text_keywords, stream_event_windows, file_fasta_round_trip)}

ORACLE = {
    "text_keywords": "WITH l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS t FROM documents) SELECT doc_id, count(*) AS features, "
    + ", ".join(f"count(*) FILTER ({' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)}) AS {name}_count" for name, words in KEYWORDS.items())
    + " FROM l GROUP BY 1",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS events, round_even(sum(value) * 100.0, 0) / 100.0 AS total FROM events GROUP BY ALL",
    "file_fasta_round_trip": f"""WITH {DATA_SQL}, r AS (SELECT genome_id, fa || r || s1 || r || s2 || r || s3 || r || fz AS s FROM bact)
      SELECT genome_id AS record_id, genome_id || ' made for checks' AS description, length(s) AS length_bp, round_even((length(s) - length(translate(s, 'GC', ''))) / length(s) * 100 * 100.0, 0) / 100.0 AS gc_percent, '' AS accession, sha256(s) AS sequence_hash FROM r""",
}
