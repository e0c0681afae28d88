"""Runs and FASTA files written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.dna import extract_accession, gc_fraction, rounded, sequence_hash


def save_run(folder: str, tables: dict[str, DataFrame], metadata: dict[str, object]) -> None:
    """One folder per table, as Parquet and as CSV with header, and the metadata as one line of JSON. An existing run is not overwritten."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([{"tables": ",".join(tables)} | {k: str(v) for k, v in metadata.items()}]).coalesce(1).write.mode("errorifexists").json(f"{folder}/run_metadata")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/parquet/{name}")
        flat = df.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
        flat.write.mode("errorifexists").option("header", True).csv(f"{folder}/csv/{name}")


def saved_run(spark, folder: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> dict[str, DataFrame] | None:
    """The tables of a saved run by name; None where a required one is missing, and no entry for an optional one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = {}
    for name in (*required, *optional):
        where = path(f"{folder}/parquet/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found[name] = spark.read.parquet(f"{folder}/parquet/{name}")
        elif name in required:
            return None
    return found


def save_tables(folder: str, tables: dict[str, DataFrame]) -> None:
    """Audit tables as tab-separated text with header, one folder per name; an existing one is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{folder}/{name}")


def write_fasta(records: DataFrame, path: str, name: Column | None = None) -> None:
    """Records (record_id, sequence) as FASTA text, one line per sequence."""
    records.select(F.concat(F.lit(">"), name if name is not None else F.col("record_id"), F.lit("\n"), "sequence").alias("value")).write.text(path)


def record_summary(records: DataFrame) -> DataFrame:
    """Length, G and C percent, accession and hash of every record."""
    s = F.col("sequence")
    return records.select(
        "source_file", "record_id", "description", F.length(s).alias("length_bp"), rounded(gc_fraction(s) * 100, 2).alias("gc_percent"), extract_accession(F.col("record_id"), F.col("description")).alias("accession"), sequence_hash(s).alias("sequence_hash")
    )


def duplicate_records(records: DataFrame, order: str) -> DataFrame:
    """Sequences that occur in several records: the first by order, and the others' file:id joined by semicolons."""
    hashed = records.withColumn("sequence_hash", sequence_hash(F.col("sequence")))
    names = F.sort_array(F.collect_list(F.struct(order, F.concat_ws(":", "source_file", "record_id").alias("name"))))
    per = hashed.groupBy("sequence_hash").agg(F.count("*").alias("records"), names.alias("all")).filter("records > 1")
    return per.select("sequence_hash", "records", F.col("all")[0]["name"].alias("kept_record"), F.array_join(F.transform(F.slice("all", 2, F.size("all")), lambda x: x["name"]), "; ").alias("other_records"))
