"""Session helpers: reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests on local[n]) a temporary folder is set
    once for the session; on a cluster its absence is an error, as a folder of
    one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(context, "_arrayloom_folder", None)
        if folder is None:
            folder = context._arrayloom_folder = "file://" + tempfile.mkdtemp(prefix="arrayloom-")
    return folder.rstrip("/")


def written(df: DataFrame, what: str, **options) -> DataFrame:
    """df written (with the writer's options) to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arrayloom/{what}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result._arrayloom_path = path
    return result


def discard(df: DataFrame) -> None:
    """Deletes what written() made for df; only for tables that nothing lazy still reads."""
    path = getattr(df, "_arrayloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
