"""Streams: windowed counts over arriving events, and sequence records landing in a folder without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.runtime import shared_folder


def drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """What a stream holds after all that has arrived: the last output, written to the shared folder."""
    base = f"{shared_folder(spark)}/arrayloom/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, distinct values' sum per window and type. events is a stream or a table with ts, event_type, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def new_records(records: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of sequence records without sequences already seen: needs sequence_hash and landed_at."""
    return records.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["sequence_hash"])
