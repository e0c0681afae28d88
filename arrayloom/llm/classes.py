"""Equal rows are joined once: classes of rows with equal keys, and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_members(pairs: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """pairs with each class id in column replaced by its members' row ids.

    members: (class_id, row_id) of the classes with more than one row; any
    other class is its only row.
    """
    rows = members.select(F.col("class_id").alias("_c"), F.col("row_id").alias("_r"))
    return pairs.join(rows, F.col(column) == F.col("_c"), "left").withColumn(column, F.coalesce("_r", column)).drop("_c", "_r")


def members_of(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """(class_id, row_id) for the classes that hold more than one row."""
    many = classes.filter("n > 1").select(*keys, "class_id")
    return rows.join(many, keys).select("class_id", "row_id")
