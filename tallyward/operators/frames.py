"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COPIES_PER_BLOCK = 4096


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def check_number(name: str, value: float, low: float = 0, high: float | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number, got {type(value).__name__}")
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"{name} must be finite, got {value!r}")
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name}={value} is outside [{low}, {high}]")


def repeat_rows(df: DataFrame, copies: str, number: str | None = None) -> DataFrame:
    """Emit each row ``copies`` times, numbered from 1 in the column ``number`` if there is one to be.

    Done in blocks, so no large array is built.
    """
    blocks = F.ceil(F.col(copies) / F.lit(COPIES_PER_BLOCK)).cast("long")
    left = F.col(copies) - (F.col("block_") - 1) * COPIES_PER_BLOCK
    repeated = (
        df.withColumn("block_", F.explode(F.sequence(F.lit(1).cast("long"), blocks)))
        .withColumn("copy_", F.explode(F.sequence(
            F.lit(1).cast("long"), F.least(left, F.lit(COPIES_PER_BLOCK).cast("long")))))
    )
    if number is not None:
        repeated = repeated.withColumn(number, (F.col("block_") - 1) * COPIES_PER_BLOCK + F.col("copy_"))
    return repeated.drop("block_", "copy_", copies)
