"""Incremental forms of the hourly counts and the address failure counts.

The batch detectors read a whole table; these keep the counts behind them up to date
as login chunks arrive in a folder. State is one row per open window and value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyward.functions.logins import is_failure
from tallyward.sources.logins import normalize_columns


def stream_logins(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """Login chunks (CSV with the given headers) of a folder as a normalised stream."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.readStream.options(header=True, quote='"', escape='"', multiLine=True).schema(schema).csv(folder)
    return normalize_columns(raw)


def hourly_status_counts(logins: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hourBucket, status, cnt) of each finished hour."""
    return (
        logins.filter(F.col("loginTime").isNotNull() & F.col("status").isNotNull())
        .withWatermark("loginTime", late)
        .groupBy(F.window("loginTime", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.col("w.start").alias("hourBucket"), "status", "cnt")
    )


def failures_per_address(logins: DataFrame, window: str = "10 minutes", slide: str = "1 minute",
                         min_failures: int = 10, late: str = "10 minutes") -> DataFrame:
    """Addresses with at least ``min_failures`` failures in a sliding window."""
    return (
        logins.filter(is_failure() & F.col("sourceIp").isNotNull() & F.col("loginTime").isNotNull())
        .withWatermark("loginTime", late)
        .groupBy(F.window("loginTime", window, slide).alias("w"), "sourceIp").agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= min_failures)
        .select("sourceIp", F.col("w.start").alias("windowStart"), F.col("w.end").alias("windowEnd"), "failures")
    )


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet, process what is there, and stop."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
