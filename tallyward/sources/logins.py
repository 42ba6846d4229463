"""Reading login exports and mapping them to the canonical columns."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.fixed import (
    EXPORT_ROW_LIMIT, HEADER_TO_CANONICAL, SOURCE_EVENT_LOG, SOURCE_QUERY, SOURCE_UI, SOURCE_UNKNOWN,
)
from tallyward.functions.times import parse_login_time


def sniff_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Header names of a CSV export."""
    return spark.read.options(header=True, quote='"', escape='"').csv(path).columns


#: Headers that tell an export, in the order of the tests.
TELLING_HEADERS = (
    (SOURCE_EVENT_LOG, ("EVENT_TYPE", "TIMESTAMP")), (SOURCE_QUERY, ("UserId", "LoginTime")), (SOURCE_UI, ("Login Time",)))


def detect_source(columns: Sequence[str]) -> str:
    """Which of the known exports the headers come from. A header like ``SOME_NAME`` alone tells an event log."""
    complete = [label for label, headers in TELLING_HEADERS if all(h in columns for h in headers)]
    shouted = [c for c in columns if re.fullmatch(r"[^a-z]*[A-Z][^a-z]*", c) and "_" in c]
    return SOURCE_EVENT_LOG if shouted else complete[0] if complete else SOURCE_UNKNOWN


def read_login_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as strings; quotes double inside quotes; broken rows are skipped.

    Quoted line breaks make a file one task: write the result once with
    ``write_parquet_cache`` and read that from then on.
    """
    names = list(columns) if columns is not None else sniff_columns(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.options(header=True, quote='"', escape='"', mode="DROPMALFORMED", multiLine=True)
        .schema(schema).csv(path)
    )


def rejected_login_rows(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that ``read_login_csv`` skips, as they stand in the file (``raw``)."""
    names = list(columns) if columns is not None else sniff_columns(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "raw")])
    rows = (
        spark.read.options(header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=True, columnNameOfCorruptRecord="raw")
        .schema(schema).csv(path)
    )
    # the reader refuses a query of the raw rows alone, so the filter names the other columns too
    read = F.length(F.concat_ws(",", *[F.col(f"`{n}`") for n in names])) >= 0
    return rows.filter(F.col("raw").isNotNull() & read).select("raw", *[F.col(f"`{n}`") for n in names])


def read_login_json(spark: SparkSession, path: str | list[str], columns: Sequence[str],
                    multi_line: bool = False) -> DataFrame:
    """Query results as JSON; the named fields as strings."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
    return spark.read.option("multiLine", multi_line).schema(schema).json(path)


def rename_known(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keep the known headers under canonical names, the first header wins, and the columns of ``keep``."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        canonical = HEADER_TO_CANONICAL.get(column)
        if canonical and canonical not in chosen:
            chosen[canonical] = column
    if not chosen:
        raise ValueError(f"no known login columns among {df.columns}")
    return df.select(*[F.col(f"`{raw}`").alias(name) for name, raw in chosen.items()], *keep)


def normalize_columns(df: DataFrame, source_tz: str | None = None,
                      extra_formats: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical columns with ``loginTime`` as a UTC timestamp; columns of ``keep`` stay beside them."""
    known = rename_known(df, keep)
    if "loginTime" not in known.columns:
        return known
    others = [c for c in known.columns if c != "loginTime"]
    return known.select(
        *others, parse_login_time(F.col("loginTime"), source_tz, extra_formats).alias("loginTime"))


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Concatenate pulls of successive date ranges."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


def _bounds(window: str, as_of: datetime.datetime) -> tuple[datetime.datetime, datetime.datetime | None]:
    today = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    day = datetime.timedelta(days=1)
    week = today - day * ((today.weekday() + 1) % 7)
    named = {
        "TODAY": (today, today + day),
        "YESTERDAY": (today - day, today),
        "THIS_WEEK": (week, week + 7 * day),
        "LAST_WEEK": (week - 7 * day, week),
    }
    if window in named:
        return named[window]
    kind, _, count = window.partition(":")
    if kind == "LAST_N_DAYS":
        return today - int(count) * day, None
    if kind == "LAST_N_HOURS":
        hour = as_of.replace(minute=0, second=0, microsecond=0)
        return hour - datetime.timedelta(hours=int(count)), None
    raise ValueError(f"unknown window {window!r}")


def recent_window(df: DataFrame, window: str, as_of: datetime.datetime, column: str = "loginTime") -> DataFrame:
    """Rows of a relative window: ``LAST_N_DAYS:7``, ``LAST_N_HOURS:3``, ``TODAY``, ``YESTERDAY``,
    ``THIS_WEEK``, ``LAST_WEEK`` (weeks begin on Sunday)."""
    lower, upper = _bounds(window, as_of)
    return between_times(df, lower, upper, column)


def between_times(df: DataFrame, lower: datetime.datetime | None, upper: datetime.datetime | None,
                  column: str = "loginTime", include_upper: bool = False) -> DataFrame:
    """Rows at or after ``lower`` and before (or up to) ``upper``; pushed to the scan."""
    time = F.col(column)
    if lower is not None:
        df = df.filter(time >= F.lit(lower.isoformat(sep=" ")).cast("timestamp"))
    if upper is not None:
        limit = F.lit(upper.isoformat(sep=" ")).cast("timestamp")
        df = df.filter(time <= limit if include_upper else time < limit)
    return df


def calendar_counts(df: DataFrame, column: str = "loginTime") -> DataFrame:
    return df.groupBy(F.year(column).alias("year"), F.month(column).alias("month")).agg(
        F.count(F.lit(1)).alias("logins"))


def truncation_flag(df: DataFrame, limit: int = EXPORT_ROW_LIMIT) -> DataFrame:
    """One row: a pull of exactly ``limit`` rows was cut off. Reads at most one row more."""
    return df.limit(limit + 1).agg((F.count(F.lit(1)) == limit).alias("truncated"))


def is_truncated(df: DataFrame, limit: int = EXPORT_ROW_LIMIT) -> bool:
    return truncation_flag(df, limit).first()["truncated"]


def latest_rows(df: DataFrame, limit: int = EXPORT_ROW_LIMIT, column: str = "loginTime") -> DataFrame:
    """Newest first, at most ``limit`` rows."""
    return df.orderBy(F.col(column).desc_nulls_last()).limit(limit)
