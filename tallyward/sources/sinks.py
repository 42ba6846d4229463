"""Writing tables: Parquet cache, filtered rows, findings and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.logins import is_api_subtype

CACHE_THRESHOLD_MB = 500


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes below a path, from the file system's metadata."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def changed_at(spark: SparkSession, path: str) -> int:
    """Latest change of a file, or of the files below a folder at any depth, in milliseconds."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    latest, files = fs.getFileStatus(hadoop_path).getModificationTime(), fs.listFiles(hadoop_path, True)
    while files.hasNext():
        latest = max(latest, files.next().getModificationTime())
    return latest


def is_complete(spark: SparkSession, path: str, source: str | None = None) -> bool:
    """A finished table (its writer left ``_SUCCESS``) that is not older than ``source``."""
    mark = f"{path.rstrip('/')}/_SUCCESS"
    return path_exists(spark, mark) and (source is None or changed_at(spark, mark) >= changed_at(spark, source))


def write_parquet_cache(df: DataFrame, path: str, partition_by_date: bool = False, source: str | None = None) -> None:
    """Snappy Parquet, written once: a finished cache that is not older than ``source`` stays as it is.

    By date, files are pruned by ``loginDate``; rows are spread over ranges of date and time that are
    as even as the sort can make them, so a busy day is not one task.
    """
    if is_complete(df.sparkSession, path, source):
        return
    writer_rows = df
    if partition_by_date:
        writer_rows = df.withColumn("loginDate", F.to_date("loginTime")).repartitionByRange("loginDate", "loginTime")
    writer = writer_rows.write.mode("overwrite").option("compression", "snappy")
    if partition_by_date:
        writer = writer.partitionBy("loginDate")
    writer.parquet(path)


def read_parquet_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_logins(spark: SparkSession, csv_path: str, threshold_mb: float = CACHE_THRESHOLD_MB,
                  cache_path: str | None = None) -> DataFrame:
    """Raw known columns of a CSV, through the Parquet cache when the file is large.

    The rows are those of the CSV as it is now either way: a cache that is older or unfinished is written anew.
    """
    from tallyward.sources.logins import read_login_csv, rename_known

    if file_size(spark, csv_path) <= threshold_mb * 1024 * 1024:
        return rename_known(read_login_csv(spark, csv_path))
    cache_path = cache_path or f"{csv_path}.parquet"
    write_parquet_cache(rename_known(read_login_csv(spark, csv_path)), cache_path, source=csv_path)
    return read_parquet_cache(spark, cache_path)


def write_filtered_csv(df: DataFrame, subtypes: Sequence[str], path: str) -> int:
    """All columns of the matching rows as CSV with a header; the row count comes from the same pass."""
    seen = Observation("filtered")
    rows = df.filter(is_api_subtype(F.col("loginSubType"), subtypes)).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.option("header", True).csv(path)
    return seen.get["rows"]


def write_findings(name: str, df: DataFrame, folder: str, order: Sequence[str | Column] = ()) -> int:
    """One CSV folder per detector, its part files in ``order``; nothing is kept for an empty result."""
    seen = Observation(f"findings-{name}")
    target = f"{folder.rstrip('/')}/{name}"
    # counted behind the sort: its sampling may read the rows once more
    rows = (df.orderBy(*order) if order else df).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.option("header", True).csv(target)
    count = seen.get["rows"]
    if count == 0:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return count


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)
