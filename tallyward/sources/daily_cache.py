"""A Parquet cache by day that follows a folder of login exports: only days that a changed file touches are written again.

Beside the days lies a manifest: each source file with its size, time of change and header, and the days of its rows. A
refresh compares it with the folder, however deep its files lie. New and changed files are read once and staged; rows of
other files on the same days come from the cache itself. The touched days are then replaced as whole partitions, days
without rows go, and the manifest is written last. Until then a note names the touched days: a refresh that finds such a
note, because the one before broke off, reads every file of these days again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.session import written
from tallyward.sources.logins import normalize_columns, read_login_csv, sniff_columns, union_chunks
from tallyward.sources.sinks import path_exists

MANIFEST, NOTE = "_manifest", "_touched"
MANIFEST_SCHEMA = "path string, bytes long, changed long, header array<string>, day string"
#: Name of the day of rows without a time.
NO_DAY = "none"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: source files read, days written, days removed."""

    files: tuple[str, ...]
    days: tuple[str, ...]
    removed: tuple[str, ...]


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def source_files(spark: SparkSession, source: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of each file below a folder (or of one file); hidden files and folders are left out."""
    fs, root = _file_system(spark, source)
    base = fs.makeQualified(root).toString().rstrip("/")
    found, listed = {}, fs.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toString()
        below = path.removeprefix(base).split("/")
        if not any(name.startswith((".", "_")) for name in below):
            found[path] = (status.getLen(), status.getModificationTime())
    return found


def _day(date: Column) -> Column:
    return F.coalesce(date.cast("string"), F.lit(NO_DAY))


def _rows(spark: SparkSession, headers: dict[str, tuple[str, ...]], source_tz: str | None) -> DataFrame:
    """Rows of the files with canonical columns, their file and their date; files of one header are read together."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers.items():
        groups.setdefault(header, []).append(path)
    chunks = []
    for header, paths in groups.items():
        raw = read_login_csv(spark, paths, header)
        known = normalize_columns(raw.select("*", F.col("_metadata.file_path").alias("sourceFile")), source_tz, keep=("sourceFile",))
        chunks.append(known.withColumn("loginDate", F.to_date("loginTime")))
    return union_chunks(chunks)


def refresh_daily_cache(spark: SparkSession, source: str, cache: str, source_tz: str | None = None) -> Refresh:
    """Brings the cache up to the source; every day that no changed, new or lost file touches stays as it is."""
    cache = cache.rstrip("/")
    now = source_files(spark, source)
    manifest, note = f"{cache}/{MANIFEST}", f"{cache}/{NOTE}"
    complete = path_exists(spark, f"{manifest}/_SUCCESS")
    old = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest) if complete else spark.createDataFrame([], MANIFEST_SCHEMA)
    old = written(old, "manifest")  # the folder is written again below
    known = {r.path: (r.bytes, r.changed, tuple(r.header)) for r in old.select("path", "bytes", "changed", "header").distinct().collect()}
    broken = [r.day for r in spark.read.schema("day string").json(note).collect()] if path_exists(spark, note) else []
    again = {r.path for r in old.filter(F.col("day").isin(broken)).select("path").distinct().collect()} if broken else set()
    lost = set(known) - set(now)
    fresh = sorted(p for p in now if p in again or p not in known or known[p][:2] != now[p])
    if not fresh and not lost and complete:
        return Refresh((), (), ())

    headers = {p: tuple(sniff_columns(spark, p)) for p in fresh}
    staged = written(_rows(spark, headers, source_tz), "fresh-logins") if fresh else None
    touched_rows = old.filter(F.col("path").isin(sorted(lost | set(fresh)))).select("path", "day").filter("day IS NOT NULL").select("day")
    if staged is not None:
        touched_rows = touched_rows.unionByName(staged.select(_day(F.col("loginDate")).alias("day")))
    touched = sorted({r.day for r in touched_rows.distinct().collect()} | set(broken))

    parts = [] if staged is None else [staged]
    kept_days = [r.day for r in old.filter(F.col("day").isin(touched) & ~F.col("path").isin(sorted(lost | set(fresh)))).select("day").distinct().collect()]
    if kept_days:
        kept = spark.read.parquet(cache).filter(_day(F.col("loginDate")).isin(kept_days) & ~F.col("sourceFile").isin(sorted(lost | set(fresh))))
        parts.append(written(kept, "kept-logins"))
    spark.createDataFrame([(d,) for d in touched], "day string").coalesce(1).write.mode("overwrite").json(note)
    held: list[str] = []
    if parts:
        rows = union_chunks(parts)
        held = [r.day for r in rows.select(_day(F.col("loginDate")).alias("day")).distinct().collect()]
        (rows.repartitionByRange("loginDate", "loginTime").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "snappy").partitionBy("loginDate").parquet(cache))
    removed = sorted(set(touched) - set(held))
    for day in removed:
        fs, folder = _file_system(spark, f"{cache}/loginDate={'__HIVE_DEFAULT_PARTITION__' if day == NO_DAY else day}")
        fs.delete(folder, True)

    files = spark.createDataFrame([(p, *now[p], list(headers[p])) for p in fresh], "path string, bytes long, changed long, header array<string>")
    days = (staged.select(F.col("sourceFile").alias("path"), _day(F.col("loginDate")).alias("day")).distinct()
            if staged is not None else spark.createDataFrame([], "path string, day string"))
    same = old.filter(~F.col("path").isin(sorted(lost | set(fresh))))
    same.unionByName(files.join(days, "path", "left")).write.mode("overwrite").parquet(manifest)
    fs, folder = _file_system(spark, note)
    fs.delete(folder, True)
    return Refresh(tuple(fresh), tuple(held), tuple(removed))


def daily_logins(spark: SparkSession, source: str, cache: str, source_tz: str | None = None,
                 days: Sequence[str] | None = None) -> DataFrame:
    """Logins of the source as they are now, through the cache; ``days`` (ISO dates) are the only ones read."""
    refresh_daily_cache(spark, source, cache, source_tz)
    rows = spark.read.parquet(cache)
    return rows if days is None else rows.filter(F.col("loginDate").isin([F.lit(d).cast("date") for d in days]))
