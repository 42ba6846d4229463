"""Text files as a table (grp, path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.fixed import MARKER_FILE, MAX_TEXT_BYTES
from tallyward.functions.text import file_name, path_parts


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``root`` by path relative to it; bad UTF-8 is replaced; files above ``max_bytes``, if given, are left out."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        binary = binary.filter(F.col("length") <= max_bytes)
    prefix = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), prefix, -1)
    return visible(binary.select(
        relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        F.col("length").alias("size_bytes")))


def visible(files: DataFrame) -> DataFrame:
    """Without files below ``.git``."""
    return files.filter(~F.array_contains(path_parts(F.col("path")), ".git"))


def _size(files: DataFrame) -> Column:
    return F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("text")


def within_size(files: DataFrame, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    return files.filter(_size(files) <= max_bytes)


def oversized(files: DataFrame, max_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """What a scan with this limit skips: path and size in bytes."""
    return files.filter(_size(files) > max_bytes).select("path", _size(files).cast("long").alias("size_bytes"))


def folders_above(path: Column) -> Column:
    """The path itself and all folders above it, the root as an empty string."""
    parts = path_parts(path)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def marked_folders(files: DataFrame, marker: str = MARKER_FILE) -> DataFrame:
    """Folders that hold a file named ``marker``."""
    parts = path_parts(F.col("path"))
    return (
        files.filter(file_name(F.col("path")) == marker)
        .select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder")).distinct()
    )


def nearest_marked_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """Add ``grp``, the nearest marked folder at or above each path; paths without one are dropped."""
    above = paths.select("*", F.explode(folders_above(F.col("path"))).alias("folder"))
    found = above.join(folders, "folder")
    others = [c for c in paths.columns if c != "path"]
    return found.groupBy("path", *others).agg(F.max_by("folder", F.length("folder")).alias("grp"))


def changed_groups(changed: DataFrame, files: DataFrame, marker: str = MARKER_FILE) -> DataFrame:
    """Marked folders touched by a list of changed paths."""
    return nearest_marked_folder(changed.select("path").distinct(), marked_folders(files, marker)).select("grp").distinct()
