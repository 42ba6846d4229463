"""Which files of an inventory to export, under which names, and what to do with each."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.fixed import (
    ATTACHMENT_ID_PREFIX, LARGE_FILE_BYTES, PARENT_FOLDERS, PARENT_TYPES, VERSION_ID_PREFIX,
)
from tallyward.functions.names import (
    as_it_is, bracket_id, composed, filled, folder_name, instant_text, is_ascii, is_blank, normalized_id, path_key, segment_key,
    target_file_name,
)
from tallyward.operators.frames import repeat_rows
from tallyward.operators.timeline import collapsed

FILE = "FILE"
ID_SCHEMA = "kind string, id string"


@dataclass(frozen=True)
class ExportOptions:
    """Dates are days in UTC; ``until`` days are included. Empty collections do not filter."""

    modified_since: datetime.date | None = None
    modified_until: datetime.date | None = None
    created_since: datetime.date | None = None
    created_until: datetime.date | None = None
    types: tuple[str, ...] = ()


def parent_type(value: Column) -> Column:
    """``account``, ``Accounts`` and so on to ``ACCOUNT``; NULL when unknown."""
    upper = F.regexp_replace(F.upper(F.trim(value)), r"S\z", "")
    return F.when(upper.isin(list(PARENT_TYPES)), upper)


def parse_types(names: Iterable[str]) -> tuple[str, ...]:
    types = []
    for name in names:
        upper = name.strip().upper().removesuffix("S")
        if upper not in PARENT_TYPES:
            raise ValueError(f"unknown parent type {name!r}")
        types.append(upper)
    return tuple(types)


def filter_dates_and_types(inventory: DataFrame, options: ExportOptions) -> DataFrame:
    """A missing date fails an active date filter. Pushed to the scan where the columns allow."""
    day = datetime.timedelta(days=1)

    def start(date: datetime.date) -> Column:
        return F.lit(f"{date.isoformat()} 00:00:00").cast("timestamp")

    rows = inventory
    if options.types:
        rows = rows.filter(F.col("parentType").isin(list(options.types)))
    for column, since, until in (("lastModified", options.modified_since, options.modified_until),
                                 ("created", options.created_since, options.created_until)):
        if since is not None:
            rows = rows.filter(F.col(column) >= start(since))
        if until is not None:
            rows = rows.filter(F.col(column) < start(until + day))
    return rows


def id_filters(spark: SparkSession, files: Iterable[str] = (), accounts: Iterable[str] = (),
               opportunities: Iterable[str] = (), contracts: Iterable[str] = ()) -> DataFrame:
    """Wanted ids (kind, id) out of job parameters."""
    named = ((FILE, files), ("ACCOUNT", accounts), ("OPPORTUNITY", opportunities), ("CONTRACT", contracts))
    rows = [(kind, i.strip().upper()) for kind, ids in named for i in ids if i.strip()]
    return spark.createDataFrame(rows, ID_SCHEMA)


def id_filters_from_report(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted ids and parent types out of an error report of an earlier run.

    Ids are upper-cased before they are compared, also those of 15 characters that
    differ by case alone.
    """
    kind = parent_type(F.col("type"))
    segments = F.split("folderPath", "/")
    has_path = ~is_blank(F.col("folderPath"))
    last, first = bracket_id(F.element_at(segments, -1)), bracket_id(F.element_at(segments, 1))

    def entry(kind_: Column, id_: Column) -> Column:
        return F.struct(kind_.alias("kind"), id_.alias("id"))

    found = F.array(
        entry(F.lit(FILE), normalized_id(F.col("downloadId"))), entry(F.lit(FILE), bracket_id(F.col("targetFileName"))),
        entry(kind, F.when(has_path, last)),
        entry(F.lit("ACCOUNT"), F.when(has_path & kind.isin("OPPORTUNITY", "CONTRACT"), first)))
    ids = (
        report.select(F.explode(found).alias("f")).select("f.kind", "f.id")
        .filter(F.col("kind").isNotNull() & F.col("id").isNotNull()).distinct()
    )
    types = report.select(kind.alias("parentType")).filter("parentType IS NOT NULL").distinct()
    return ids, types


def union_filters(*filters: DataFrame) -> DataFrame:
    table = filters[0]
    for other in filters[1:]:
        table = table.unionByName(other)
    return table.distinct()


def filter_ids(inventory: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ids are wanted. A kind without ids does not filter; ids may repeat.

    A file matches by download or naming id. An account's files match by parent id,
    others by parent id and by account id. Which kinds filter is a scalar subquery; kinds that no file has play no part.
    Each row names the (kind, id) keys that it needs, one equi-join finds the wanted ones, and they are put together again
    per row; equal rows count as one until the end. A row without needs skips the join.
    """
    wanted = ids.select(F.col("kind").alias("key_kind"), F.col("id").alias("key_id")).distinct()
    named = ids.agg(F.coalesce(F.collect_set(F.when(F.col("kind").isin(FILE, *PARENT_TYPES), F.col("kind"))), F.array()).alias("kinds")).scalar()

    def asked(kind: Column) -> Column:
        return F.coalesce(F.array_contains(named, kind), F.lit(False))

    def key(need: int, kind: Column, id_: str) -> Column:
        return F.struct(F.lit(need).alias("need"), kind.alias("key_kind"), normalized_id(F.col(id_)).alias("key_id"))

    file, parent = asked(F.lit(FILE)), asked(F.col("parentType"))
    account = asked(F.lit("ACCOUNT")) & ~F.coalesce(F.col("parentType") == "ACCOUNT", F.lit(False))
    rows = collapsed(inventory, "copies_").withColumns({"file_": file, "parent_": parent, "account_": account})
    needs = F.when(F.col("file_"), 1).otherwise(0) + F.when(F.col("parent_"), 2).otherwise(0) + F.when(F.col("account_"), 4).otherwise(0)
    keys = F.array_compact(F.array(
        F.when(F.col("file_"), key(1, F.lit(FILE), "downloadId")), F.when(F.col("file_"), key(1, F.lit(FILE), "namingId")),
        F.when(F.col("parent_"), key(2, F.col("parentType"), "parentId")),
        F.when(F.col("account_"), key(4, F.lit("ACCOUNT"), "accountId"))))
    own = [*inventory.columns, "copies_"]
    rows = rows.select(*own, needs.alias("needs_"), keys.alias("keys_"))
    met = (
        rows.filter("needs_ > 0").select(*own, "needs_", F.explode("keys_").alias("key_")).select(*own, "needs_", "key_.*")
        .join(wanted, ["key_kind", "key_id"])
        .groupBy(*own, "needs_").agg(F.bit_or("need").alias("found_")).filter("found_ = needs_")
    )
    return repeat_rows(rows.filter("needs_ = 0").select(*own).unionByName(met.select(*own)), "copies_")


def filter_types(inventory: DataFrame, types: DataFrame) -> DataFrame:
    return inventory.join(types, "parentType", "left_semi")


def with_targets(inventory: DataFrame) -> DataFrame:
    """Add ``targetFileName`` and ``folderPath`` (account folder, kind folder, parent folder).

    Only rows with a name beyond ASCII go through a Python worker, for their Unicode form.
    """
    plain = is_ascii(*[F.col(c) for c in ("baseName", "extension", "accountName", "parentName")])
    return _targets(inventory.filter(plain), as_it_is).unionByName(_targets(inventory.filter(~plain), composed))


def _targets(inventory: DataFrame, nfc: Callable[[Column], Column]) -> DataFrame:
    kind = F.col("parentType")
    account = F.when((kind != "ACCOUNT") & ~is_blank(F.col("accountId")),
                     folder_name(filled(F.col("accountName")), F.col("accountId"), nfc))
    middle = F.when(kind == "OPPORTUNITY", PARENT_FOLDERS["OPPORTUNITY"]).when(
        kind == "CONTRACT", PARENT_FOLDERS["CONTRACT"])
    parent = folder_name(F.col("parentName"), F.col("parentId"), nfc)
    return inventory.withColumns({
        "targetFileName": target_file_name(F.col("baseName"), F.col("namingId"), F.col("extension"), nfc),
        "folderPath": F.concat_ws("/", account, middle, parent)})


def size_class(size: Column) -> Column:
    return F.when(size >= LARGE_FILE_BYTES, "chunked").otherwise("single")


def endpoint(download_id: Column) -> Column:
    """``version``, ``attachment`` or NULL for an unsupported id."""
    return F.when(download_id.startswith(VERSION_ID_PREFIX), "version").when(
        download_id.startswith(ATTACHMENT_ID_PREFIX), "attachment")


def existing_keys(existing: DataFrame, kind: str) -> DataFrame:
    """Existing files or folders (folderPath, name, kind) by keys that survive renames."""
    return existing.filter(F.col("kind") == kind).select(
        path_key(F.col("folderPath")).alias("folderKey"), segment_key(F.col("name")).alias("targetKey"),
        "folderPath", "name")


def plan_files(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """``upload`` for the first file of each missing (folder, key), ``skip`` for all others.

    Copies of a row are counted in ``files``. The first is the one with the smallest id and name.
    """
    keyed = (
        targets.groupBy("folderPath", "targetFileName", "downloadId").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"folderKey": path_key(F.col("folderPath")), "targetKey": segment_key(F.col("targetFileName"))})
    )
    first = keyed.groupBy("folderKey", "targetKey").agg(
        F.min(F.struct("downloadId", "targetFileName", "folderPath")).alias("first"))
    have = existing_keys(existing, "file").select("folderKey", "targetKey").distinct().withColumn("exists", F.lit(True))
    status = first.join(have, ["folderKey", "targetKey"], "left")
    planned = keyed.join(status, ["folderKey", "targetKey"])
    wins = (F.col("first") == F.struct("downloadId", "targetFileName", "folderPath")) & F.col("exists").isNull()
    uploads = F.when(wins, 1).otherwise(0).cast("long")
    actions = F.array(
        F.struct(F.lit("upload").alias("action"), uploads.alias("files")),
        F.struct(F.lit("skip").alias("action"), (F.col("copies") - uploads).alias("files")))
    return (
        planned.select("folderPath", "targetFileName", "downloadId", F.inline(actions)).filter("files > 0")
    )


def plan_file_renames(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing files that have a wanted id under another name."""
    wanted = (
        targets.select(path_key(F.col("folderPath")).alias("folderKey"),
                       segment_key(F.col("targetFileName")).alias("targetKey"), "downloadId", "targetFileName")
        .filter(F.col("targetKey").startswith("#"))
        .groupBy("folderKey", "targetKey").agg(F.min(F.struct("downloadId", "targetFileName")).alias("first"))
    )
    return (
        existing_keys(existing, "file").join(wanted, ["folderKey", "targetKey"])
        .filter(F.col("name") != F.col("first.targetFileName"))
        .select("folderPath", "name", F.col("first.targetFileName").alias("newName"))
    )


def wanted_folders(targets: DataFrame) -> DataFrame:
    """Every folder on the way to a target: (folderPath of its parent, name)."""
    parts = F.split("folderPath", "/")
    level = F.sequence(F.lit(1), F.size(parts))
    steps = F.transform(level, lambda n: F.struct(
        F.array_join(F.slice(parts, 1, n - 1), "/").alias("folderPath"), F.element_at(parts, n).alias("name")))
    return targets.select("folderPath").distinct().select(F.explode(steps).alias("s")).select("s.*").distinct()


def plan_folders(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """``create`` for missing folders, ``rename`` for folders found by id under another name."""
    wanted = (
        wanted_folders(targets)
        .select(path_key(F.col("folderPath")).alias("folderKey"), segment_key(F.col("name")).alias("targetKey"),
                "folderPath", "name")
        .groupBy("folderKey", "targetKey").agg(F.min(F.struct("folderPath", "name")).alias("want"))
    )
    have = existing_keys(existing, "folder").groupBy("folderKey", "targetKey").agg(F.min("name").alias("oldName"))
    joined = wanted.join(have, ["folderKey", "targetKey"], "left")
    return (
        joined.filter(F.col("oldName").isNull() | (F.col("oldName") != F.col("want.name")))
        .select("want.folderPath", "want.name", "oldName",
                F.when(F.col("oldName").isNull(), "create").otherwise("rename").alias("action"))
    )


def run_counters(plan: DataFrame) -> DataFrame:
    """Files per action and in total."""
    counts = plan.groupBy("action").agg(F.sum("files").alias("files"))
    return counts.unionByName(counts.agg(F.lit("processed").alias("action"), F.sum("files").alias("files")))


def error_report(failures: DataFrame) -> DataFrame:
    """Report rows of failed targets with a ``reason``; all strings."""
    return failures.select(
        F.col("parentType").alias("type"), "downloadId", "targetFileName", "folderPath",
        instant_text(F.col("lastModified")).alias("lastModified"), F.coalesce("reason", F.lit("")).alias("reason"))
