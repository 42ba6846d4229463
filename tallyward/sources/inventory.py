"""File inventories out of nested attachment and document-link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.names import base_and_extension, filled, is_blank
from tallyward.functions.times import parse_offset_time

PARENT = ("struct<Id:string,Name:string,ContractNumber:string,AccountId:string,"
          "Account:struct<Id:string,Name:string>>")
ATTACHMENT_SCHEMA = (f"Id string, Name string, ParentId string, Parent {PARENT}, "
                     "LastModifiedDate string, CreatedDate string")
DOCUMENT_LINK_SCHEMA = (
    "Id string, ContentDocumentId string, ContentDocument struct<LatestPublishedVersionId:string,"
    "LastModifiedDate:string,CreatedDate:string,LatestPublishedVersion:struct<Title:string,FileExtension:string,"
    f"LastModifiedDate:string,CreatedDate:string>>, LinkedEntityId string, LinkedEntity {PARENT}")
REPORT_SCHEMA = ("type string, downloadId string, targetFileName string, folderPath string, "
                 "lastModified string, reason string")


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTACHMENT_SCHEMA).json(path)


def read_document_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_LINK_SCHEMA).json(path)


def read_error_report(spark: SparkSession, path: str, one_array: bool = False) -> DataFrame:
    """Error report: JSON lines, or one JSON array per file."""
    return spark.read.option("multiLine", one_array).schema(REPORT_SCHEMA).json(path)


def _parent_columns(parent_id: Column, parent: Column) -> list[Column]:
    kind = F.col("parentType")
    number = F.when(kind == "CONTRACT", filled(parent.ContractNumber))
    name = F.coalesce(filled(parent.Name), number, parent.Id, F.lit("UNKNOWN"))
    own = kind == "ACCOUNT"
    account_id = F.when(own, parent_id).otherwise(F.coalesce(filled(parent.AccountId), parent.Account.Id))
    account_name = F.when(own, name).otherwise(parent.Account.Name)
    return [kind, parent_id.alias("parentId"), name.alias("parentName"), account_id.alias("accountId"),
            account_name.alias("accountName")]


def _of_parents(rows: DataFrame, column: str, parents: dict[str, DataFrame]) -> DataFrame:
    """Rows whose parent is in one of the tables, with its type; all types in one join.

    The tables are cut to the ids that rows have before these are made distinct. The ids in use are what that join builds
    its hash tables of, whatever their size is thought to be: the tables pass by unsorted, and no task holds their ids.
    """
    ids = reduce(DataFrame.unionByName, [
        table.select(F.col("Id").alias("knownId"), F.lit(kind).alias("parentType")) for kind, table in parents.items()])
    used = rows.select(F.col(column).alias("usedId")).distinct()
    known = ids.join(used.hint("shuffle_hash"), F.col("knownId") == F.col("usedId"), "left_semi").distinct()
    return rows.join(known, F.col(column) == F.col("knownId")).drop("knownId")


def attachment_inventory(attachments: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Attachments of the given parent types; rows without id or parent are dropped."""
    rows = attachments.filter(
        ~is_blank(F.col("Id")) & ~is_blank(F.col("ParentId")) & F.col("Parent").isNotNull())
    base, extension = base_and_extension(F.coalesce("Name", F.lit("file")))
    return _of_parents(rows, "ParentId", parents).select(
        *_parent_columns(F.col("ParentId"), F.col("Parent")),
        F.col("Id").alias("downloadId"), F.col("Id").alias("namingId"),
        base.alias("baseName"), extension.alias("extension"),
        parse_offset_time(F.col("LastModifiedDate")).alias("lastModified"),
        parse_offset_time(F.col("CreatedDate")).alias("created"))


def document_inventory(links: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Latest published versions of linked documents; version dates come before document dates."""
    document, version = F.col("ContentDocument"), F.col("ContentDocument.LatestPublishedVersion")
    rows = links.filter(
        document.isNotNull() & ~is_blank(F.col("ContentDocumentId"))
        & ~is_blank(document.LatestPublishedVersionId) & version.isNotNull()
        & ~is_blank(F.col("LinkedEntityId")) & F.col("LinkedEntity").isNotNull())

    def date(name: str) -> Column:
        return F.coalesce(parse_offset_time(version[name]), parse_offset_time(document[name]))

    return _of_parents(rows, "LinkedEntityId", parents).select(
        *_parent_columns(F.col("LinkedEntityId"), F.col("LinkedEntity")),
        document.LatestPublishedVersionId.alias("downloadId"), F.col("ContentDocumentId").alias("namingId"),
        F.coalesce(version.Title, F.lit("file")).alias("baseName"),
        F.coalesce(F.concat(F.lit("."), filled(version.FileExtension)), F.lit("")).alias("extension"),
        date("LastModifiedDate").alias("lastModified"), date("CreatedDate").alias("created"))


def file_inventory(attachments: DataFrame, links: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """All attachments and documents of the given parent types (type to its table of ids)."""
    return attachment_inventory(attachments, parents).unionByName(document_inventory(links, parents))
