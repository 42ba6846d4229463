"""Helpers shared by the corpus operators: tables, shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: computed once, lineage cut, size known.

    The tables of an application lie in one folder, which goes when the driver ends.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/tallyward-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROOTS: set[str] = set()


def _drop(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch between Spark and Python. Texts and shingle sets run from a few bytes to megabytes, and a
#: task holds a batch on both sides.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches are limited to ``BATCH_ROWS`` rows (a smaller setting stays).

    The setting is read when a plan runs, which is after this returns, so it stays for the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """One output row for each row of ``df``: ``make()`` runs once per task and returns a function of the row's values."""
    return flat_map_rows(df, lambda: _single(make()), schema)


def _single(one: Callable[..., tuple]) -> Callable[..., list[tuple]]:
    return lambda *values: [one(*values)]


def flat_map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str, flush: int = 8192) -> DataFrame:
    """Any number of rows for each row of ``df``, sent on after each batch of ``df``, or once there are about ``flush`` rows.

    So what a task holds is what came out of one batch, on both sides. What Arrow keeps for reuse goes when a task ends, as
    its worker lives on beside other ones.
    """
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rows = make(), []
        for batch in batches:
            for i in range(batch.num_rows):
                rows.extend(each(*(column[i].as_py() for column in batch.columns)))
                if len(rows) >= flush:
                    yield _batch(rows, fields)
                    rows = []
            if rows:
                yield _batch(rows, fields)
                rows = []
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
