"""Running values per key over a table sorted across tasks: a distributed prefix scan.

A window over a key is one task, so a busy user or address would hold up the rest. Here the rows are range-sorted by key
and order into even parts, whatever key they belong to, and written once. Each part runs its windows per (part, key). A key
that goes on from one part into the next is the last of one and the first of the other, so what a part hands on is one row:
the totals and last values of its last key. At most one row per part is carried over and joined back.

Rows must differ in some column: equal rows are collapsed to one with their number before (``collapsed``), so that the sort
can split the rows of one key and one instant as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.session import written


@dataclass(frozen=True)
class Timeline:
    """``rows`` hold the number of their ``part``; parts follow each other in (keys, order)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    parts: int

    def by_part(self) -> DataFrame:
        """Each part in a task of its own; windows and groups by (part, ...) need no further shuffle."""
        return self.rows.repartitionById(self.parts, F.col("part"))


def collapsed(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """Equal rows as one, with their number; rows meet after they are counted in their own task."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(copies))


def timeline(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Timeline:
    """Range-sorted parts of ``rows``; the columns beyond ``order`` decide where that leaves rows equal."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    full = [*order, *rest]
    parts = written(rows.repartitionByRange(*keys, *full).withColumn("part", F.spark_partition_id()), "timeline")
    last = parts.agg(F.max("part")).first()[0]
    return Timeline(parts, tuple(keys), tuple(full), 1 if last is None else last + 1)


def scan(line: Timeline, sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows with ``sums`` added up to and including each row of its key, and for each of ``lasts`` the last value that
    is not null among the rows of its key before it."""
    sums, lasts = sums or {}, lasts or {}
    inside = W.partitionBy("part", *line.keys).orderBy(*line.order)
    upto, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    local = line.by_part().withColumns({
        **{name: F.sum(value).over(upto) for name, value in sums.items()},
        **{name: F.last(value, ignorenulls=True).over(before) for name, value in lasts.items()}})
    carried = _carried(line, sums, lasts)
    names = {name: f"carried_{name}" for name in (*sums, *lasts)}
    handed = carried.select(F.col("part").alias("into_part"), *[F.col(k).alias(f"into_{k}") for k in line.keys],
                            *[F.col(a).alias(b) for a, b in names.items()])
    same = F.col("part") == F.col("into_part")
    for k in line.keys:
        same = same & F.col(k).eqNullSafe(F.col(f"into_{k}"))
    joined = local.join(F.broadcast(handed), same, "left")  # one row per part
    return joined.withColumns({
        **{name: F.col(name) + F.coalesce(names[name], F.lit(0)) for name in sums},
        **{name: F.coalesce(name, names[name]) for name in lasts},
    }).drop("part", "into_part", *[f"into_{k}" for k in line.keys], *names.values())


def _carried(line: Timeline, sums: Mapping[str, Column], lasts: Mapping[str, Column]) -> DataFrame:
    """Rows (part, keys, names): what the first key of a part brings along from earlier parts; at most one row per part."""
    totals = {
        **{name: F.sum(value).alias(name) for name, value in sums.items()},
        **{name: F.max(F.when(value.isNotNull(), F.struct(*line.order, value.alias("value")))).alias(name)
           for name, value in lasts.items()}}
    per_key = line.by_part().groupBy("part", *line.keys).agg(*totals.values())
    key = F.struct(*line.keys)
    ends = per_key.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("key"), *totals)).alias("last"))
    kinds = {name: ends.schema["last"].dataType[name].dataType for name in totals}
    gives = F.struct(*[F.col(f"last.key.{k}").alias(k) for k in line.keys], *[F.col(f"last.{name}").alias(name) for name in totals],
                     F.lit(False).alias("asks"))
    asks = F.struct(*[F.col(f"first.{k}").alias(k) for k in line.keys],
                    *[F.lit(None).cast(kinds[name]).alias(name) for name in totals], F.lit(True).alias("asks"))
    both = ends.select("part", F.explode(F.array(gives, asks)).alias("end")).select("part", "end.*")
    earlier = W.partitionBy(*line.keys).orderBy("part").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumns({
        **{name: F.sum(name).over(earlier) for name in sums},
        **{name: F.max(name).over(earlier) for name in lasts}}).filter("asks")
    return found.select("part", *line.keys, *sums, *[F.col(f"{name}.value").alias(name) for name in lasts])
