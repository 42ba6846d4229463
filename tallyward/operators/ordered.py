"""Time-ordered work per key that stays even when one key or one instant holds most of the rows.

Everything runs over range-sorted parts (``timeline``), never over a whole key in one task, whether a key is busy or not.
Copies of a row stay rows.

Instants are microseconds (``long``). ``NO_TIME`` stands for a missing time; it
sorts after every real instant.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.frames import repeat_rows
from tallyward.operators.timeline import collapsed, scan, timeline

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
NO_TIME = 1 << 61


def micros(time: Column) -> Column:
    return F.unix_micros(time)


def micros_or_last(time: Column) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(NO_TIME))


def time_bucket(at: Column, width: int) -> Column:
    """Start of the bucket that holds ``at``.

    Declared non-null, so that a join on it adds no filter to one side only and both
    sides read the same shuffle.
    """
    return F.coalesce(at - F.pmod(at, F.lit(width)), F.lit(0).cast("long"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match, keeping one copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"{key}__right")
    condition = [F.col(key).eqNullSafe(F.col(f"{key}__right")) for key in keys]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"{key}__right" for key in keys])


def with_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Add ``previous``, the ``carry`` columns of the row before in (key, order).

    ``order`` starts with ``at``; NULLs sort first. Of equal rows each but the first follows its own copy.
    """
    line = timeline(collapsed(rows), keys, order)
    found = repeat_rows(scan(line, lasts={"previous": F.struct(*carry)}), "copies", number="copy")
    return found.withColumn("previous", F.when(F.col("copy") == 1, F.col("previous")).otherwise(F.struct(*carry))).drop("copy")


def running_totals(probes: DataFrame, steps: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "at") -> DataFrame:
    """Add ``running_<value>`` to each probe: the key's steps up to and including its instant.

    ``steps`` hold (keys, at, values).
    """
    asked = probes.drop(*values).withColumn("is_probe", F.lit(True))
    added = steps.select(*keys, at, *values).withColumn("is_probe", F.lit(False))
    return totals_of_events(asked.unionByName(added, allowMissingColumns=True), keys, values, at)


def totals_of_events(events: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "at") -> DataFrame:
    """``running_totals`` of probes and steps in one table, told apart by ``is_probe``; other columns are the probes' own."""
    rest = [c for c in events.columns if c not in values]
    once = events.groupBy(*rest).agg(F.count(F.lit(1)).alias("copies"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values])
    line = timeline(once, keys, [at, "is_probe"])  # steps of an instant stand before its probes
    found = scan(line, sums={f"running_{v}": F.col(v) for v in values}).filter("is_probe")
    return repeat_rows(found.drop("is_probe", *values), "copies")


def running_peaks(steps: DataFrame, keys: Sequence[str], peaks: Mapping[str, str], at: str = "at") -> DataFrame:
    """Highest running sum per key of each value; ``peaks`` names the result of a value."""
    once = steps.groupBy(*keys, at).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in peaks])
    line = timeline(once, keys, [at])
    found = scan(line, sums={alias: F.col(v) for v, alias in peaks.items()})
    return found.groupBy(*keys).agg(*[F.max(alias).alias(alias) for alias in peaks.values()])


def running_peak(steps: DataFrame, keys: Sequence[str], value: str, alias: str, at: str = "at") -> DataFrame:
    """``running_peaks`` of one value."""
    return running_peaks(steps, keys, {value: alias}, at)


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                    alias: str = "seq") -> DataFrame:
    """Number rows 1, 2, … per key in ``order`` without gathering a key in one task."""
    return scan(timeline(rows, keys, order), sums={alias: F.lit(1).cast("long")})
