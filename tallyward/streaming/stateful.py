"""Detectors over a stream of logins with state of their own per key.

Logins may come in any order within the lateness of the watermark. A processor keeps them until the watermark has passed,
so that it judges them in order of time and its rows are those of the batch detector. Logins without a time cannot be
placed and take no part. State per key is what lies within the window and the lateness.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallyward.functions.logins import is_failure, is_success
from tallyward.functions.times import MICROS_PER_MINUTE
from tallyward.operators.ordered import SECOND, micros
from tallyward.streaming.rolling import hourly_status_counts

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Processors need the state store that keeps several states per key on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class FailuresBeforeSuccess(StatefulProcessor):
    """Successes of a key with at least ``least`` failures in [t - window, t - 1 s]."""

    def __init__(self, window: int, least: int) -> None:
        self.window, self.least = window, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getMapState("failures", "at long", "n long")
        self.successes = handle.getMapState("successes", "at long, ip string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        failed: dict[int, int] = {}
        passed: dict[tuple, int] = {}
        for batch in rows:
            for at, ip, ok in zip(batch["at"], batch["sourceIp"], batch["ok"], strict=True):
                if ok:
                    place = (int(at), None if ip is None or ip != ip else ip)
                    passed[place] = passed.get(place, 0) + 1
                else:
                    failed[int(at)] = failed.get(int(at), 0) + 1
        for at, n in failed.items():
            old = self.failures.getValue((at,)) if self.failures.containsKey((at,)) else (0,)
            self.failures.updateValue((at,), (old[0] + n,))
        for place, n in passed.items():
            old = self.successes.getValue(place) if self.successes.containsKey(place) else (0,)
            self.successes.updateValue(place, (old[0] + n,))
        for at in {at for at, _ in passed} | {at + self.window for at in failed}:
            self.handle.registerTimer(at // 1000 + 1)  # all logins up to here are known by then
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        failed = sorted((at, n) for (at,), (n,) in self.failures.iterator())
        times = [at for at, _ in failed]
        upto = [0, *itertools.accumulate(n for _, n in failed)]
        out = []
        for (at, ip), (n,) in list(self.successes.iterator()):
            if at >= now:
                continue
            first, last = bisect.bisect_left(times, at - self.window), bisect.bisect_right(times, at - SECOND)
            count = upto[last] - upto[first] if last > first else 0
            if count >= self.least:
                out += [(*key, at, ip, count)] * n
            self.successes.removeKey((at, ip))
        open_from = min([now, *(at for (at, _), _ in self.successes.iterator())])
        for at in times[:bisect.bisect_left(times, open_from - self.window)]:
            self.failures.removeKey((at,))
        yield pd.DataFrame(out, columns=["userId", "at", "successIp", "priorFailures"])

    def close(self) -> None:
        pass


def failures_before_success(logins: DataFrame, min_prior_failures: int = 3, window_minutes: float = 30,
                            late: str = "10 minutes") -> DataFrame:
    """``failed_then_success`` of a stream: (userId, successTime, successIp, priorFailures), once the watermark has passed."""
    window = int(window_minutes * MICROS_PER_MINUTE)
    rows = (
        logins.filter(F.col("loginTime").isNotNull() & F.col("userId").isNotNull() & (is_failure() | is_success()))
        .withWatermark("loginTime", late)
        .select("userId", "loginTime", micros(F.col("loginTime")).alias("at"), "sourceIp", is_success().alias("ok"))
    )
    found = rows.groupBy("userId").transformWithStateInPandas(
        FailuresBeforeSuccess(window, max(min_prior_failures, 1)), "userId string, at long, successIp string, priorFailures int", "Append", "EventTime")
    return found.select("userId", F.timestamp_micros("at").alias("successTime"), "successIp", "priorFailures")


class RunningSpikes(StatefulProcessor):
    """Finished hours of a value far above the mean of its hours so far, this one included."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "hours long, total decimal(38,0), squares decimal(38,0)")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        hours, total, squares = (int(x) for x in self.sums.get()) if self.sums.exists() else (0, 0, 0)
        out = []
        for hour, count in sorted((h, int(c)) for batch in rows for h, c in zip(batch["hourBucket"], batch["cnt"], strict=True)):
            hours, total, squares = hours + 1, total + count, squares + count * count
            variance = hours * squares - total * total  # times hours squared, exact
            score = (hours * count - total) / math.sqrt(variance) if variance > 0 else 0.0
            if score > self.threshold:
                out.append((hour, *key, count, score))
        self.sums.update((hours, _decimal(total), _decimal(squares)))
        yield pd.DataFrame(out, columns=["hourBucket", "status", "cnt", "zscore"])

    def close(self) -> None:
        pass


def _decimal(number: int):
    from decimal import Decimal

    return Decimal(number)


def running_spikes(logins: DataFrame, zscore_threshold: float = 3.0, late: str = "1 hour") -> DataFrame:
    """``status_spikes`` of a stream: each finished hour against the hours of its status up to then."""
    return hourly_status_counts(logins, late).groupBy("status").transformWithStateInPandas(
        RunningSpikes(zscore_threshold), "hourBucket timestamp, status string, cnt long, zscore double", "Append", "None")
