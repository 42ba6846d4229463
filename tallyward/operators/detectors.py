"""Anomaly detectors over the normalised ``logins`` table.

Each detector needs some columns and gives an empty frame when they are missing.
None sorts its result: order at the sink, for example ``result.orderBy("userId")``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.fixed import API_SUBTYPES, INTEGRATION_WORDS
from tallyward.functions.geo import with_distance
from tallyward.functions.logins import (
    distinct_list, has_columns, is_api_subtype, is_failure, is_integration, is_success, user_column, weak_tls,
)
from tallyward.functions.times import (
    MICROS_PER_DAY, MICROS_PER_HOUR, MICROS_PER_MINUTE, days_between, hours_between, minutes_between,
)
from tallyward.operators.frames import check_number, empty_frame
from tallyward.operators.ordered import (
    NO_TIME, SECOND, micros, micros_or_last, time_bucket, totals_of_events, with_previous,
)
from tallyward.operators.timeline import scan, timeline
from tallyward.session import written

YEAR_MINUTES = 60 * 24 * 365
MAX_DAYS = 365 * 50


def successes_in_order(logins: DataFrame) -> DataFrame:
    """Different successes of each user with the success before (``previous``), and the one with a country (``known``).

    Logins at one instant are ordered by country, then address. Of equal logins only the first can differ from the one before.
    """
    ip = F.col("sourceIp") if "sourceIp" in logins.columns else F.lit(None).cast("string")
    shown = logins.filter(is_success() & F.col("loginTime").isNotNull()).select(
        "userId", micros(F.col("loginTime")).alias("at"), "countryIso", ip.alias("sourceIp")).distinct()
    order = ["at", "countryIso", "sourceIp"]
    place = F.struct(*order)
    return scan(timeline(shown, ["userId"], order),
                lasts={"previous": place, "known": F.when(F.col("countryIso").isNotNull(), place)})


def country_switches(successes: DataFrame, before: str) -> DataFrame:
    """Successes whose country differs from that of the login in the column ``before``."""
    previous = F.col(before)
    return (
        successes.filter(previous.countryIso.isNotNull() & (previous.countryIso != F.col("countryIso")))
        .select(
            "userId",
            previous.countryIso.alias("prevCountry"), "countryIso",
            F.timestamp_micros(previous.at).alias("prevTime"),
            F.timestamp_micros("at").alias("loginTime"),
            previous.sourceIp.alias("prevIp"), "sourceIp",
            (F.col("at") - previous.at).alias("gap"),
        )
    )


def impossible_travel(logins: DataFrame, min_km: float = 1000, max_hours: float = 2.0,
                      successes: DataFrame | None = None) -> DataFrame:
    """Two successful logins of a user in far countries within ``max_hours``.

    ``successes`` are those of ``successes_in_order`` where they are there already.
    """
    check_number("max_hours", max_hours, 0, 24 * 365)
    if not has_columns(logins, "userId", "loginTime", "countryIso", "status"):
        return empty_frame(logins.sparkSession, (
            "userId string, prevCountry string, countryIso string, prevTime timestamp, "
            "loginTime timestamp, prevIp string, sourceIp string, hoursDelta double, distanceKm double"))
    ordered = successes_in_order(logins) if successes is None else successes
    close = country_switches(ordered, "known").filter(F.col("gap") <= int(max_hours * MICROS_PER_HOUR))
    return (
        with_distance(close, "prevCountry", "countryIso")
        .filter(F.coalesce(F.col("distanceKm"), F.lit(0.0)) >= min_km)
        .withColumn("hoursDelta", hours_between(F.col("prevTime"), F.col("loginTime")))
        .drop("gap")
    )


def concurrent_countries(logins: DataFrame, max_minutes: float = 5, successes: DataFrame | None = None) -> DataFrame:
    """Two successful logins of a user from different countries within ``max_minutes``.

    A login without a country stays in the sequence and separates its neighbours.
    """
    check_number("max_minutes", max_minutes, 0, YEAR_MINUTES)
    if not has_columns(logins, "userId", "loginTime", "countryIso", "status"):
        return empty_frame(logins.sparkSession, (
            "userId string, prevCountry string, countryIso string, prevTime timestamp, "
            "loginTime timestamp, prevIp string, sourceIp string, minutesDelta double"))
    return (
        country_switches(successes_in_order(logins) if successes is None else successes, "previous")
        .filter(F.col("gap") <= int(max_minutes * MICROS_PER_MINUTE))
        .withColumn("minutesDelta", minutes_between(F.col("prevTime"), F.col("loginTime")))
        .drop("gap")
    )


def trailing_steps(rows: DataFrame, keys: Sequence[str], window: int, values: Sequence[str],
                   delay: int = 0) -> DataFrame:
    """Each row's values as an entry ``delay`` after it and an exit when it leaves the window.

    A row without a time enters the last instant and never leaves it.
    """
    no_time = F.col("at") == NO_TIME
    enter = F.struct(F.when(no_time, F.col("at")).otherwise(F.col("at") + delay).alias("at"), *values)
    leave = F.struct((F.col("at") + window + 1).alias("at"), *[(-F.col(v)).alias(v) for v in values])
    both = F.when(no_time, F.array(enter)).otherwise(F.array(enter, leave))
    return rows.select(*keys, F.explode(both).alias("step")).select(*keys, "step.*")


def _member_steps(rows: DataFrame, key: str, member: str, window: int) -> DataFrame:
    """+1 when a member becomes active in the key's trailing window, -1 when it stops.

    Rows of one member within a window-wide bucket are always one active stretch, so a
    stretch needs only the first and last row of its buckets.
    """
    spans = (
        rows.filter(F.col(member).isNotNull())
        .withColumn("bucket", time_bucket(F.col("at"), max(window, 1)))
        .groupBy(key, member, "bucket")
        .agg(F.min("at").alias("start"), F.max("at").alias("end"))
    )
    by_time = W.partitionBy(key, member).orderBy("bucket")
    before, after = F.lag("end").over(by_time), F.lead("start").over(by_time)
    edges = spans.select(
        key, "start", "end",
        F.coalesce(F.col("start") - before > window, F.lit(True)).alias("opens"),
        (F.coalesce(after - F.col("end") > window, F.lit(True)) & (F.col("end") != NO_TIME)).alias("closes"),
    )
    steps = F.array(
        F.when(F.col("opens"), F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("closes"), F.struct((F.col("end") + window + 1).alias("at"), F.lit(-1).cast("long").alias("n"))),
    )
    return (
        edges.select(key, F.explode(F.array_compact(steps)).alias("step"))
        .select(key, "step.at", "step.n")
    )


def brute_force(logins: DataFrame, min_failures: int = 10, window_minutes: float = 10,
                min_unique_users: int = 3, group_by: str = "sourceIp",
                member: str | None = None) -> DataFrame:
    """Keys whose peak failures and peak distinct members in a trailing window reach both limits.

    By default addresses against users; ``group_by="userId", member="sourceIp"`` is the
    reverse. A sliding distinct count is kept as +1/-1 steps, never as sets of members.
    """
    check_number("min_failures", min_failures)
    check_number("window_minutes", window_minutes, 0, YEAR_MINUTES)
    check_number("min_unique_users", min_unique_users)
    member = member or user_column(logins)
    if member is None or not has_columns(logins, group_by, member, "status", "loginTime"):
        return empty_frame(logins.sparkSession, (
            f"{group_by} string, peakFailuresInWindow long, uniqueUsersTargeted long, "
            "totalFailures long, firstSeen timestamp, lastSeen timestamp"))
    window = int(window_minutes * MICROS_PER_MINUTE)
    failed = logins.filter(is_failure() & F.col(group_by).isNotNull()).select(
        group_by, F.col(member).alias("member"), micros_or_last(F.col("loginTime")).alias("at"))
    failed = written(failed.groupBy(group_by, "member", "at").agg(F.count(F.lit(1)).alias("n")), "failures")
    # an entry is positive, an exit negative; the entries alone add up to the total
    failures = trailing_steps(failed, [group_by], window, ["n"]).select(
        group_by, "at", F.col("n").alias("failures"), F.greatest("n", F.lit(0)).alias("entered"))
    members = _member_steps(failed, group_by, "member", window).withColumnRenamed("n", "members")
    steps = failures.unionByName(members, allowMissingColumns=True).groupBy(group_by, "at").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("failures", "members", "entered")])
    running = scan(timeline(steps, [group_by], ["at"]), sums={"open": F.col("failures"), "active": F.col("members")})
    seen = F.when((F.col("entered") > 0) & (F.col("at") != NO_TIME), F.col("at"))
    return (
        running.groupBy(group_by).agg(
            F.max("open").alias("peakFailuresInWindow"), F.max("active").alias("uniqueUsersTargeted"),
            F.sum("entered").alias("totalFailures"),
            F.timestamp_micros(F.min(seen)).alias("firstSeen"), F.timestamp_micros(F.max(seen)).alias("lastSeen"))
        .filter((F.col("peakFailuresInWindow") >= min_failures) & (F.col("uniqueUsersTargeted") >= min_unique_users))
    )


def prior_failures(logins: DataFrame, key: Sequence[str], failed: Column, window: int,
                   least: int, payload: Sequence[str]) -> DataFrame:
    """Successes with ``failures`` >= ``least`` of the same key in [t - window, t - 1 s].

    A missing time is one extra last instant.
    """
    found = totals_of_events(_failure_events(logins, key, failed, window, least, payload), key, ["fails", "seen"])
    return (
        found.filter((F.col("running_seen") > 0) & (F.col("running_fails") >= least))
        .select(*key, "at", *payload, F.col("running_fails").alias("failures"))
    )


def _failure_events(logins: DataFrame, key: Sequence[str], failed: Column, window: int, least: int,
                    payload: Sequence[str]) -> DataFrame:
    """Successes as probes, and what counts as entry a second later and exit after the window, in one pass over the logins."""
    at, zero, one = F.col("at"), F.lit(0).cast("long"), F.lit(1).cast("long")
    no_time, counts = at == NO_TIME, F.lit(True) if least <= 0 else failed
    fails = F.when(failed, one).otherwise(zero)
    own = [c for c in payload if c not in key]
    kinds = dict(logins.dtypes)

    def event(time: Column, sign: int) -> Column:
        shown = [(F.col(c) if sign == 0 else F.lit(None).cast(kinds[c])).alias(c) for c in own]
        return F.struct(time.alias("at"), F.lit(sign == 0).alias("is_probe"), *shown,
                        (fails * sign).alias("fails"), (one * sign).alias("seen"))

    events = F.array_compact(F.array(
        F.when(is_success(), event(at, 0)),
        F.when(counts, event(F.when(no_time, at).otherwise(at + SECOND), 1)),
        F.when(counts & ~no_time, event(at + window + 1, -1))))
    rows = logins.withColumn("at", micros_or_last(F.col("loginTime")))
    return rows.select(*key, F.explode(events).alias("event")).select(*key, "event.*")


def success_time(at: Column) -> Column:
    return F.when(at != NO_TIME, F.timestamp_micros(at))


def failed_then_success(logins: DataFrame, min_prior_failures: int = 3,
                        window_minutes: float = 30) -> DataFrame:
    """Successes after at least ``min_prior_failures`` failures of that user in the window."""
    check_number("min_prior_failures", min_prior_failures)
    check_number("window_minutes", window_minutes, 0, YEAR_MINUTES)
    user = user_column(logins)
    window = int(window_minutes * MICROS_PER_MINUTE)
    if user is None or not has_columns(logins, "status", "loginTime") or window < SECOND:
        return empty_frame(logins.sparkSession, (
            f"{user or 'userId'} string, successTime timestamp, successIp string, priorFailures int"))
    rows = logins if "sourceIp" in logins.columns else logins.withColumn("sourceIp", F.lit(None).cast("string"))
    hits = prior_failures(rows, [user], is_failure(), window, min_prior_failures, ["sourceIp"])
    return hits.select(user, success_time(F.col("at")).alias("successTime"), F.col("sourceIp").alias("successIp"),
                       F.col("failures").cast("int").alias("priorFailures"))


def recent_start(logins: DataFrame, lookback_days: float) -> Column:
    """Latest success with a country minus ``lookback_days``, as a scalar subquery."""
    success = logins.filter(is_success() & F.col("countryIso").isNotNull())
    return success.select((F.max(micros(F.col("loginTime"))) - int(lookback_days * MICROS_PER_DAY))).scalar()


def country_history(logins: DataFrame, start: Column) -> DataFrame:
    """Successes with a country, one row per (user, country); ``start`` begins the recent part."""
    at = micros(F.col("loginTime"))
    return (
        logins.filter(is_success() & F.col("countryIso").isNotNull()).groupBy("userId", "countryIso").agg(
            F.coalesce(F.bool_or(at < start), F.lit(False)).alias("known"),
            F.min(F.when(at >= start, F.col("loginTime"))).alias("loginTime"),
            F.min(F.when(at >= start, F.col("sourceIp"))).alias("sourceIp"))
    )


def new_country(logins: DataFrame, lookback_days: float = 90, history: DataFrame | None = None) -> DataFrame:
    """First recent login per (user, country) not in the user's earlier countries.

    Users without earlier logins are left out. ``sourceIp`` is the smallest address. ``history`` is that of
    ``country_history`` where it is there already.
    """
    check_number("lookback_days", lookback_days, 0, MAX_DAYS)
    if not has_columns(logins, "userId", "countryIso", "loginTime", "status", "sourceIp"):
        return empty_frame(logins.sparkSession, (
            "userId string, loginTime timestamp, newCountry string, knownCountries string, sourceIp string"))
    if history is None:
        history = country_history(logins, recent_start(logins, lookback_days))
    known = history.filter(F.col("known") & F.col("userId").isNotNull()).groupBy("userId").agg(
        distinct_list("countryIso", ",").alias("knownCountries"))
    return (
        history.filter(~F.col("known") & F.col("loginTime").isNotNull())
        .join(known, "userId")
        .select("userId", "loginTime", F.col("countryIso").alias("newCountry"), "knownCountries", "sourceIp")
    )


def human_api_logins(logins: DataFrame, patterns: Sequence[str] = INTEGRATION_WORDS,
                     subtypes: Sequence[str] = API_SUBTYPES, counts: DataFrame | None = None) -> DataFrame:
    """API logins of users whose name does not look like an integration.

    ``counts`` are rows (username, loginSubType, sourceIp, logins, firstSeen, lastSeen), one per address, where they are there
    already.
    """
    if not has_columns(logins, "loginSubType", "username", "loginTime", "sourceIp"):
        return empty_frame(logins.sparkSession, (
            "username string, loginSubType string, logins long, firstSeen timestamp, "
            "lastSeen timestamp, uniqueIps long"))
    addresses = F.countDistinct("sourceIp") if counts is None else F.count("sourceIp")
    if counts is None:
        counts = logins.withColumns({"logins": F.lit(1).cast("long"), "firstSeen": F.col("loginTime"), "lastSeen": F.col("loginTime")})
    return (
        counts.filter(is_api_subtype(F.col("loginSubType"), subtypes)
                      & F.col("username").isNotNull() & ~is_integration(F.col("username"), patterns))
        .groupBy("username", "loginSubType")
        .agg(F.sum("logins").alias("logins"), F.min("firstSeen").alias("firstSeen"),
             F.max("lastSeen").alias("lastSeen"), addresses.alias("uniqueIps"))
    )


def stale_reactivation(logins: DataFrame, min_dormant_days: float = 90) -> DataFrame:
    """Successful logins after a pause of at least ``min_dormant_days``.

    A login after such a pause is the first of its pause-wide time bucket, so one row
    per user and bucket is enough.
    """
    check_number("min_dormant_days", min_dormant_days, 0, MAX_DAYS)
    user = user_column(logins)
    if user is None or not has_columns(logins, "loginTime", "status", "sourceIp", "countryIso"):
        return empty_frame(logins.sparkSession, (
            f"{user or 'userId'} string, prevLogin timestamp, wakeUpTime timestamp, gapDays double, "
            "sourceIp string, countryIso string"))
    extra = ["username"] if user == "userId" and "username" in logins.columns else []
    shown = ["at", "sourceIp", "countryIso", *extra]
    limit = int(min_dormant_days * MICROS_PER_DAY)
    rows = logins.filter(is_success() & F.col("loginTime").isNotNull()).withColumn("at", micros(F.col("loginTime")))
    if limit == 0:  # every login but the user's first follows a pause
        gaps = (
            with_previous(rows.select(user, *shown), [user], shown, ["at"])
            .select(user, F.struct(*shown).alias("wake"), F.col("previous.at").alias("before"))
        )
    else:
        by_time = W.partitionBy(user).orderBy("bucket")
        gaps = (
            rows.withColumn("bucket", time_bucket(F.col("at"), limit))
            .groupBy(user, "bucket")
            .agg(F.min(F.struct(*shown)).alias("wake"), F.max("at").alias("end"))
            .withColumn("before", F.lag("end").over(by_time))
        )
    return (
        gaps.filter(F.col("wake.at") - F.col("before") >= limit)
        .select(user, *[f"wake.{c}" for c in extra],
                F.timestamp_micros("before").alias("prevLogin"),
                F.timestamp_micros("wake.at").alias("wakeUpTime"),
                "wake.sourceIp", "wake.countryIso")
        .withColumn("gapDays", days_between(F.col("prevLogin"), F.col("wakeUpTime")))
    )


def weak_tls_logins(logins: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Logins with outdated TLS or a weak cipher, counted per user, protocol and cipher; ``counts`` where they are there already."""
    if counts is not None:
        return counts
    condition = weak_tls(logins.columns)
    if condition is None:
        return empty_frame(logins.sparkSession, "userId string, logins long")
    shown = [c for c in ("userId", "username", "tlsProtocol", "cipherSuite") if c in logins.columns]
    return logins.filter(condition).groupBy(*shown).agg(F.count(F.lit(1)).alias("logins"))


def status_spikes(logins: DataFrame, zscore_threshold: float = 3.0, by: str = "status",
                  hourly: DataFrame | None = None) -> DataFrame:
    """Hours in which a status (or another column) is far above its own hourly mean.

    ``hourly`` are rows (hourBucket, by, cnt) where they are there already.
    """
    check_number("zscore_threshold", zscore_threshold, 0, 100)
    if not has_columns(logins, by, "loginTime"):
        return empty_frame(logins.sparkSession, f"hourBucket timestamp, {by} string, cnt long, zscore double")
    if hourly is None:
        hourly = (
            logins.filter(F.col("loginTime").isNotNull() & F.col(by).isNotNull())
            .groupBy(F.date_trunc("hour", "loginTime").alias("hourBucket"), by)
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
    of_value = W.partitionBy(by)
    scored = hourly.withColumns({
        "mean": F.avg("cnt").over(of_value), "std": F.stddev_pop("cnt").over(of_value)})
    return (
        scored.withColumn("zscore", (F.col("cnt") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
        .filter(F.col("zscore") > zscore_threshold)
        .select("hourBucket", by, "cnt", "zscore")
    )
