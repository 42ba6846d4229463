"""Further login hunts: totals, user-joined variants, sessions, devices, off-hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.fixed import API_SUBTYPES, INTEGRATION_WORDS
from tallyward.functions.logins import (
    is_api_subtype, is_failure, is_success, likely_human, user_column,
)
from tallyward.functions.times import MICROS_PER_MINUTE
from tallyward.operators.detectors import (
    brute_force, country_history, human_api_logins, new_country, prior_failures, recent_start, status_spikes,
    success_time, trailing_steps,
)
from tallyward.operators.ordered import MINUTE, SECOND, join_null_safe, micros, micros_or_last, running_totals
from tallyward.session import written


def with_users(rows: DataFrame, users: DataFrame, user: str = "userId") -> DataFrame:
    """Left join with the user table (``Id`` unique): name, activity, profile, role, type."""
    flat = users.select(
        F.col("Id").alias("joinedId"), F.col("Username").alias("currentUsername"), F.col("IsActive").alias("isActive"),
        F.col("Profile.Name").alias("profileName"), F.col("UserRole.Name").alias("roleName"),
        F.col("LastLoginDate").alias("lastLoginDate"), F.col("UserType").alias("userTypeName"),
        *[c for c in users.columns if c == "hasMfa"])
    return rows.join(flat, F.col(user) == F.col("joinedId"), "left").drop("joinedId")


def brute_force_total(logins: DataFrame, min_failures: int = 10, min_users: int = 3) -> DataFrame:
    """Failures per address without a window."""
    user = user_column(logins)
    return (
        logins.filter(is_failure() & F.col("sourceIp").isNotNull()).groupBy("sourceIp")
        .agg(F.count(F.lit(1)).alias("totalFailures"), F.countDistinct(user).alias("uniqueUsersTargeted"),
             F.min("loginTime").alias("firstSeen"), F.max("loginTime").alias("lastSeen"))
        .filter((F.col("totalFailures") >= min_failures) & (F.col("uniqueUsersTargeted") >= min_users))
    )


def brute_force_with_success(logins: DataFrame, **limits: float) -> DataFrame:
    """Addresses of ``brute_force`` that also had a success."""
    found = brute_force(logins, **limits)
    succeeded = logins.filter(is_success()).select("sourceIp").distinct()
    return found.join(succeeded, "sourceIp", "left_semi")


def off_hours(logins: DataFrame, z: float = 3.0, min_logins: int = 20) -> DataFrame:
    """Logins in hours of day that the user uses far less than the user's mean hour."""
    success = logins.filter(is_success() & F.col("userId").isNotNull()).withColumn("hourUtc", F.hour("loginTime"))
    of_user = W.partitionBy("userId")
    hours = success.groupBy("userId", "hourUtc").agg(F.count(F.lit(1)).alias("cnt"))
    scored = hours.withColumns({
        "total": F.sum("cnt").over(of_user), "mean": F.avg("cnt").over(of_user),
        "std": F.stddev_pop("cnt").over(of_user)})
    used = F.when(F.col("hourUtc").isNull(), 0).otherwise(F.col("cnt"))
    rare = scored.filter(
        (F.col("total") >= min_logins) & (F.col("std") > 0) & ((F.col("mean") - used) / F.col("std") > z)
    ).select("userId", "hourUtc")
    return join_null_safe(success.select("userId", "loginTime", "sourceIp", "hourUtc"), rare, ["userId", "hourUtc"])


def new_country_rows(logins: DataFrame, lookback_days: float = 90) -> DataFrame:
    """Every recent login from a country new to the user."""
    start = recent_start(logins, lookback_days)
    history = country_history(logins, start)
    with_past = history.filter("known").select("userId").distinct()
    fresh = (
        history.filter(~F.col("known") & F.col("loginTime").isNotNull())
        .join(with_past, "userId", "left_semi").select("userId", "countryIso")
    )
    return (
        logins.filter(is_success() & (micros(F.col("loginTime")) >= start))
        .join(fresh, ["userId", "countryIso"], "left_semi")
        .select("userId", "loginTime", "sourceIp", F.col("countryIso").alias("newCountry"))
    )


def failures_by_status(logins: DataFrame, key: str = "sourceIp", min_failures: int = 1) -> DataFrame:
    """Clusters of one failure status per address or per user."""
    other = "sourceIp" if key != "sourceIp" else user_column(logins)
    return (
        logins.filter(is_failure() & F.col(key).isNotNull()).groupBy(key, "status")
        .agg(F.count(F.lit(1)).alias("failures"), F.countDistinct(other).alias("spread"),
             F.min("loginTime").alias("firstSeen"), F.max("loginTime").alias("lastSeen"))
        .filter(F.col("failures") >= min_failures)
    )


def failed_then_success_new_ip(logins: DataFrame, min_prior_failures: int = 3,
                               window_minutes: float = 30) -> DataFrame:
    """``failed_then_success`` with ``newIp``: no failure of the window came from the success address."""
    user = user_column(logins)
    window = int(window_minutes * MICROS_PER_MINUTE)
    hits = prior_failures(logins, [user], is_failure(), window, min_prior_failures, ["sourceIp"])
    own = logins.filter(is_failure() & F.col("sourceIp").isNotNull()).select(
        user, "sourceIp", micros_or_last(F.col("loginTime")).alias("at"), F.lit(1).cast("long").alias("fails"))
    counted = running_totals(hits, trailing_steps(own, [user, "sourceIp"], window, ["fails"], delay=SECOND),
                             [user, "sourceIp"], ["fails"])
    return counted.select(
        user, success_time(F.col("at")).alias("successTime"), F.col("sourceIp").alias("successIp"),
        F.col("failures").cast("int").alias("priorFailures"),
        ((F.col("running_fails") == 0) & F.col("sourceIp").isNotNull()).alias("newIp"))


def login_after_failed_mfa(logins: DataFrame, window_minutes: float = 30,
                           status: str = "Challenge Not Complete") -> DataFrame:
    """Successes of a user after a failed challenge in the window."""
    user = user_column(logins)
    hits = prior_failures(logins, [user], F.col("status") == status,
                          int(window_minutes * MICROS_PER_MINUTE), 1, ["sourceIp"])
    return hits.select(user, success_time(F.col("at")).alias("successTime"), F.col("sourceIp").alias("successIp"),
                       F.col("failures").cast("int").alias("failedChallenges"))


def deactivated_user_logins(logins: DataFrame, users: DataFrame) -> DataFrame:
    """Logins of users that are not active now."""
    return with_users(logins, users).filter(~F.col("isActive")).select(
        "userId", "currentUsername", "loginTime", "sourceIp", "status", "lastLoginDate")


def new_country_no_mfa(logins: DataFrame, users: DataFrame, lookback_days: float = 90) -> DataFrame:
    """``new_country`` of users known to lack MFA."""
    return with_users(new_country(logins, lookback_days), users).filter(~F.col("hasMfa")).select(
        "userId", "currentUsername", "loginTime", "newCountry", "knownCountries", "sourceIp")


def new_country_privileged(logins: DataFrame, users: DataFrame, profiles: Sequence[str],
                           lookback_days: float = 90) -> DataFrame:
    """``new_country`` of users with a privileged profile."""
    return with_users(new_country(logins, lookback_days), users).filter(
        F.col("profileName").isin(list(profiles))
    ).select("userId", "profileName", "loginTime", "newCountry", "knownCountries", "sourceIp")


def new_device(logins: DataFrame, device: Sequence[str] = ("browser", "platform", "clientVersion")) -> DataFrame:
    """First login of each device combination that is not the user's first."""
    success = logins.filter(is_success() & F.col("userId").isNotNull() & F.col("loginTime").isNotNull())
    devices = success.groupBy("userId", *device).agg(
        F.min("loginTime").alias("firstSeen"), F.count(F.lit(1)).alias("logins"))
    start = devices.groupBy("userId").agg(F.min("firstSeen").alias("userSince"))
    return devices.join(start, "userId").filter(F.col("firstSeen") > F.col("userSince"))


def admin_without_mfa(logins: DataFrame, users: DataFrame, profiles: Sequence[str]) -> DataFrame:
    """Successful admin logins whose authentication reference lacks ``mfa``."""
    return (
        with_users(logins.filter(is_success()), users)
        .filter(F.col("profileName").isin(list(profiles))
                & ~F.coalesce(F.col("authMethodRef").contains("mfa"), F.lit(False)))
        .select("userId", "profileName", "loginTime", "sourceIp", "authMethodRef")
    )


def api_off_hours(logins: DataFrame, start_hour: int = 9, end_hour: int = 18,
                  subtypes: Sequence[str] = API_SUBTYPES,
                  words: Sequence[str] = INTEGRATION_WORDS) -> DataFrame:
    """API logins of likely humans outside [start_hour, end_hour) UTC."""
    hour = F.hour("loginTime")
    return logins.filter(
        is_api_subtype(F.col("loginSubType"), subtypes) & likely_human(F.col("username"), words)
        & ((hour < start_hour) | (hour >= end_hour))
    ).select("userId", "username", "loginTime", "loginSubType", "sourceIp", hour.alias("hourUtc"))


def sso_bypass(logins: DataFrame, min_saml_share: float = 0.5) -> DataFrame:
    """Plain ``Application`` logins of users who normally use ``SAML *``."""
    share = logins.filter(is_success() & F.col("userId").isNotNull()).groupBy("userId").agg(
        F.avg(F.when(F.col("loginType").startswith("SAML "), 1.0).otherwise(0.0)).alias("samlShare"))
    usual = share.filter(F.col("samlShare") >= min_saml_share)
    return (
        logins.filter(is_success() & (F.col("loginType") == "Application"))
        .join(usual, "userId").select("userId", "loginTime", "sourceIp", "samlShare")
    )


def session_spans(logins: DataFrame) -> DataFrame:
    """Rows (userId, sessionKey, at, sourceIp, end): a session spans its first to last row and has the address of its first."""
    rows = logins.filter(
        F.col("sessionKey").isNotNull() & F.col("loginTime").isNotNull() & F.col("sourceIp").isNotNull()
    ).withColumn("at", micros(F.col("loginTime")))
    return (
        rows.groupBy("userId", "sessionKey")
        .agg(F.min(F.struct("at", "sourceIp")).alias("first"), F.max("at").alias("end"))
        .select("userId", "sessionKey", F.col("first.at").alias("at"), F.col("first.sourceIp").alias("sourceIp"), "end")
    )


def session_overlap(logins: DataFrame) -> DataFrame:
    """Sessions that start while sessions of the same user from other addresses are open, with their number.

    Open sessions are counted by +1/-1 steps, of the user and of the user's same address; ``overlapping_sessions``
    names them.
    """
    spans = written(session_spans(logins), "sessions")
    one = F.lit(1).cast("long")
    steps = spans.select("userId", "sourceIp", F.explode(F.array(
        F.struct(F.col("at"), one.alias("open")),
        F.struct((F.col("end") + 1).alias("at"), (-one).alias("open")))).alias("step")
    ).select("userId", "sourceIp", "step.at", "step.open")

    def counted(probes: DataFrame, keys: list[str], alias: str) -> DataFrame:
        return running_totals(probes, steps, keys, ["open"]).withColumnRenamed("running_open", alias)

    opened = counted(counted(spans, ["userId"], "ofUser"), ["userId", "sourceIp"], "ofAddress")
    return opened.filter(F.col("ofUser") > F.col("ofAddress")).select(
        "userId", "sessionKey", "sourceIp", F.timestamp_micros("at").alias("sessionStart"),
        F.timestamp_micros("end").alias("sessionEnd"),
        (F.col("ofUser") - F.col("ofAddress")).alias("otherSessions"))


#: Cells of the coarser grid per cell of the finer one, and grids from cells of a minute up to more than a thousand years.
GRID_STEP = 4
GRIDS = 15


def overlapping_sessions(logins: DataFrame) -> DataFrame:
    """Each session that starts while a session of the same user from another address is open, with that session: one row a pair.

    An open session goes to the one or two cells that it meets on the finest grid whose cells are as long as itself; a
    start looks into its own cell of each grid. A cell is at most ``GRID_STEP`` times as long as the sessions in it, so
    sessions are compared with starts near them, however long they are, and no pair meets twice. Pairs are joined by
    (user, grid, cell), which a busy user shares among many keys.
    """
    spans = written(session_spans(logins), "sessions")
    widths = [MINUTE * GRID_STEP ** g for g in range(GRIDS)]
    length = F.col("end") - F.col("at") + 1
    grid = F.lit(GRIDS - 1)
    for g in reversed(range(GRIDS - 1)):
        grid = F.when(length <= widths[g], g).otherwise(grid)
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("grid") + 1)
    cells = F.sequence(F.expr("at div width"), F.expr("end div width"))
    opened = (spans.withColumn("grid", grid).withColumn("width", width)
              .select("userId", "grid", F.explode(cells).alias("cell"), F.col("sessionKey").alias("otherSession"),
                      F.col("sourceIp").alias("otherIp"), F.col("at").alias("otherAt"), F.col("end").alias("otherEnd")))
    places = F.array(*[F.struct(F.lit(g).alias("grid"), F.expr(f"at div {w}").alias("cell")) for g, w in enumerate(widths)])
    starts = (spans.select("*", F.explode(places).alias("place"))
              .select("userId", "place.grid", "place.cell", "sessionKey", "sourceIp", "at", "end"))
    met = starts.join(opened, ["userId", "grid", "cell"]).filter(
        (F.col("otherAt") <= F.col("at")) & (F.col("otherEnd") >= F.col("at")) & (F.col("otherIp") != F.col("sourceIp")))
    return met.select(
        "userId", "sessionKey", "sourceIp", F.timestamp_micros("at").alias("sessionStart"),
        F.timestamp_micros("end").alias("sessionEnd"), "otherSession", "otherIp",
        F.timestamp_micros("otherAt").alias("otherStart"), F.timestamp_micros("otherEnd").alias("otherEnd"))


def community_activity_spike(logins: DataFrame, zscore_threshold: float = 3.0) -> DataFrame:
    """Hourly spikes per community."""
    return status_spikes(logins, zscore_threshold, by="networkId")


def login_key_attempts(logins: DataFrame) -> DataFrame:
    """Attempts of one login flow."""
    return logins.filter(F.col("loginKey").isNotNull()).groupBy("loginKey").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(is_failure()).alias("failures"),
        F.count_if(is_success()).alias("successes"),
        F.min("loginTime").alias("firstSeen"), F.max("loginTime").alias("lastSeen"))


def bulk_api_volume(logins: DataFrame, min_logins: int = 100,
                    subtypes: Sequence[str] = ("Bulk API", "Bulk API 2.0", "Metadata API"),
                    patterns: Sequence[str] = INTEGRATION_WORDS) -> DataFrame:
    """Humans who use the bulk or metadata API at volume."""
    return human_api_logins(logins, patterns, subtypes).filter(F.col("logins") >= min_logins)
