"""Tables that several detectors read, made in one pass over the logins each and written once.

``facts``: counts with first and last time by hour and status, weak protocol, API user and address, user and country; the
counts of all kinds are combined in each task before they meet, in one shuffle. ``successes``: the user timeline with the
login before, for both detectors of country switches.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.fixed import API_SUBTYPES
from tallyward.functions.logins import has_columns, is_api_subtype, is_success, weak_tls
from tallyward.functions.times import MICROS_PER_DAY
from tallyward.operators.detectors import successes_in_order
from tallyward.operators.ordered import HOUR, micros, time_bucket
from tallyward.session import written

SWITCHES = ("impossible-travel", "concurrent-countries")
KEYS = ("k1", "k2", "k3", "k4")


def _fact(kind: str, keys: Iterable[str], hour: Column | None = None, recent: Column | None = None) -> Column:
    named = [F.col(k) for k in keys]
    named += [F.lit(None).cast("string")] * (len(KEYS) - len(named))
    return F.struct(F.lit(kind).alias("kind"), *[c.alias(k) for k, c in zip(KEYS, named, strict=True)],
                    (F.lit(None).cast("long") if hour is None else hour).alias("hour"),
                    (F.lit(None).cast("boolean") if recent is None else recent).alias("recent"))


def latest_success(logins: DataFrame) -> int | None:
    """Instant of the latest success with a country: one number."""
    return logins.filter(is_success() & F.col("countryIso").isNotNull()).agg(F.max(micros(F.col("loginTime")))).first()[0]


def shared_tables(logins: DataFrame, chosen: Iterable[str], parameters: Mapping[str, dict] | None = None) -> dict[str, dict]:
    """For detectors by name the shared tables that they accept; a detector without its columns has no entry."""
    given, chosen = parameters or {}, set(chosen)
    kinds = dict(logins.dtypes)
    found: dict[str, dict] = {}

    def texts(*columns: str) -> bool:
        return all(kinds.get(c) == "string" for c in columns) and kinds.get("loginTime") == "timestamp"

    if chosen.issuperset(SWITCHES) and has_columns(logins, "userId", "loginTime", "countryIso", "status"):
        differs = [F.col(before).countryIso != F.col("countryIso") for before in ("previous", "known")]
        switches = written(successes_in_order(logins).filter(differs[0] | differs[1]), "switches")
        found |= {name: {"successes": switches} for name in SWITCHES}

    at = micros(F.col("loginTime"))
    facts: dict[str, Column] = {}
    by = given.get("status-spikes", {}).get("by", "status")
    if "status-spikes" in chosen and texts(by):
        facts["status-spikes"] = F.when(at.isNotNull() & F.col(by).isNotNull(), _fact("status-spikes", [by], hour=time_bucket(at, HOUR)))
    weak, shown = weak_tls(logins.columns), [c for c in ("userId", "username", "tlsProtocol", "cipherSuite") if c in logins.columns]
    if "weak-tls" in chosen and weak is not None and texts(*shown):
        facts["weak-tls"] = F.when(weak, _fact("weak-tls", shown))
    api = ["username", "loginSubType", "sourceIp"]
    if "human-api-logins" in chosen and texts(*api):
        subtypes = given.get("human-api-logins", {}).get("subtypes", API_SUBTYPES)
        facts["human-api-logins"] = F.when(is_api_subtype(F.col("loginSubType"), subtypes) & F.col("username").isNotNull(),
                                           _fact("human-api-logins", api))
    place = ["userId", "countryIso", "sourceIp"]
    if "new-country" in chosen and texts(*place, "status"):
        days = given.get("new-country", {}).get("lookback_days", 90)
        latest = latest_success(logins)
        start = F.lit(None).cast("long") if latest is None else F.lit(latest - int(days * MICROS_PER_DAY))
        facts["new-country"] = F.when(is_success() & F.col("countryIso").isNotNull(), _fact("new-country", place, recent=at >= start))
    if not facts:
        return found

    table = written(
        logins.select(at.alias("at"), F.explode(F.array_compact(F.array(*facts.values()))).alias("fact")).select("fact.*", "at")
        .groupBy("kind", *KEYS, "hour", "recent")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")), "login-facts")

    def of(kind: str, names: Iterable[str], *more: Column) -> DataFrame:
        return table.filter(F.col("kind") == kind).select(*[F.col(k).alias(n) for k, n in zip(KEYS, names)], *more)

    first, last = F.timestamp_micros("low"), F.timestamp_micros("high")
    if "status-spikes" in facts:
        found["status-spikes"] = {"hourly": of("status-spikes", [by], F.timestamp_micros("hour").alias("hourBucket"), F.col("n").alias("cnt"))}
    if "weak-tls" in facts:
        found["weak-tls"] = {"counts": of("weak-tls", shown, F.col("n").alias("logins"))}
    if "human-api-logins" in facts:
        found["human-api-logins"] = {"counts": of("human-api-logins", api, F.col("n").alias("logins"), first.alias("firstSeen"), last.alias("lastSeen"))}
    if "new-country" in facts:
        recent = F.col("recent")
        found["new-country"] = {"history": of("new-country", place, recent, first.alias("loginTime")).groupBy("userId", "countryIso").agg(
            F.coalesce(F.bool_or(~recent), F.lit(False)).alias("known"),
            F.min(F.when(recent, F.col("loginTime"))).alias("loginTime"),
            F.min(F.when(recent, F.col("sourceIp"))).alias("sourceIp"))}
    return found
