"""Profile of a login table: one scan gives value counts, all reports derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.fixed import WEAK_TLS
from tallyward.functions.logins import is_failure, is_success, mentions_api, user_column
from tallyward.operators.frames import check_number
from tallyward.session import written

SCALE_COLUMNS = ("userId", "username", "sourceIp", "countryIso", "loginType", "loginSubType", "application")
SHARE_COLUMNS = ("status", "loginType", "loginSubType", "countryIso", "tlsProtocol", "platform", "browser",
                 "application")
PROFILED = tuple(dict.fromkeys((*SCALE_COLUMNS, *SHARE_COLUMNS)))


def time_range(logins: DataFrame) -> DataFrame:
    """Row count, first and last time, span in seconds."""
    micros = F.unix_micros("loginTime")
    return logins.agg(
        F.count(F.lit(1)).alias("total"), F.min("loginTime").alias("tmin"), F.max("loginTime").alias("tmax"),
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("spanSeconds"))


def value_counts(logins: DataFrame) -> DataFrame:
    """(column, value, count) of every profiled column that is present."""
    present = [c for c in PROFILED if c in logins.columns]
    strings = logins.select(*[F.col(c).cast("string").alias(c) for c in present])
    return (
        strings.unpivot([], present, "column", "value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def scale(counts: DataFrame) -> DataFrame:
    """Total rows and distinct non-null values per column."""
    per_column = counts.groupBy("column").agg(
        F.sum("count").alias("rows"), F.count("value").alias("distinct"))
    total = per_column.agg(F.max("rows").alias("value")).select(F.lit("rows").alias("metric"), "value")
    return total.unionByName(
        per_column.filter(F.col("column").isin(list(SCALE_COLUMNS)))
        .select(F.col("column").alias("metric"), F.col("distinct").alias("value")))


def top_values(counts: DataFrame, columns: list[str], top_n: int = 10) -> DataFrame:
    """The ``top_n`` most frequent values per column with their share in percent.

    Spark keeps only ``top_n`` rows per column and input partition before the shuffle.
    """
    check_number("top_n", top_n, 1, 10_000)
    chosen = counts.filter(F.col("column").isin(columns))
    totals = chosen.groupBy("column").agg(F.sum("count").alias("total"))
    order = W.partitionBy("column").orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    ranked = chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    return ranked.join(totals, "column").select(
        "column", "rank", F.coalesce("value", F.lit("(null)")).alias("value"), "count",
        F.round(F.col("count") * 100.0 / F.col("total").cast("double"), 2).alias("pct"))


def distributions(counts: DataFrame, top_n: int = 10) -> DataFrame:
    return top_values(counts, list(SHARE_COLUMNS), top_n)


def top_users_and_ips(counts: DataFrame, top_n: int = 10, user: str = "userId") -> DataFrame:
    return top_values(counts, [user, "sourceIp"], top_n).drop("pct")


def success_rate(logins: DataFrame) -> DataFrame:
    return logins.agg((F.avg(F.when(is_success(), 1.0).otherwise(0.0)) * 100).alias("rate"))


def hints(logins: DataFrame) -> DataFrame:
    """Failures, API-style, SOAP and weak TLS logins, and countries, in one pass."""
    present = set(logins.columns)
    parts = [F.count(F.lit(1)).alias("total")]
    if "status" in present:
        parts.append(F.count_if(is_failure()).alias("failures"))
    if "loginSubType" in present:
        parts += [F.count_if(mentions_api(F.col("loginSubType"))).alias("apiLogins"),
                  F.count_if(F.col("loginSubType") == "SOAP API").alias("soapLogins")]
    if "tlsProtocol" in present:
        parts.append(F.count_if(F.col("tlsProtocol").isin(list(WEAK_TLS))).alias("weakTls"))
    if "countryIso" in present:
        parts.append(F.countDistinct("countryIso").alias("countries"))
    return logins.agg(*parts)


def profile(logins: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """All profile tables. ``value_counts`` is written once for the tables that share it."""
    counts = written(value_counts(logins), "value-counts")
    user = user_column(logins) or "userId"
    return {
        "time_range": time_range(logins),
        "scale": scale(counts),
        "distributions": distributions(counts, top_n),
        "top": top_users_and_ips(counts, top_n, user),
        "success_rate": success_rate(logins) if "status" in logins.columns else None,
        "hints": hints(logins),
    }
