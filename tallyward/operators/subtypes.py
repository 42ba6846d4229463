"""Who logs in with given login subtypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.fixed import INTEGRATION_WORDS
from tallyward.functions.logins import distinct_list, is_success, likely_human


def matching(logins: DataFrame, subtypes: Sequence[str]) -> DataFrame:
    if "loginSubType" not in logins.columns:
        raise ValueError("the login table has no loginSubType column; use a query or event log export")
    if not subtypes:
        raise ValueError("no login subtypes given")
    return logins.filter(F.col("loginSubType").isin(list(subtypes)))


def user_summary(logins: DataFrame, subtypes: Sequence[str],
                 patterns: Sequence[str] = INTEGRATION_WORDS) -> DataFrame:
    """One row per user. ``username`` is the smallest of the user's names."""
    rows = matching(logins, subtypes)
    present = set(logins.columns)
    key = "userId" if "userId" in present else "username"
    parts = []
    if "username" in present and key != "username":
        parts.append(F.min("username").alias("username"))
    parts += [F.count(F.lit(1)).alias("logins"),
              F.sum(F.when(is_success(), 1).otherwise(0)).alias("successLogins"),
              F.min("loginTime").alias("firstSeen"), F.max("loginTime").alias("lastSeen")]
    if "sourceIp" in present:
        parts.append(F.countDistinct("sourceIp").alias("uniqueIps"))
    if "countryIso" in present:
        parts.append(F.countDistinct("countryIso").alias("uniqueCountries"))
    parts.append(distinct_list("loginSubType", ", ").alias("subtypesUsed"))
    summary = rows.groupBy(key).agg(*parts).withColumn(
        "successRatePct", F.bround(F.col("successLogins") / F.col("logins") * 100, 2))
    if "username" not in present:
        return summary
    return summary.withColumn("likelyHuman", likely_human(F.col("username"), patterns))


def ordered_summary(summary: DataFrame) -> DataFrame:
    """Likely humans first, unknown last, then by logins."""
    return summary.orderBy(F.col("likelyHuman").desc_nulls_last(), F.desc("logins"), summary.columns[0])


def status_breakdown(logins: DataFrame, subtypes: Sequence[str]) -> DataFrame:
    """Logins and share per status."""
    counts = matching(logins, subtypes).groupBy("status").agg(F.count(F.lit(1)).alias("logins"))
    total = counts.select(F.sum("logins")).scalar()
    return counts.select(
        F.coalesce("status", F.lit("(null)")).alias("status"), "logins",
        F.round(F.col("logins") * 100.0 / total.cast("double"), 2).alias("pct"))


def daily_timeline(logins: DataFrame, subtypes: Sequence[str]) -> DataFrame:
    return (
        matching(logins, subtypes).filter(F.col("loginTime").isNotNull())
        .groupBy(F.to_date("loginTime").alias("date")).agg(F.count(F.lit(1)).alias("logins"))
    )


def human_totals(summary: DataFrame) -> DataFrame:
    """Users, likely humans and likely integrations."""
    return summary.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("likelyHuman")).alias("humans"), F.count_if(~F.col("likelyHuman")).alias("integrations"))


def priority_list(summary: DataFrame) -> DataFrame:
    shown = [c for c in ("username", "logins", "successRatePct", "firstSeen", "lastSeen") if c in summary.columns]
    return summary.filter("likelyHuman").select(*shown)
