"""One findings table out of the detector results, with a severity per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: severities in falling order ---
LEVELS = ("Critical", "High", "Medium", "Info")

# --- fixed values: severity by detector when nothing more is known ---
BASE_SEVERITY = {
    "impossible-travel": "Critical",
    "brute-force": "High",
    "failed-then-success": "High",
    "new-country": "Medium",
    "human-api-logins": "Info",
    "concurrent-countries": "Info",
    "stale-reactivation": "Medium",
    "weak-tls": "Medium",
    "status-spikes": "Info",
    "off-hours": "Medium",
    "deactivated-user": "Critical",
}
SUBJECTS = ("userId", "username", "sourceIp", "status")
TIMES = ("loginTime", "successTime", "wakeUpTime", "lastSeen", "hourBucket")
BULK_LOGINS = 100
VOLUME_SUBTYPES = ("Bulk API", "Bulk API 2.0", "Metadata API")


def severity(detector: str, columns: list[str]) -> Column:
    """Severity of a detector row.

    The enrichment flags ``newIp``, ``endedInSuccess`` and ``privileged`` raise it where
    they are present; the lower level is kept where they are not.
    """
    level = F.lit(BASE_SEVERITY[detector])
    if detector == "failed-then-success" and "newIp" in columns:
        return F.when(F.col("newIp"), "Critical").otherwise(level)
    if detector == "brute-force" and "endedInSuccess" in columns:
        return F.when(F.col("endedInSuccess"), "Critical").otherwise(level)
    if detector == "new-country" and "privileged" in columns:
        return F.when(F.col("privileged"), "High").otherwise(level)
    if detector == "human-api-logins":
        at_volume = (F.col("logins") >= BULK_LOGINS) & F.col("loginSubType").isin(list(VOLUME_SUBTYPES))
        return F.when(at_volume, "High").otherwise(level)
    return level


def as_findings(detector: str, result: DataFrame) -> DataFrame:
    """Common shape: detector, severity, subject, time, logins, evidence (JSON of the row)."""
    columns = result.columns
    subject = next((F.col(c) for c in SUBJECTS if c in columns), F.lit(None))
    time = next((F.col(c) for c in TIMES if c in columns), F.lit(None))
    logins = next((F.col(c) for c in ("logins", "totalFailures", "cnt") if c in columns), F.lit(1))
    return result.select(
        F.lit(detector).alias("detector"), severity(detector, columns).alias("severity"),
        subject.cast("string").alias("subject"), time.cast("timestamp").alias("time"),
        logins.cast("long").alias("logins"), F.to_json(F.struct(*columns)).alias("evidence"))


def findings_table(results: dict[str, DataFrame]) -> DataFrame:
    parts = [as_findings(name, df) for name, df in results.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def severity_rank(column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in LEVELS]), column)


def severity_summary(findings: DataFrame) -> DataFrame:
    """Findings, affected subjects and logins per severity."""
    return findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("subject").alias("subjects"),
        F.sum("logins").alias("logins"))


def priority_findings(findings: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` most severe findings, those with most logins first."""
    return (
        findings.orderBy(severity_rank(F.col("severity")), F.desc("logins"), "detector", "subject", "time", "evidence")
        .limit(limit)
    )
