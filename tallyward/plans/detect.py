"""Running detectors by name over one login table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.logins import is_success
from tallyward.operators import detectors as d
from tallyward.operators import hunts as h
from tallyward.plans.shared import shared_tables
from tallyward.sources.sinks import write_findings

log = logging.getLogger(__name__)

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "impossible-travel": d.impossible_travel,
    "brute-force": d.brute_force,
    "failed-then-success": d.failed_then_success,
    "new-country": d.new_country,
    "human-api-logins": d.human_api_logins,
    "concurrent-countries": d.concurrent_countries,
    "stale-reactivation": d.stale_reactivation,
    "weak-tls": d.weak_tls_logins,
    "status-spikes": d.status_spikes,
}

BUILT_IN = dict(DETECTORS)

#: Columns that a detector's result is sorted by at a sink; a minus sign stands for falling order.
RESULT_ORDER = {
    "impossible-travel": ("userId", "loginTime"), "concurrent-countries": ("userId", "loginTime"),
    "new-country": ("userId", "loginTime"), "brute-force": ("-peakFailuresInWindow",),
    "failed-then-success": ("-priorFailures", "successTime"), "human-api-logins": ("-logins",), "weak-tls": ("-logins",),
    "stale-reactivation": ("-gapDays",), "status-spikes": ("-zscore",), "off-hours": ("userId", "loginTime"),
    "deactivated-user": ("userId", "loginTime"),
}


def result_order(name: str, result: DataFrame) -> list:
    """Sort columns of a result; the columns that are left break ties."""
    wanted = [c for c in RESULT_ORDER.get(name, ()) if c.lstrip("-") in result.columns]
    rest = [c for c in result.columns if c not in {w.lstrip("-") for w in wanted}]
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in (*wanted, *rest)]


def preview(name: str, result: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows of a result in its order."""
    return result.orderBy(*result_order(name, result)).limit(rows)


def register_detector(name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
    DETECTORS[name] = detector


def run_detectors(logins: DataFrame, names: Iterable[str] | None = None,
                  parameters: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Result per detector; an error in one is logged and leaves it out.

    What several detectors need is made once for all (``shared_tables``); a single detector reads the logins itself.
    """
    chosen = list(DETECTORS) if names is None else [n.strip() for n in names]
    unknown = [n for n in chosen if n not in DETECTORS]
    if unknown:
        raise ValueError(f"unknown detectors {unknown}; available: {list(DETECTORS)}")
    given = parameters or {}
    own = [n for n in chosen if BUILT_IN.get(n) is DETECTORS[n]]  # a detector registered under such a name may take no tables
    shared = shared_tables(logins, own, given) if len(own) > 1 else {}
    results = {}
    for name in chosen:
        try:
            results[name] = DETECTORS[name](logins, **given.get(name, {}), **shared.get(name, {}))
        except Exception:  # one detector must not stop the others
            log.exception("detector %s failed", name)
    return results


def write_all(results: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write each result as CSV; an error in one does not stop the others. Returns row counts."""
    counts = {}
    for name, result in results.items():
        try:
            counts[name] = write_findings(name, result, folder, result_order(name, result))
        except Exception:
            log.exception("writing %s failed", name)
    return counts


def run_with_flags(logins: DataFrame, users: DataFrame | None = None, profiles: Iterable[str] = (),
                   parameters: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """All detectors with the flags that raise a severity, and the hunts that have one.

    ``newIp``: no failure came from the address of the success. ``endedInSuccess``: the address of a brute force also
    logged in. ``privileged``: the user has one of ``profiles``. The last and the logins of deactivated users need ``users``.
    """
    given = parameters or {}
    results = run_detectors(logins, [n for n in DETECTORS if n != "failed-then-success"], given)
    results["failed-then-success"] = h.failed_then_success_new_ip(logins, **given.get("failed-then-success", {}))
    results["off-hours"] = h.off_hours(logins, **given.get("off-hours", {}))
    brute = results.get("brute-force")
    if brute is not None and "sourceIp" in brute.columns:
        entered = logins.filter(is_success()).select("sourceIp", F.lit(True).alias("endedInSuccess")).distinct()
        results["brute-force"] = brute.join(entered, "sourceIp", "left").withColumn(
            "endedInSuccess", F.coalesce("endedInSuccess", F.lit(False)))
    if users is not None:
        results["deactivated-user"] = h.deactivated_user_logins(logins, users)
        if "new-country" in results:
            privileged = F.coalesce(F.col("profileName").isin(list(profiles)), F.lit(False))
            new = results["new-country"]
            results["new-country"] = h.with_users(new, users).withColumn("privileged", privileged).select(*new.columns, "privileged")
    return results
