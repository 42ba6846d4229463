"""Registered queries for the profile, the subtype report and the findings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.checks import login_checks
from tallyward.checks.login_checks import NO_WORD, sql_brute
from tallyward.checks.registry import registry
from tallyward.operators import detectors as d
from tallyward.operators import profile as p
from tallyward.operators import severity as v
from tallyward.operators import subtypes as s
from tallyward.plans.detect import preview, run_detectors, run_with_flags

CALLS, SQL, over_logins, over_users = registry()
TWO = ["SOAP API", "Bulk API"]

COUNTS_CTE = "counts AS ({})".format(" UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS value, count(*) AS cnt FROM logins GROUP BY {c}" for c in p.PROFILED))


def sql_top(columns, n, pct=True):
    names = ", ".join(f"'{c}'" for c in columns)
    share = ", round(cnt * 100.0::DOUBLE / total, 2) AS pct" if pct else ""
    return f"""SELECT col AS "column", CAST(rank AS INTEGER) AS rank, coalesce(value, '(null)') AS value, cnt AS count{share}
      FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value NULLS LAST) AS rank,
              sum(cnt) OVER (PARTITION BY col) AS total FROM counts WHERE col IN ({names}))
      WHERE rank <= {n}"""


over_logins("j01_time_range", p.time_range,
            """SELECT count(*) AS total, min(loginTime) AS tmin, max(loginTime) AS tmax,
                 (epoch_us(max(loginTime)) - epoch_us(min(loginTime))) / 1e6 AS spanSeconds FROM logins""")
over_logins("j02_scale", lambda l: p.scale(p.value_counts(l)),
            "SELECT 'rows' AS metric, count(*) AS value FROM logins" + "".join(
                f" UNION ALL SELECT '{c}', count(DISTINCT {c}) FROM logins" for c in p.SCALE_COLUMNS))
over_logins("j03_j04_j08_j09_distributions", lambda l: p.distributions(p.value_counts(l), 3),
            sql_top(p.SHARE_COLUMNS, 3), [COUNTS_CTE])
over_logins("j06_j07_top_users_and_ips", lambda l: p.top_users_and_ips(p.value_counts(l), 10),
            sql_top(("userId", "sourceIp"), 10, pct=False), [COUNTS_CTE])
over_logins("j03_success_rate", lambda l: p.success_rate(l).withColumn("rate", F.round("rate", 6)),
            "SELECT round(avg(CASE WHEN status = 'Success' THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS rate FROM logins")
over_logins("j05_j10_hints", p.hints,
            """SELECT count(*) AS total, count(*) FILTER (status <> 'Success') AS failures,
                 count(*) FILTER (regexp_matches(loginSubType, '(API|Metadata|Bulk)', 'i')) AS apiLogins,
                 count(*) FILTER (loginSubType = 'SOAP API') AS soapLogins,
                 count(*) FILTER (tlsProtocol IN ('TLSv1','TLSv1.1','TLS 1.0','TLS 1.1')) AS weakTls,
                 count(DISTINCT countryIso) AS countries FROM logins""")



def whole_profile(logins):
    """The tables of one ``profile`` call as rows (part, name, rank, n)."""
    tables = p.profile(logins, 3)

    def rows(part, table, name, rank, n):
        return table.select(F.lit(part).alias("part"), name.alias("name"), rank.cast("int").alias("rank"), n.cast("double").alias("n"))

    none, value = F.lit(None), F.concat_ws("=", "column", "value")
    parts = [rows("scale", tables["scale"], F.col("metric"), none, F.col("value")),
             rows("distributions", tables["distributions"], value, F.col("rank"), F.col("count")),
             rows("top", tables["top"], value, F.col("rank"), F.col("count")),
             rows("success_rate", tables["success_rate"], F.lit("rate"), none, F.round("rate", 6)),
             rows("time_range", tables["time_range"], F.lit("spanSeconds"), none, F.col("spanSeconds"))]
    parts += [rows("hints", tables["hints"], F.lit(c), none, F.col(c)) for c in tables["hints"].columns]
    return reduce(DataFrame.unionByName, parts)


over_logins(
    "j01_j10_whole_profile", whole_profile,
    """SELECT 'scale' AS part, 'rows' AS name, CAST(NULL AS INTEGER) AS rank, CAST(count(*) AS DOUBLE) AS n FROM logins """
    + "".join(f"UNION ALL SELECT 'scale', '{c}', NULL, count(DISTINCT {c}) FROM logins " for c in p.SCALE_COLUMNS)
    + f"""UNION ALL SELECT 'distributions', "column" || '=' || value, rank, count FROM ({sql_top(p.SHARE_COLUMNS, 3)})
          UNION ALL SELECT 'top', "column" || '=' || value, rank, count FROM ({sql_top(("userId", "sourceIp"), 3)})
          UNION ALL SELECT 'success_rate', 'rate', NULL, round(avg(CASE WHEN status = 'Success' THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) FROM logins
          UNION ALL SELECT 'time_range', 'spanSeconds', NULL, (epoch_us(max(loginTime)) - epoch_us(min(loginTime))) / 1e6 FROM logins
          UNION ALL SELECT 'hints', unnest(['total', 'failures', 'apiLogins', 'soapLogins', 'weakTls', 'countries']), NULL,
            unnest([count(*), count(*) FILTER (status <> 'Success'), count(*) FILTER (regexp_matches(loginSubType, '(API|Metadata|Bulk)', 'i')),
                    count(*) FILTER (loginSubType = 'SOAP API'), count(*) FILTER (tlsProtocol IN ('TLSv1','TLSv1.1','TLS 1.0','TLS 1.1')),
                    count(DISTINCT countryIso)]) FROM logins""", [COUNTS_CTE])

SUMMARY_CTE = f"""chosen AS (FROM logins WHERE loginSubType IN ('SOAP API', 'Bulk API')),
names AS (SELECT userId, min(username) AS username FROM chosen GROUP BY userId),
summary AS (SELECT c.userId, n.username, count(*) AS logins, count(*) FILTER (status = 'Success') AS successLogins,
    min(loginTime) AS firstSeen, max(loginTime) AS lastSeen, len(list_distinct(list(sourceIp))) AS uniqueIps,
    len(list_distinct(list(countryIso))) AS uniqueCountries,
    array_to_string(list_sort(list_distinct(list(loginSubType))), ', ') AS subtypesUsed,
    round_even(100 * count(*) FILTER (status = 'Success') / count(*), 2) AS successRatePct,
    CASE WHEN n.username IS NOT NULL THEN {NO_WORD.format("n.username")} END AS likelyHuman
  FROM chosen c JOIN names n ON n.userId IS NOT DISTINCT FROM c.userId GROUP BY c.userId, n.username)"""
over_logins("i10_k01_user_summary", lambda l: s.ordered_summary(s.user_summary(l, TWO)),
            "SELECT * FROM summary", [SUMMARY_CTE])
over_logins("k05_human_totals", lambda l: s.human_totals(s.user_summary(l, TWO)),
            """SELECT count(*) AS users, count(*) FILTER (likelyHuman) AS humans,
                 count(*) FILTER (NOT likelyHuman) AS integrations FROM summary""", [SUMMARY_CTE])
over_logins("k06_priority_list", lambda l: s.priority_list(s.user_summary(l, TWO)),
            "SELECT username, logins, successRatePct, firstSeen, lastSeen FROM summary WHERE likelyHuman", [SUMMARY_CTE])
over_logins("k03_status_breakdown", lambda l: s.status_breakdown(l, TWO),
            """SELECT status, logins, round(100 * logins / (SELECT count(*) FROM chosen), 2) AS pct
               FROM (SELECT coalesce(status, '(null)') AS status, count(*) AS logins FROM chosen GROUP BY ALL)""", [SUMMARY_CTE])
over_logins("k04_daily_timeline", lambda l: s.daily_timeline(l, TWO),
            """SELECT CAST(loginTime AS DATE) AS date, count(*) AS logins FROM logins
               WHERE loginSubType IN ('SOAP API', 'Bulk API') AND loginTime IS NOT NULL GROUP BY 1""")


def some_findings(logins):
    results = run_detectors(
        logins, ["brute-force", "human-api-logins", "weak-tls"],
        {"brute-force": {"min_failures": 5, "window_minutes": 720}})
    return v.findings_table(results)


FINDINGS_CTE = """findings AS (
  SELECT 'brute-force' AS detector, 'High' AS severity, sourceIp AS subject, lastSeen AS time, totalFailures AS logins FROM brute
  UNION ALL SELECT 'human-api-logins', CASE WHEN count(*) >= 100 AND loginSubType <> 'SOAP API' THEN 'High' ELSE 'Info' END,
    username, max(loginTime), count(*) FROM logins WHERE loginSubType IN ('SOAP API', 'Bulk API')
    AND {} GROUP BY username, loginSubType
  UNION ALL SELECT 'weak-tls', 'Medium', userId, NULL, count(*) FROM logins
    WHERE tlsProtocol IN ('TLSv1','TLSv1.1','TLS 1.0','TLS 1.1') OR cipherSuite LIKE '%RC4%' OR cipherSuite LIKE '%DES%'
       OR cipherSuite LIKE '%MD5%' OR cipherSuite LIKE '%NULL%' GROUP BY userId, username, tlsProtocol, cipherSuite)""".format(NO_WORD.format("username"))
BRUTE_CTE = sql_brute("sourceIp", "userId", 720, 5, 3)
over_logins("l01_l02_i28_findings", lambda l: some_findings(l).drop("evidence"), "SELECT * FROM findings",
            [BRUTE_CTE, FINDINGS_CTE])
over_logins("l03_severity_summary", lambda l: v.severity_summary(some_findings(l)),
            """SELECT severity, count(*) AS findings, count(DISTINCT subject) AS subjects,
                 CAST(sum(logins) AS BIGINT) AS logins FROM findings GROUP BY severity""", [BRUTE_CTE, FINDINGS_CTE])
over_logins("f07_priority_findings",
            lambda l: v.priority_findings(some_findings(l), 5).select("detector", "severity", "logins"),
            """SELECT detector, severity, logins FROM findings ORDER BY list_position(['Critical','High','Medium','Info'], severity),
                 logins DESC, detector, subject, time LIMIT 5""", [BRUTE_CTE, FINDINGS_CTE])


ALL_PARAMETERS = {
    "impossible-travel": {"min_km": 1000, "max_hours": 6.0}, "concurrent-countries": {"max_minutes": 240},
    "brute-force": {"min_failures": 5, "window_minutes": 720}, "failed-then-success": {"min_prior_failures": 2, "window_minutes": 1440},
    "new-country": {"lookback_days": 14}, "stale-reactivation": {"min_dormant_days": 2}, "status-spikes": {"zscore_threshold": 2.0},
    "off-hours": {"z": 1.5, "min_logins": 20},
}


def every_finding(logins, users):
    return v.findings_table(run_with_flags(logins, users, ["System Administrator"], ALL_PARAMETERS))


def _part(detector, query, severity, subject, time, logins="1"):
    return (f"SELECT '{detector}' AS detector, {severity} AS severity, {subject} AS subject, CAST({time} AS TIMESTAMP) AS time, "
            f"CAST({logins} AS BIGINT) AS logins FROM ({login_checks.SQL[query]})")


EVERY_CTE = "every AS ({})".format(" UNION ALL ".join([
    _part("impossible-travel", "i01_impossible_travel", "'Critical'", "userId", "loginTime"),
    _part("concurrent-countries", "i06_concurrent_countries", "'Info'", "userId", "loginTime"),
    _part("brute-force", "i02_brute_force", "CASE WHEN sourceIp IN (SELECT sourceIp FROM logins WHERE status = 'Success') "
          "THEN 'Critical' ELSE 'High' END", "sourceIp", "lastSeen", "totalFailures"),
    _part("failed-then-success", "i15_failed_then_success_new_ip", "CASE WHEN newIp THEN 'Critical' ELSE 'High' END", "userId", "successTime"),
    _part("new-country", "i04_new_country", "CASE WHEN userId IN (SELECT Id FROM users WHERE profile_name = 'System Administrator') "
          "THEN 'High' ELSE 'Medium' END", "userId", "loginTime"),
    _part("human-api-logins", "i05_human_api_logins", "CASE WHEN logins >= 100 AND loginSubType IN ('Bulk API', 'Bulk API 2.0', "
          "'Metadata API') THEN 'High' ELSE 'Info' END", "username", "lastSeen", "logins"),
    _part("stale-reactivation", "i07_stale_reactivation", "'Medium'", "userId", "wakeUpTime"),
    _part("weak-tls", "i08_weak_tls", "'Medium'", "userId", "NULL", "logins"),
    _part("status-spikes", "i09_status_spikes", "'Info'", "status", "hourBucket", "cnt"),
    _part("off-hours", "i12_off_hours", "'Medium'", "userId", "loginTime"),
    _part("deactivated-user", "i17_deactivated_user_logins", "'Critical'", "userId", "loginTime"),
]))
over_users("l01_findings_of_all_detectors", lambda l, u: every_finding(l, u).drop("evidence"), "SELECT * FROM every", [EVERY_CTE])
over_users("l03_severity_summary_of_all_detectors", lambda l, u: v.severity_summary(every_finding(l, u)),
           """SELECT severity, count(*) AS findings, count(DISTINCT subject) AS subjects,
                CAST(sum(logins) AS BIGINT) AS logins FROM every GROUP BY severity""", [EVERY_CTE])
over_logins("f02_f03_f05_preview_of_dormant_users",
            lambda l: preview("stale-reactivation", d.stale_reactivation(l, 2)).select("userId", "wakeUpTime", F.round("gapDays", 6).alias("gapDays")),
            f"""SELECT userId, wakeUpTime, round(gapDays, 6) AS gapDays FROM ({login_checks.SQL["i07_stale_reactivation"]}) AS t
                ORDER BY t.gapDays DESC, userId, username, prevLogin, wakeUpTime, sourceIp NULLS FIRST, countryIso NULLS FIRST LIMIT 20""")
