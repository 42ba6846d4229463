"""Registered queries for single predicates, joins, aggregates, windows and functions over logins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyward.checks.login_checks import CENTROIDS_CTE, NO_WORD
from tallyward.checks.registry import registry
from tallyward.functions import logins as fl
from tallyward.functions.geo import with_distance
from tallyward.functions.times import days_between, hours_between, minutes_between
from tallyward.operators.detectors import trailing_steps
from tallyward.operators.hunts import with_users
from tallyward.operators.ordered import (
    MINUTE, micros, micros_or_last, numbered_within, running_totals, with_previous,
)
from tallyward.operators.frames import repeat_rows

CALLS, SQL, over_logins, over_users = registry()

over_logins(
    "b01_b12_predicates",
    lambda l: l.select(
        "event_id", fl.is_success().alias("b01"), fl.is_failure().alias("b02"),
        F.col("loginSubType").isin("SOAP API", "REST API").alias("b03"),
        fl.likely_human(F.col("username")).alias("b04"), fl.mentions_api(F.col("loginSubType")).alias("b05"),
        fl.weak_tls(l.columns).alias("b06"),
        (F.col("countryIso").isNotNull() & F.col("sourceIp").isNotNull() & F.col("loginTime").isNotNull()
         & F.col("username").isNotNull() & F.col("loginSubType").isNotNull()).alias("b07"),
        F.col("networkId").isNotNull().alias("b10"), fl.human_address(F.col("username")).alias("b12")),
    f"""SELECT event_id, status = 'Success' AS b01, status <> 'Success' AS b02,
          loginSubType IN ('SOAP API', 'REST API') AS b03,
          CASE WHEN username IS NOT NULL THEN {NO_WORD.format("username")} END AS b04,
          regexp_matches(loginSubType, '(API|Metadata|Bulk)', 'i') AS b05,
          tlsProtocol IN ('TLSv1','TLSv1.1','TLS 1.0','TLS 1.1') OR cipherSuite LIKE '%RC4%' OR cipherSuite LIKE '%DES%'
            OR cipherSuite LIKE '%MD5%' OR cipherSuite LIKE '%NULL%' AS b06,
          countryIso IS NOT NULL AND sourceIp IS NOT NULL AND loginTime IS NOT NULL AND username IS NOT NULL
            AND loginSubType IS NOT NULL AS b07,
          networkId IS NOT NULL AS b10, regexp_matches(username, '^[a-z]+\\.[a-z]+@') AS b12 FROM logins""")


def lagged(l):
    rows = l.filter(F.col("loginTime").isNotNull()).select(
        "event_id", "userId", micros(F.col("loginTime")).alias("at"), "countryIso", "sourceIp")
    out = with_previous(rows, ["userId"], ["at", "event_id"], ["at", "countryIso", "sourceIp"])
    then, now = F.timestamp_micros("previous.at"), F.timestamp_micros("at")
    return out.select(
        "event_id", F.col("previous.countryIso").alias("prevCountry"), F.col("previous.sourceIp").alias("prevIp"),
        then.alias("prevTime"), hours_between(then, now).alias("hours"), minutes_between(then, now).alias("minutes"),
        days_between(then, now).alias("days"),
        (F.col("previous.countryIso") != F.col("countryIso")).alias("switched"))


over_logins(
    "b09_e01_e02_h01_previous_login", lagged,
    """SELECT event_id, prevCountry, prevIp, prevTime, us / 3.6e9 AS hours, us / 6e7 AS minutes, us / 8.64e10 AS days,
         prevCountry <> countryIso AS switched
       FROM (SELECT *, CAST(epoch_us(loginTime) - epoch_us(prevTime) AS DOUBLE) AS us FROM (
         SELECT event_id, countryIso, loginTime, lag(countryIso) OVER w AS prevCountry, lag(sourceIp) OVER w AS prevIp,
           lag(loginTime) OVER w AS prevTime FROM logins WHERE loginTime IS NOT NULL
         WINDOW w AS (PARTITION BY userId ORDER BY loginTime, event_id)))""")


def trailing_counts(l):
    """Failures of the address in [t - 6 h, t] for every failure row."""
    window = 360 * MINUTE
    rows = l.filter(fl.is_failure() & F.col("sourceIp").isNotNull()).select(
        "event_id", "sourceIp", micros_or_last(F.col("loginTime")).alias("at"))
    steps = trailing_steps(rows.withColumn("n", F.lit(1).cast("long")), ["sourceIp"], window, ["n"])
    return running_totals(rows, steps, ["sourceIp"], ["n"]).select("event_id", F.col("running_n").alias("failures"))


over_logins(
    "e03_trailing_failures_per_ip", trailing_counts,
    """SELECT event_id, count(*) OVER (PARTITION BY sourceIp ORDER BY loginTime
         RANGE BETWEEN INTERVAL 360 MINUTE PRECEDING AND CURRENT ROW) AS failures
       FROM logins WHERE status <> 'Success' AND sourceIp IS NOT NULL""")
over_logins(
    "e08_row_numbers",
    lambda l: numbered_within(l.select("status", "event_id"), ["status"], ["event_id"]).withColumn(
        "seq", F.col("seq").cast("long")),
    "SELECT status, event_id, row_number() OVER (PARTITION BY status ORDER BY event_id) AS seq FROM logins")
over_logins(
    "d01_d08_aggregates",
    lambda l: l.groupBy("status", "loginSubType").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("userId").alias("users"),
        F.countDistinct("sourceIp").alias("ips"), F.min("loginTime").alias("first"), F.max("loginTime").alias("last"),
        F.count_if(F.col("networkId").isNotNull()).alias("community"),
        F.round(F.avg(F.when(F.col("countryIso") == "US", 1.0).otherwise(0.0)) * 100, 6).alias("usPct"),
        fl.distinct_list("countryIso", ",").alias("countries"),
        F.min("username").alias("anyName")),
    """SELECT status, loginSubType, count(*) AS n, count(DISTINCT userId) AS users, count(DISTINCT sourceIp) AS ips,
         min(loginTime) AS first, max(loginTime) AS last, count(networkId) AS community,
         round(avg(CASE WHEN countryIso = 'US' THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 6) AS usPct,
         string_agg(DISTINCT countryIso, ',' ORDER BY countryIso) AS countries, min(username) AS anyName
       FROM logins GROUP BY status, loginSubType""")
over_logins(
    "d06_d09_d10_hourly_statistics",
    lambda l: l.groupBy("userId", F.date_trunc("hour", "loginTime").alias("h")).agg(F.count(F.lit(1)).alias("cnt"))
    .groupBy("userId").agg(F.sum("cnt").alias("total"), F.round(F.avg("cnt"), 6).alias("mean"),
                           F.round(F.stddev_pop("cnt"), 6).alias("std")).filter("total >= 20"),
    """SELECT userId, CAST(sum(cnt) AS BIGINT) AS total, round(avg(cnt), 6) AS mean, round(stddev_pop(cnt), 6) AS std FROM (
         SELECT userId, date_trunc('hour', loginTime) AS h, count(*) AS cnt FROM logins GROUP BY 1, 2)
       GROUP BY userId HAVING sum(cnt) >= 20""")
over_logins("d11_distinct", lambda l: l.select("userId", "countryIso").distinct(),
            "SELECT DISTINCT userId, countryIso FROM logins")
over_logins(
    "c01_anchor_window",
    lambda l: l.filter(micros(F.col("loginTime")) >= l.select(F.max(micros(F.col("loginTime"))) - 3 * 1440 * MINUTE).scalar())
    .select("event_id", "loginTime"),
    "SELECT event_id, loginTime FROM logins, (SELECT max(loginTime) AS m FROM logins) WHERE loginTime >= m - INTERVAL 3 DAY")
over_logins(
    "c02_c03_semi_and_anti_join",
    lambda l: l.filter(fl.is_failure()).select("event_id", "userId", "countryIso")
    .join(l.filter("networkId = '0DB1'").select("userId").distinct(), "userId", "left_semi")
    .join(l.filter("tlsProtocol = 'TLSv1'").select("userId", "countryIso").distinct(), ["userId", "countryIso"], "left_anti"),
    """SELECT event_id, userId, countryIso FROM logins l WHERE status <> 'Success'
         AND EXISTS (SELECT 1 FROM logins b WHERE b.userId = l.userId AND b.networkId = '0DB1')
         AND NOT EXISTS (SELECT 1 FROM logins b WHERE b.userId = l.userId AND b.countryIso = l.countryIso
                         AND b.tlsProtocol = 'TLSv1')""")
over_logins(
    "c07_h10_centroid_distances",
    lambda l: with_distance(l.select("event_id", "countryIso", F.lit("JP").alias("target")), "countryIso", "target")
    .select("event_id", F.round("distanceKm", 3).alias("distanceKm")),
    """SELECT event_id, round(2 * 6371 * asin(sqrt(pow(sin(radians(j.lat - c.lat) / 2), 2) + cos(radians(c.lat))
         * cos(radians(j.lat)) * pow(sin(radians(j.lon - c.lon) / 2), 2))), 3) AS distanceKm
       FROM logins JOIN centroids j ON j.iso = 'JP' LEFT JOIN centroids c ON c.iso = countryIso""", [CENTROIDS_CTE])
over_users(
    "c08_user_enrichment",
    lambda l, u: with_users(l.select("event_id", "userId"), u).drop("hasMfa"),
    """SELECT event_id, userId, u.Username AS currentUsername, u.IsActive AS isActive, profile_name AS profileName,
         role_name AS roleName, u.LastLoginDate AS lastLoginDate, u.UserType AS userTypeName
       FROM logins LEFT JOIN users u ON userId = u.Id""")
over_logins(
    "h02_h04_h07_h08_scalars",
    lambda l: l.select(
        "event_id", F.date_trunc("hour", "loginTime").alias("hourStart"), F.to_date("loginTime").alias("day"),
        F.hour("loginTime").alias("hourUtc"), F.coalesce("countryIso", F.lit("(null)")).alias("country"),
        F.nullif(F.col("networkId"), F.lit("0DB1")).alias("network"),
        F.round(F.col("event_id") / F.lit(7.0), 2).alias("rounded"), F.bround(F.col("event_id") / F.lit(8.0), 2).alias("even")),
    """SELECT event_id, date_trunc('hour', loginTime) AS hourStart, CAST(loginTime AS DATE) AS day,
         CAST(hour(loginTime) AS INTEGER) AS hourUtc, coalesce(countryIso, '(null)') AS country,
         nullif(networkId, '0DB1') AS network, round(event_id / 7.0::DOUBLE, 2) AS rounded,
         round_even(event_id / 8.0::DOUBLE, 2) AS even FROM logins""")
over_logins(
    "f02_f03_ordered_counts",
    lambda l: l.groupBy("userId").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "userId").limit(20),
    "SELECT userId, count(*) AS n FROM logins GROUP BY userId ORDER BY n DESC, userId LIMIT 20")
over_logins(
    "frames_repeat_rows",
    lambda l: repeat_rows(l.groupBy("sourceIp", "status").agg(F.count(F.lit(1)).alias("copies")), "copies"),
    "SELECT sourceIp, status FROM logins")
