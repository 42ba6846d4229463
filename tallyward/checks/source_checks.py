"""Registered queries for reading, normalising and writing login exports."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyward.checks.registry import registry
from tallyward.functions.logins import mask_ip
from tallyward.functions.times import parse_login_time
from tallyward.operators.detectors import weak_tls_logins
from tallyward.session import new_path
from tallyward.sources import daily_cache
from tallyward.sources import logins as src
from tallyward.sources import sinks

CALLS, SQL, over_logins, over_users = registry()
AS_OF = datetime.datetime(2024, 1, 20, 10, 30)


def iso(column="loginTime"):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def as_event_log(rows):
    """Event log headers, with doubled names and quotes inside values."""
    return rows.select(
        F.lit("Login").alias("EVENT_TYPE"), F.col("event_id").cast("string").alias("LOGIN_HISTORY_ID"),
        iso().alias("TIMESTAMP"), F.lit("later").alias("TIMESTAMP_DERIVED"),
        F.col("userId").alias("USER_ID"), F.col("username").alias("USER_NAME"),
        F.col("sourceIp").alias("SOURCE_IP"), F.lit("0.0.0.0").alias("CLIENT_IP"),
        F.col("status").alias("LOGIN_STATUS"), F.col("countryIso").alias("COUNTRY_ISO"),
        F.concat(F.lit('the "'), F.col("application"), F.lit('", new\nline')).alias("APPLICATION"),
        F.lit("x").alias("UNKNOWN_FIELD"))


def as_ui(rows):
    return rows.select(
        F.col("username").alias("Username"), F.date_format("loginTime", "MM/dd/yyyy hh:mm a").alias("Login Time"),
        F.col("sourceIp").alias("Source IP"), F.col("loginType").alias("Login Type"), F.col("status").alias("Status"),
        F.col("countryIso").alias("Country"), F.col("tlsProtocol").alias("TLS Protocol"))


def as_query_result(rows):
    return rows.select(
        F.col("userId").alias("UserId"), iso().alias("LoginTime"), F.col("sourceIp").alias("SourceIp"),
        F.col("status").alias("Status"), F.col("loginSubType").alias("LoginSubType"),
        F.col("countryIso").alias("CountryIso"), F.col("networkId").alias("NetworkId"))


def write_csv(rows, name):
    path = new_path(rows.sparkSession, name)
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return path


def read_event_log(logins):
    path = write_csv(as_event_log(logins), "event-log")
    return src.read_login_csv(logins.sparkSession, path)


EVENT_LOG_SQL = """SELECT CAST(event_id AS VARCHAR) AS {id}, strftime(loginTime, '%Y-%m-%dT%H:%M:%S.%gZ') AS {time},
  userId AS {user}, username AS {name}, sourceIp AS {ip}, status AS {status}, countryIso AS {country},
  concat('the "', application, '", new' || chr(10) || 'line') AS {app}"""

over_logins(
    "a01_read_login_csv", read_event_log,
    EVENT_LOG_SQL.format(id="LOGIN_HISTORY_ID", time='"TIMESTAMP"', user="USER_ID", name="USER_NAME", ip="SOURCE_IP",
                         status="LOGIN_STATUS", country="COUNTRY_ISO", app="APPLICATION")
    + ", 'Login' AS EVENT_TYPE, 'later' AS TIMESTAMP_DERIVED, '0.0.0.0' AS CLIENT_IP, 'x' AS UNKNOWN_FIELD FROM logins")


def sniffed(logins):
    """Header names and detected source of the three export shapes, next to their row counts."""
    spark = logins.sparkSession
    parts = []
    for shape, rows in (("event log", as_event_log(logins)), ("ui", as_ui(logins)), ("query", as_query_result(logins))):
        path = write_csv(rows, "sniffed")
        names = src.sniff_columns(spark, path)
        parts.append(src.read_login_csv(spark, path, names).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(shape).alias("shape"), F.lit(",".join(names)).alias("headers"),
            F.lit(src.detect_source(names)).alias("source"), "n"))
    return src.union_chunks(parts)


over_logins(
    "a02_a03_sniff_and_detect_source", sniffed,
    """SELECT 'event log' AS shape, 'EVENT_TYPE,LOGIN_HISTORY_ID,TIMESTAMP,TIMESTAMP_DERIVED,USER_ID,USER_NAME,SOURCE_IP,CLIENT_IP,LOGIN_STATUS,COUNTRY_ISO,APPLICATION,UNKNOWN_FIELD' AS headers,
         'Event Monitoring Login event' AS source, count(*) AS n FROM logins
       UNION ALL SELECT 'ui', 'Username,Login Time,Source IP,Login Type,Status,Country,TLS Protocol', 'Setup UI Login History export', count(*) FROM logins
       UNION ALL SELECT 'query', 'UserId,LoginTime,SourceIp,Status,LoginSubType,CountryIso,NetworkId', 'SOQL LoginHistory export', count(*) FROM logins""")
over_logins(
    "a04_normalize_event_log", lambda l: src.normalize_columns(read_event_log(l)),
    "SELECT * EXCLUDE (loginTime), strptime(loginTime, '%Y-%m-%dT%H:%M:%S.%gZ') AS loginTime FROM ("
    + EVENT_LOG_SQL.format(id="loginHistoryId", time="loginTime", user="userId", name="username", ip="sourceIp",
                           status="status", country="countryIso", app="application") + " FROM logins)")
over_logins(
    "a04_normalize_ui", lambda l: src.normalize_columns(
        src.read_login_csv(l.sparkSession, write_csv(as_ui(l), "ui"))),
    """SELECT username, date_trunc('minute', loginTime) AS loginTime, sourceIp, loginType, status, countryIso, tlsProtocol
       FROM logins""")


def time_texts(rows):
    shape = F.col("event_id") % 8
    return rows.select("event_id", F.when(shape == 0, iso())
                       .when(shape == 1, F.date_format("loginTime", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                       .when(shape == 2, F.date_format("loginTime", "yyyy-MM-dd HH:mm:ss"))
                       .when(shape == 3, F.date_format("loginTime", "MM/dd/yyyy hh:mm a"))
                       .when(shape == 4, F.date_format("loginTime", "MM/dd/yyyy HH:mm"))
                       .when(shape == 5, F.date_format("loginTime", "yyyy-MM-dd"))
                       .when(shape == 6, F.date_format("loginTime", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
                       .otherwise("not a time").alias("text"))


over_logins(
    "a05_parse_login_time",
    lambda l: time_texts(l).select("event_id", "text", parse_login_time(F.col("text")).alias("parsed")),
    """SELECT event_id, text, coalesce(try_strptime(text, '%Y-%m-%dT%H:%M:%S.%fZ'), try_strptime(text, '%Y-%m-%dT%H:%M:%SZ'),
         try_strptime(text, '%Y-%m-%d %H:%M:%S'), try_strptime(text, '%m/%d/%Y %I:%M %p'),
         try_strptime(text, '%m/%d/%Y %H:%M'),
         CASE WHEN text LIKE '%+02:00' THEN try_cast(text AS TIMESTAMPTZ) AT TIME ZONE 'UTC' ELSE try_cast(text AS TIMESTAMP) END) AS parsed
       FROM (SELECT event_id, CASE event_id % 8
           WHEN 0 THEN strftime(loginTime, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(loginTime, '%Y-%m-%dT%H:%M:%SZ')
           WHEN 2 THEN strftime(loginTime, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(loginTime, '%m/%d/%Y %I:%M %p')
           WHEN 4 THEN strftime(loginTime, '%m/%d/%Y %H:%M') WHEN 5 THEN strftime(loginTime, '%Y-%m-%d')
           WHEN 6 THEN strftime(loginTime, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'not a time' END AS text FROM logins)""")


def through_cache(logins):
    spark = logins.sparkSession
    path = write_csv(as_query_result(logins), "cached")
    cache = new_path(spark, "cache")
    first = sinks.cached_logins(spark, path, threshold_mb=0, cache_path=cache)
    again = sinks.cached_logins(spark, path, threshold_mb=0, cache_path=cache)
    return first.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(
        again.groupBy("status").agg(F.max("loginTime").alias("latest")), "status")


over_logins("a06_a07_parquet_cache", through_cache,
            """SELECT status, count(*) AS n, max(strftime(loginTime, '%Y-%m-%dT%H:%M:%S.%gZ')) AS latest
               FROM logins WHERE status IS NOT NULL GROUP BY status""")


def by_date_cache(logins):
    spark = logins.sparkSession
    path = new_path(spark, "by-date")
    sinks.write_parquet_cache(logins, path, partition_by_date=True)
    day = datetime.date(2024, 1, 15)
    return sinks.read_parquet_cache(spark, path).filter(F.col("loginDate") == F.lit(day)).select(
        "event_id", "loginTime", "loginDate")


over_logins("a06_cache_pruned_by_date", by_date_cache,
            """SELECT event_id, loginTime, CAST(loginTime AS DATE) AS loginDate FROM logins
               WHERE CAST(loginTime AS DATE) = DATE '2024-01-15'""")


def through_daily_cache(logins):
    """Two exports, then a third one that adds to some of their days."""
    spark = logins.sparkSession
    folder, cache = new_path(spark, "exports"), new_path(spark, "daily-cache")
    for number, part in enumerate(("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 3 = 2 AND user_id_even")):
        rows = as_query_result(logins.withColumn("user_id_even", F.col("userId").rlike("[02468]$")).filter(part))
        rows.write.option("header", True).csv(f"{folder}/{number}")
        daily_cache.refresh_daily_cache(spark, folder, cache)
    return daily_cache.daily_logins(spark, folder, cache).groupBy("loginDate").agg(
        F.count(F.lit(1)).alias("n"), F.max("loginTime").alias("latest"), F.countDistinct("sourceFile").cast("long").alias("files"))


over_logins("a06_daily_cache", lambda l: through_daily_cache(l).drop("files"),
            """SELECT CAST(loginTime AS DATE) AS loginDate, count(*) AS n, max(date_trunc('milliseconds', loginTime)) AS latest FROM logins
               WHERE event_id % 3 < 2 OR regexp_matches(userId, '[02468]$') GROUP BY ALL""")


def through_json(logins):
    spark = logins.sparkSession
    path = new_path(spark, "json")
    rows = as_query_result(logins)
    rows.write.json(path)
    return src.normalize_columns(src.read_login_json(spark, path, rows.columns))


over_logins("a09_read_login_json", through_json,
            """SELECT userId, date_trunc('milliseconds', loginTime) AS loginTime, sourceIp, status, loginSubType,
                 countryIso, networkId FROM logins""")


def filtered_csv(logins):
    spark = logins.sparkSession
    path = new_path(spark, "filtered")
    written = sinks.write_filtered_csv(logins, ["SOAP API", "Bulk API"], path)
    back = spark.read.option("header", True).schema(logins.schema).csv(path)
    return back.select("event_id", "userId", "loginSubType", F.lit(written).alias("written"))


over_logins("a10_k07_write_filtered_csv", filtered_csv,
            """SELECT event_id, userId, loginSubType, count(*) OVER () AS written FROM logins
               WHERE loginSubType IN ('SOAP API', 'Bulk API')""")


def written_findings(logins):
    spark = logins.sparkSession
    folder = new_path(spark, "findings")
    result = weak_tls_logins(logins)
    sinks.write_findings("weak-tls", result, folder)
    return spark.read.option("header", True).schema(result.schema).csv(f"{folder}/weak-tls").groupBy("tlsProtocol").agg(
        F.sum("logins").alias("logins"))


over_logins("a11_write_findings", written_findings,
            """SELECT tlsProtocol, CAST(count(*) AS BIGINT) AS logins FROM logins
               WHERE tlsProtocol IN ('TLSv1','TLSv1.1','TLS 1.0','TLS 1.1') OR cipherSuite LIKE '%RC4%'
                  OR cipherSuite LIKE '%DES%' OR cipherSuite LIKE '%MD5%' OR cipherSuite LIKE '%NULL%' GROUP BY 1""")


def weekly_union(logins):
    week = datetime.timedelta(days=7)
    start = datetime.datetime(2024, 1, 1)
    chunks = [src.between_times(logins, start + i * week, start + (i + 1) * week) for i in range(5)]
    return src.union_chunks(chunks).groupBy(F.to_date("loginTime").alias("day")).agg(F.count(F.lit(1)).alias("n"))


over_logins("a12_g02_union_chunks", weekly_union,
            "SELECT CAST(loginTime AS DATE) AS day, count(*) AS n FROM logins WHERE loginTime IS NOT NULL GROUP BY 1")


def windows(logins):
    names = ["LAST_N_DAYS:7", "TODAY", "YESTERDAY", "THIS_WEEK", "LAST_WEEK", "LAST_N_HOURS:36"]
    return src.union_chunks([
        src.recent_window(logins, name, AS_OF).agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min("loginTime").alias("first"),
            F.max("loginTime").alias("last"))
        for name in names])


over_logins("a13_recent_windows", windows, " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n, min(loginTime) AS first, max(loginTime) AS last FROM logins WHERE {where}"
    for name, where in [
        ("LAST_N_DAYS:7", "loginTime >= '2024-01-13'"),
        ("TODAY", "loginTime >= '2024-01-20' AND loginTime < '2024-01-21'"),
        ("YESTERDAY", "loginTime >= '2024-01-19' AND loginTime < '2024-01-20'"),
        ("THIS_WEEK", "loginTime >= '2024-01-14' AND loginTime < '2024-01-21'"),
        ("LAST_WEEK", "loginTime >= '2024-01-07' AND loginTime < '2024-01-14'"),
        ("LAST_N_HOURS:36", "loginTime >= '2024-01-18 22:00:00'")]))
over_logins(
    "a13_explicit_bounds",
    lambda l: src.between_times(l, datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 5), include_upper=True)
    .select("event_id", "loginTime"),
    "SELECT event_id, loginTime FROM logins WHERE loginTime >= '2024-01-03' AND loginTime <= '2024-01-05'")
over_logins("a14_calendar_counts", src.calendar_counts,
            """SELECT CAST(year(loginTime) AS INTEGER) AS year, CAST(month(loginTime) AS INTEGER) AS month,
                 count(*) AS logins FROM logins GROUP BY 1, 2""")
over_logins("a15_truncation_flag",
            lambda l: src.union_chunks([src.truncation_flag(l), src.truncation_flag(src.latest_rows(l, 500), 500)]),
            "SELECT count(*) = 20000 AS truncated FROM logins UNION ALL SELECT count(*) >= 500 FROM logins")
over_logins("a16_mask_ip", lambda l: l.select("event_id", mask_ip(F.col("sourceIp")).alias("masked")),
            "SELECT event_id, regexp_replace(sourceIp, '\\.\\d+$', '.xxx') AS masked FROM logins")
over_logins("f08_latest_rows", lambda l: src.latest_rows(l, 300).select("loginTime"),
            "SELECT loginTime FROM logins ORDER BY loginTime DESC NULLS LAST LIMIT 300")
