"""Stand-in tables derived from the given ones; the same expressions run in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOGIN_COLUMNS = {
    "event_id": "event_id",
    "userId": "concat('005', CAST(user_id AS STRING))",
    "username": "CASE WHEN event_id % 41 = 0 THEN NULL "
                "WHEN user_id % 5 = 0 THEN concat('svc.etl', CAST(user_id AS STRING), '@corp.example') "
                "ELSE concat('ada.lane@corp', CAST(user_id AS STRING), '.example') END",
    "loginTime": "CASE WHEN event_id % 211 <> 0 THEN CAST(ts AS TIMESTAMP) END",
    "sourceIp": "CASE WHEN event_id % 53 <> 0 THEN concat('10.0.0.', CAST(event_id % 40 AS STRING)) END",
    "status": "CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_type = 'error' THEN CASE event_id % 5 "
              "WHEN 0 THEN 'Restricted IP' WHEN 1 THEN 'Challenge Not Complete' ELSE 'Invalid Password' END "
              "ELSE 'Success' END",
    "loginSubType": "CASE event_type WHEN 'click' THEN 'SOAP API' WHEN 'view' THEN 'Bulk API' "
                    "WHEN 'signup' THEN 'REST API' WHEN 'error' THEN 'Application' END",
    "loginType": "CASE WHEN user_id % 3 = 0 AND event_id % 10 <> 0 THEN 'SAML Sp Initiated' "
                 "WHEN event_id % 4 = 0 THEN 'Remote Access 2.0' ELSE 'Application' END",
    "countryIso": "CASE WHEN event_id % 29 = 0 THEN NULL "
                  "WHEN event_id % 23 = 0 THEN CASE CAST(floor(event_id / 23) AS BIGINT) % 5 WHEN 0 THEN 'US' "
                  "WHEN 1 THEN 'GB' WHEN 2 THEN 'SG' WHEN 3 THEN 'XX' ELSE 'BR' END "
                  "ELSE CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'IN' ELSE 'JP' END END",
    "tlsProtocol": "CASE event_id % 11 WHEN 0 THEN 'TLSv1' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN NULL ELSE 'TLSv1.2' END",
    "cipherSuite": "CASE event_id % 13 WHEN 0 THEN 'ECDHE-RC4-SHA' WHEN 1 THEN 'DES-CBC3-SHA' "
                   "WHEN 2 THEN 'RSA-NULL-MD5' WHEN 3 THEN NULL ELSE 'AES256-GCM' END",
    "browser": "CASE event_id % 7 WHEN 0 THEN 'Firefox' WHEN 1 THEN NULL ELSE 'Chrome' END",
    "platform": "CASE WHEN event_id % 97 = 0 THEN 'Linux' WHEN user_id % 2 = 0 THEN 'Windows' ELSE 'macOS' END",
    "application": "CASE event_type WHEN 'click' THEN 'Data Loader' WHEN 'view' THEN 'Workbench' ELSE 'Browser' END",
    "clientVersion": "concat('v', CAST(event_id % 3 AS STRING))",
    "networkId": "CASE WHEN event_id % 6 = 0 THEN concat('0DB', CAST(user_id % 3 AS STRING)) END",
    "authMethodRef": "CASE event_id % 4 WHEN 0 THEN 'mfa' WHEN 1 THEN 'pwd,mfa' WHEN 2 THEN 'pwd' END",
    "sessionKey": "concat('s', CAST(user_id AS STRING), '-', CAST(event_id - event_id % 2500 AS STRING), '-', "
                  "CAST(event_id % 2 AS STRING))",
    "loginKey": "concat('k', CAST(event_id - event_id % 5 AS STRING))",
}
USER_COLUMNS = {
    "Id": "concat('005', CAST(c_custkey AS STRING))",
    "Username": "c_name",
    "IsActive": "c_custkey % 10 <> 4",
    "profile_name": "CASE c_mktsegment WHEN 'MACHINERY' THEN 'System Administrator' ELSE 'Standard User' END",
    "role_name": "c_mktsegment",
    "LastLoginDate": "CAST('2024-01-01 00:00:00' AS TIMESTAMP)",
    "UserType": "CASE WHEN c_nationkey % 2 = 0 THEN 'Standard' ELSE 'PowerPartner' END",
    "hasMfa": "c_nationkey % 3 <> 0",
}

LOGINS_CTE = "logins AS (SELECT {} FROM events)".format(
    ", ".join(f"{e} AS {a}" for a, e in LOGIN_COLUMNS.items()))
USERS_CTE = "users AS (SELECT {} FROM customer)".format(
    ", ".join(f"{e} AS {a}" for a, e in USER_COLUMNS.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS `{a}`" for a, e in columns.items()])


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "events"), LOGIN_COLUMNS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derived(table(spark, sf_dir, "customer"), USER_COLUMNS)
    return flat.selectExpr(
        "Id", "Username", "Username AS Name", "IsActive", "named_struct('Name', profile_name) AS Profile",
        "named_struct('Name', role_name) AS UserRole", "LastLoginDate", "UserType", "hasMfa")


def plain_times(df: DataFrame) -> DataFrame:
    """Zone-less timestamps, as the other engine shows them."""
    return df.selectExpr(*[
        f"CAST(`{name}` AS TIMESTAMP_NTZ) AS `{name}`" if kind == "timestamp" else f"`{name}`"
        for name, kind in df.dtypes])
