"""Registered queries for file inventories and export plans."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyward.checks.tables import derived, plain_times, table
from tallyward.functions import names as n
from tallyward.functions.times import parse_offset_time
from tallyward.operators import export_plan as x
from tallyward.session import new_path, written
from tallyward.sources import inventory as inv
from tallyward.sources.sinks import write_json_lines

CALLS: dict = {}
SQL: dict = {}
ACUTE = "́"


def offset_time(k):
    day = f"lpad(CAST(1 + {k} % 28 AS STRING), 2, '0')"
    minute = f"lpad(CAST({k} % 60 AS STRING), 2, '0')"
    return (f"CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 7 = 1 THEN 'no date' "
            f"WHEN {k} % 7 = 2 THEN concat('2024-01-', {day}, 'T23:', {minute}, ':30.250-0230') "
            f"WHEN {k} % 7 = 3 THEN concat('2024-01-', {day}, 'T10:', {minute}, ':00Z') "
            f"ELSE concat('2024-01-', {day}, 'T10:', {minute}, ':00.000+0000') END")


def expected_time(k):
    day = f"lpad(CAST(1 + {k} % 28 AS STRING), 2, '0')"
    minute = f"lpad(CAST({k} % 60 AS STRING), 2, '0')"
    return (f"CASE WHEN {k} % 7 <= 1 THEN NULL "
            f"WHEN {k} % 7 = 2 THEN CAST(concat('2024-01-', {day}, ' 23:', {minute}, ':30.250') AS TIMESTAMP) + INTERVAL 150 MINUTE "
            f"ELSE CAST(concat('2024-01-', {day}, ' 10:', {minute}, ':00') AS TIMESTAMP) END")


def parent_columns(k):
    return {
        "kind": f"CASE {k} % 3 WHEN 0 THEN 'ACCOUNT' WHEN 1 THEN 'OPPORTUNITY' ELSE 'CONTRACT' END",
        "parent_id": f"CASE WHEN {k} % 17 = 0 THEN ' ' ELSE concat(CASE {k} % 3 WHEN 0 THEN '001' WHEN 1 THEN '006' ELSE '800' END, "
                     f"CAST({k} % CASE {k} % 3 WHEN 0 THEN 700 WHEN 1 THEN 300 ELSE 60 END AS STRING)) END",
        "parent_name": f"CASE WHEN {k} % 10 = 0 THEN NULL ELSE concat('Parent/', CAST({k} % 20 AS STRING)) END",
        "contract_number": f"CASE WHEN {k} % 20 = 0 THEN concat('C-', CAST({k} AS STRING)) END",
        "direct_account": f"CASE WHEN {k} % 5 <> 0 THEN concat('001', CAST({k} % 90 AS STRING)) END",
        "nested_account": f"CASE WHEN {k} % 4 <> 0 THEN concat('001', CAST({k} % 80 AS STRING)) END",
        "nested_name": f"CASE WHEN {k} % 8 <> 1 THEN concat('Acct ', CAST({k} % 70 AS STRING)) END",
    }


ATTACHMENT_COLUMNS = {
    "k": "doc_id",
    "id": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('00P', CAST(doc_id AS STRING)) END",
    "name": f"""CASE doc_id % 9 WHEN 0 THEN 'report.final.pdf' WHEN 1 THEN '.hidden' WHEN 2 THEN 'trail.' WHEN 3 THEN 'no dot'
      WHEN 4 THEN concat(repeat('n', 300), '.txt') WHEN 5 THEN 'a/b:c*?.xl sx' WHEN 6 THEN 'Cafe{ACUTE}.doc' WHEN 7 THEN NULL
      ELSE concat('  two   blanks ', CAST(doc_id AS STRING), ' .pdf') END""",
    **parent_columns("doc_id"),
    "modified": offset_time("doc_id"),
    "created": offset_time("(doc_id + 3)"),
}
LINK_COLUMNS = {
    "k": "page_id",
    "document_id": "concat('069', CAST(page_id AS STRING))",
    "version_id": "CASE WHEN page_id % 11 = 0 THEN '' ELSE concat('068', CAST(page_id AS STRING)) END",
    "title": "CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN '  ' ELSE concat('Doc ', url) END",
    "file_extension": "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '.p df' ELSE 'html' END",
    **parent_columns("page_id"),
    "version_modified": offset_time("page_id"),
    "modified": offset_time("(page_id + 1)"),
    "version_created": offset_time("(page_id + 2)"),
    "created": offset_time("(page_id + 4)"),
}
PARENT_STRUCT = ("named_struct('Id', parent_id, 'Name', parent_name, 'ContractNumber', contract_number, "
                 "'AccountId', direct_account, 'Account', CASE WHEN nested_account IS NOT NULL THEN "
                 "named_struct('Id', nested_account, 'Name', nested_name) END)")


def parents(spark, sf_dir):
    return {
        "ACCOUNT": table(spark, sf_dir, "customer").selectExpr("concat('001', CAST(c_custkey AS STRING)) AS Id"),
        "OPPORTUNITY": table(spark, sf_dir, "orders").selectExpr("concat('006', CAST(o_orderkey AS STRING)) AS Id"),
        "CONTRACT": table(spark, sf_dir, "supplier").selectExpr("concat('800', CAST(s_suppkey AS STRING)) AS Id"),
    }


def attachments(spark, sf_dir):
    flat = derived(table(spark, sf_dir, "documents"), ATTACHMENT_COLUMNS)
    return flat.selectExpr("id AS Id", "name AS Name", "parent_id AS ParentId", f"{PARENT_STRUCT} AS Parent",
                           "modified AS LastModifiedDate", "created AS CreatedDate", "kind")


def links(spark, sf_dir):
    flat = derived(table(spark, sf_dir, "pages"), LINK_COLUMNS)
    return flat.selectExpr(
        "concat('l', CAST(k AS STRING)) AS Id", "document_id AS ContentDocumentId",
        "named_struct('LatestPublishedVersionId', version_id, 'LastModifiedDate', modified, 'CreatedDate', created, "
        "'LatestPublishedVersion', named_struct('Title', title, 'FileExtension', file_extension, "
        "'LastModifiedDate', version_modified, 'CreatedDate', version_created)) AS ContentDocument",
        "parent_id AS LinkedEntityId", f"{PARENT_STRUCT} AS LinkedEntity", "kind")


def full_inventory(spark, sf_dir):
    """All six kinds; a file belongs to the parent table that its parent id is found in."""
    return inv.file_inventory(attachments(spark, sf_dir).drop("kind"), links(spark, sf_dir).drop("kind"),
                              parents(spark, sf_dir))


def columns_sql(columns):
    return ", ".join(f"{e} AS {a}" for a, e in columns.items())


PARENT_SQL = """kind AS parentType, parent_id AS parentId,
  coalesce(nullif(trim(parent_name), ''), CASE WHEN kind = 'CONTRACT' THEN contract_number END, parent_id) AS parentName,
  CASE WHEN kind = 'ACCOUNT' THEN parent_id ELSE coalesce(direct_account, nested_account) END AS accountId,
  CASE WHEN kind = 'ACCOUNT' THEN coalesce(nullif(trim(parent_name), ''), parent_id)
       ELSE CASE WHEN nested_account IS NOT NULL THEN nested_name END END AS accountName"""
INVENTORY_CTES = f"""ids AS (SELECT concat('001', CAST(c_custkey AS STRING)) AS id FROM customer UNION ALL
  SELECT concat('006', CAST(o_orderkey AS STRING)) FROM orders UNION ALL SELECT concat('800', CAST(s_suppkey AS STRING)) FROM supplier),
att AS (SELECT {columns_sql(ATTACHMENT_COLUMNS)}, {expected_time("doc_id")} AS lm, {expected_time("(doc_id + 3)")} AS cr FROM documents),
lnk AS (SELECT {columns_sql(LINK_COLUMNS)}, coalesce({expected_time("page_id")}, {expected_time("(page_id + 1)")}) AS lm,
  coalesce({expected_time("(page_id + 2)")}, {expected_time("(page_id + 4)")}) AS cr FROM pages),
a_inv AS (SELECT {PARENT_SQL}, id AS downloadId, id AS namingId,
    CASE WHEN regexp_matches(fname, '(?s)^.+\\.[^.]+$') THEN regexp_extract(fname, '(?s)^(.+)(\\.[^.]+)$', 1) ELSE fname END AS baseName,
    CASE WHEN regexp_matches(fname, '(?s)^.+\\.[^.]+$') THEN regexp_extract(fname, '(?s)^(.+)(\\.[^.]+)$', 2) ELSE '' END AS extension,
    lm AS lastModified, cr AS created
  FROM (SELECT *, coalesce(name, 'file') AS fname FROM att) WHERE id IS NOT NULL AND parent_id IN (SELECT id FROM ids)),
d_inv AS (SELECT {PARENT_SQL}, version_id AS downloadId, document_id AS namingId, coalesce(title, 'file') AS baseName,
    CASE WHEN file_extension IS NULL THEN '' ELSE '.' || file_extension END AS extension, lm AS lastModified, cr AS created
  FROM lnk WHERE version_id <> '' AND parent_id IN (SELECT id FROM ids)),
inv AS (SELECT * FROM a_inv UNION ALL SELECT * FROM d_inv)"""
BAD = """'[\\\\/:*?"<>|\\x00-\\x1F]'"""


def clean_sql(value):
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({value}), {BAD}, '_', 'g'), '\\s+', ' ', 'g'))"


def named_sql(value, id_, extension="''"):
    return (f"CASE WHEN coalesce({value}, '') = '' THEN '[' || {id_} || ']' || {extension} ELSE "
            f"left({value}, 255 - length(' [' || {id_} || ']') - length({extension})) || ' [' || {id_} || ']' || {extension} END")


def key_sql(path):
    return f"array_to_string(list_transform(string_split({path}, '/'), lambda g: {segment_sql('g')}), '/')"


def segment_sql(name):
    return f"CASE WHEN regexp_matches({name}, '\\[[^\\[]*\\][^\\[\\]]*$') THEN '#' || trim(regexp_extract({name}, '\\[([^\\[]*)\\][^\\[\\]]*$', 1)) ELSE {name} END"


TARGET_CTES = f"""{INVENTORY_CTES},
cleaned AS (SELECT *, {clean_sql("baseName")} AS b, replace({clean_sql("regexp_replace(extension, '^\\.', '')")}, ' ', '') AS e0,
  {clean_sql("parentName")} AS pn, {clean_sql("accountName")} AS an FROM inv),
named AS (SELECT *, CASE WHEN e0 = '' THEN '' ELSE '.' || e0 END AS e FROM cleaned),
parts AS (SELECT *, {named_sql("b", "namingId", "e")} AS targetFileName, {named_sql("pn", "parentId")} AS pf,
  CASE WHEN accountId IS NOT NULL THEN {named_sql("an", "accountId")} END AS af FROM named),
targets AS (SELECT parentType, downloadId, namingId, lastModified, targetFileName, CASE WHEN parentType = 'ACCOUNT' THEN pf ELSE
    concat_ws('/', af, CASE WHEN parentType = 'OPPORTUNITY' THEN 'Opportunities' ELSE 'Contracts' END, pf) END AS folderPath FROM parts),
chosen AS (SELECT * FROM targets WHERE CAST(substr(namingId, 4) AS BIGINT) % 3 = 0),
existing AS (SELECT DISTINCT folderPath, CASE WHEN CAST(substr(namingId, 4) AS BIGINT) % 2 = 0 THEN targetFileName
    ELSE 'old [' || namingId || ']' END AS name, 'file' AS kind FROM chosen
  UNION ALL SELECT DISTINCT '', CASE WHEN length(folderPath) % 2 = 0 THEN string_split(folderPath, '/')[1]
    ELSE 'Old ' || regexp_extract(string_split(folderPath, '/')[1], '\\[[^\\[]*\\]$') END, 'folder' FROM chosen
  UNION ALL SELECT DISTINCT string_split(folderPath, '/')[1], string_split(folderPath, '/')[2], 'folder' FROM chosen
    WHERE contains(folderPath, '/')),
exf AS (SELECT *, {key_sql("folderPath")} AS fk, {segment_sql("name")} AS tk FROM existing),
keyed AS (SELECT *, {key_sql("folderPath")} AS fk, {segment_sql("targetFileName")} AS tk FROM targets)"""


def existing_of(targets):
    some = targets.filter("CAST(substr(namingId, 4) AS BIGINT) % 3 = 0")
    files = some.selectExpr("folderPath", "CASE WHEN CAST(substr(namingId, 4) AS BIGINT) % 2 = 0 THEN targetFileName "
                            "ELSE concat('old [', namingId, ']') END AS name", "'file' AS kind").distinct()
    top = some.selectExpr("'' AS folderPath", "CASE WHEN length(folderPath) % 2 = 0 THEN split(folderPath, '/')[0] "
                          "ELSE concat('Old ', regexp_extract(split(folderPath, '/')[0], '\\\\[[^\\\\[]*\\\\]$', 0)) END AS name",
                          "'folder' AS kind").distinct()
    second = some.filter("contains(folderPath, '/')").selectExpr(
        "split_part(folderPath, '/', 1) AS folderPath", "split_part(folderPath, '/', 2) AS name", "'folder' AS kind").distinct()
    return files.unionByName(top).unionByName(second)


def register(name, build, sql=None, ctes=TARGET_CTES):
    CALLS[name] = lambda spark, sf_dir: plain_times(build(spark, sf_dir))
    if sql is not None:
        SQL[name] = f"WITH {ctes} {sql}"


def targets(spark, sf_dir):
    """Named once and written: every part of a plan reads the same table."""
    return written(x.with_targets(full_inventory(spark, sf_dir)), "targets")


def with_existing(operator):
    def build(spark, sf_dir):
        wanted = targets(spark, sf_dir)
        return operator(wanted, existing_of(wanted))
    return build


register("o01_attachment_inventory",
         lambda s, d: inv.attachment_inventory(attachments(s, d).drop("kind"), {"OPPORTUNITY": parents(s, d)["OPPORTUNITY"]}),
         "SELECT * FROM a_inv WHERE parentType = 'OPPORTUNITY'", INVENTORY_CTES)
register("o02_document_inventory",
         lambda s, d: inv.document_inventory(links(s, d).drop("kind"), {"CONTRACT": parents(s, d)["CONTRACT"]}),
         "SELECT * FROM d_inv WHERE parentType = 'CONTRACT'", INVENTORY_CTES)
register("o03_g01_c09_full_inventory", full_inventory, "SELECT * FROM inv", INVENTORY_CTES)
OPTIONS = x.ExportOptions(
    modified_since=datetime.date(2024, 1, 3), modified_until=datetime.date(2024, 1, 25),
    created_since=datetime.date(2024, 1, 2), created_until=datetime.date(2024, 1, 27), types=("ACCOUNT", "CONTRACT"))
register("o04_filter_dates_and_types", lambda s, d: x.filter_dates_and_types(full_inventory(s, d), OPTIONS),
         """SELECT * FROM inv WHERE parentType IN ('ACCOUNT', 'CONTRACT') AND lastModified >= '2024-01-03' AND lastModified < '2024-01-26'
              AND created >= '2024-01-02' AND created < '2024-01-28'""", INVENTORY_CTES)


def by_ids(spark, sf_dir):
    wanted = x.id_filters(spark, accounts=[*[f" 001{i}" for i in range(0, 60)], "0015", "0015 ", "00119"], contracts=[f"800{i}" for i in range(5, 40)])
    return x.filter_ids(full_inventory(spark, sf_dir), wanted)


register("o04_filter_ids", by_ids,
         """SELECT * FROM inv WHERE accountId IN (SELECT '001' || CAST(i AS VARCHAR) FROM range(0, 60) t(i))
              AND (parentType <> 'CONTRACT' OR parentId IN (SELECT '800' || CAST(i AS VARCHAR) FROM range(5, 40) t(i)))""", INVENTORY_CTES)
register("o05_h16_h19_target_names", lambda s, d: targets(s, d).select("downloadId", "targetFileName", "folderPath"),
         "SELECT downloadId, targetFileName, folderPath FROM targets")
register(
    "o06_o07_c10_plan_files", with_existing(x.plan_files),
    """, first AS (SELECT fk, tk, min((downloadId, targetFileName, folderPath)) AS f FROM keyed GROUP BY fk, tk),
       copies AS (SELECT fk, tk, folderPath, targetFileName, downloadId, count(*) AS n FROM keyed GROUP BY ALL),
       decided AS (SELECT c.*, CASE WHEN f = (downloadId, targetFileName, folderPath)
           AND NOT EXISTS (SELECT 1 FROM exf e WHERE e.kind = 'file' AND e.fk = c.fk AND e.tk = c.tk) THEN 1 ELSE 0 END AS up
         FROM copies c JOIN first g ON c.fk = g.fk AND c.tk = g.tk)
       SELECT folderPath, targetFileName, downloadId, 'upload' AS action, CAST(up AS BIGINT) AS files FROM decided WHERE up > 0
       UNION ALL SELECT folderPath, targetFileName, downloadId, 'skip', n - up FROM decided WHERE n > up""")
register("o06_c11_file_renames", with_existing(x.plan_file_renames),
         """, wanted AS (SELECT fk, tk, arg_min(targetFileName, (downloadId, targetFileName)) AS newName FROM keyed
                WHERE tk LIKE '#%' GROUP BY fk, tk)
            SELECT e.folderPath, e.name, newName FROM exf e JOIN wanted w ON e.fk = w.fk AND e.tk = w.tk
            WHERE e.kind = 'file' AND e.name <> newName""")
register(
    "o06_c11_folders", with_existing(x.plan_folders),
    f""", steps AS (SELECT DISTINCT array_to_string(l[1:p - 1], '/') AS folderPath, l[p] AS name FROM (
           SELECT l, unnest(generate_series(1, len(l))) AS p FROM (SELECT DISTINCT string_split(folderPath, '/') AS l FROM targets))),
       want AS (SELECT fk, tk, min((folderPath, name)) AS w FROM (
           SELECT *, {key_sql("folderPath")} AS fk, {segment_sql("name")} AS tk FROM steps) GROUP BY fk, tk),
       have AS (SELECT fk, tk, min(name) AS oldName FROM exf WHERE kind = 'folder' GROUP BY fk, tk)
       SELECT w[1] AS folderPath, w[2] AS name, oldName, CASE WHEN oldName IS NULL THEN 'create' ELSE 'rename' END AS action
       FROM want LEFT JOIN have USING (fk, tk) WHERE oldName IS NULL OR oldName <> w[2]""")
register("o12_d14_run_counters", lambda s, d: x.run_counters(with_existing(x.plan_files)(s, d)),
         """, state AS (SELECT fk, tk, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM exf e WHERE e.kind = 'file' AND e.fk = k.fk AND e.tk = k.tk)) AS have
                FROM keyed k GROUP BY fk, tk)
            SELECT 'upload' AS action, CAST(count(*) FILTER (NOT have) AS BIGINT) AS files FROM state
            UNION ALL SELECT 'skip', CAST(sum(n) - count(*) FILTER (NOT have) AS BIGINT) FROM state
            UNION ALL SELECT 'processed', CAST(sum(n) AS BIGINT) FROM state""")
register("o08_o09_size_and_endpoint",
         lambda s, d: table(s, d, "documents").selectExpr("doc_id", "n_chars * 10000 AS size").select(
             "doc_id", x.size_class(F.col("size")).alias("size_class"),
             x.endpoint(F.concat(F.element_at(F.array(F.lit("068"), F.lit("00P"), F.lit("01X")),
                                              (F.col("doc_id") % 3 + 1).cast("int")), F.col("doc_id").cast("string"))).alias("endpoint")),
         """SELECT doc_id, CASE WHEN n_chars * 10000 >= 20971520 THEN 'chunked' ELSE 'single' END AS size_class,
              CASE doc_id % 3 WHEN 0 THEN 'version' WHEN 1 THEN 'attachment' END AS endpoint FROM documents""", "nothing AS (SELECT 1)")


def failures(spark, sf_dir):
    return targets(spark, sf_dir).filter("CAST(substr(namingId, 4) AS BIGINT) % 7 = 5").withColumn(
        "reason", F.lit('Upload error: "timeout"'))


def report_back(spark, sf_dir):
    path = new_path(spark, "report")
    write_json_lines(x.error_report(failures(spark, sf_dir)), path)
    return inv.read_error_report(spark, path)


FAILED = "failed AS (SELECT * FROM targets WHERE CAST(substr(namingId, 4) AS BIGINT) % 7 = 5)"
register("o10_error_report", report_back,
         f""", {FAILED} SELECT parentType AS type, downloadId, targetFileName, folderPath, coalesce(CASE
                WHEN epoch_us(lastModified) % 1000000 = 0 THEN strftime(lastModified, '%Y-%m-%dT%H:%M:%SZ')
                ELSE strftime(lastModified, '%Y-%m-%dT%H:%M:%S.%gZ') END, '') AS lastModified,
              'Upload error: "timeout"' AS reason FROM failed""")


def retried(spark, sf_dir):
    ids, types = x.id_filters_from_report(report_back(spark, sf_dir))
    return x.filter_types(x.filter_ids(full_inventory(spark, sf_dir), ids), types)


def last_id(path):
    return f"upper(trim(regexp_extract({path}, '\\[([^\\[]*)\\][^\\[\\]]*$', 1)))"


RETRY_CTES = f"""{TARGET_CTES}, {FAILED},
want AS (SELECT 'FILE' AS kind, upper(downloadId) AS id FROM failed UNION SELECT 'FILE', {last_id("targetFileName")} FROM failed
  UNION SELECT parentType, {last_id("string_split(folderPath, '/')[-1]")} FROM failed
  UNION SELECT 'ACCOUNT', nullif({last_id("string_split(folderPath, '/')[1]")}, '') FROM failed WHERE parentType <> 'ACCOUNT')"""
register("o11_c13_retry_from_report", retried,
         """SELECT * FROM inv WHERE parentType IN (SELECT parentType FROM failed)
              AND (upper(downloadId) IN (SELECT id FROM want WHERE kind = 'FILE') OR upper(namingId) IN (SELECT id FROM want WHERE kind = 'FILE'))
              AND upper(parentId) IN (SELECT id FROM want w WHERE w.kind = parentType)
              AND (parentType = 'ACCOUNT' OR upper(accountId) IN (SELECT id FROM want WHERE kind = 'ACCOUNT'))""", RETRY_CTES)
register("g04_union_of_id_filters",
         lambda s, d: x.union_filters(x.id_filters_from_report(report_back(s, d))[0],
                                      x.id_filters(s, files=["00p5", "abc"], accounts=["001-new"])),
         """SELECT kind, id FROM want WHERE id IS NOT NULL UNION SELECT 'FILE', '00P5' UNION SELECT 'FILE', 'ABC'
            UNION SELECT 'ACCOUNT', '001-NEW'""", RETRY_CTES)
register("h06_offset_times",
         lambda s, d: derived(table(s, d, "documents"), {"doc_id": "doc_id", "t": offset_time("doc_id")}).select(
             "doc_id", parse_offset_time(F.col("t")).alias("parsed")),
         f"SELECT doc_id, {expected_time('doc_id')} AS parsed FROM documents", "nothing AS (SELECT 1)")
register("h20_h21_bracket_ids",
         lambda s, d: table(s, d, "orders").selectExpr(
             "o_orderkey", "concat('x [a] y [ id', CAST(o_orderkey AS STRING), ' ]', CASE WHEN o_orderkey % 3 = 0 THEN ' [open' ELSE '.pdf' END) AS s")
         .select("o_orderkey", n.bracket_id(F.col("s")).alias("id")),
         "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'ID' || CAST(o_orderkey AS VARCHAR) END AS id FROM orders",
         "nothing AS (SELECT 1)")
