import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyward.checks import export_checks
from tallyward.functions import names as n
from tallyward.operators import amounts as a
from tallyward.operators import export_plan as x
from tallyward.plans.export import plan_export
from tallyward.sources import inventory as inv


def test_names(spark):
    cases = [
        ("a/b:c*?", "00P1", ".p df", "a_b_c__ [00P1].pdf"), ("  two   blanks ", "1", "", "two blanks [1]"),
        ("", "1", ".txt", "[1].txt"), (None, None, None, "[NO_ID]"), ("Café", " 9 ", ".doc", "Café [9].doc"),
        ("n" * 300, "123", ".txt", "n" * 245 + " [123].txt"), ("x", "  ", ".", "x [NO_ID]"), ("tab\there", "i:d", "..z", "tab_here [i_d]..z")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, b string, id string, e string")
    got = {r.i: r.t for r in df.select("i", n.target_file_name(F.col("b"), F.col("id"), F.col("e")).alias("t")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    assert len(got[5]) == 255


def test_split_and_brackets(spark):
    df = spark.createDataFrame([("a.b.c",), (".x",), ("x.",), ("none",), ("a [1] b [ 2 ] c",), ("[]",), ("x]y[",), ("[a]]",)], "s string")
    base, extension = n.base_and_extension(F.col("s"))
    rows = {r.s: r for r in df.select("s", base.alias("b"), extension.alias("e"), n.bracket_id(F.col("s")).alias("id"),
                                      n.segment_key(F.col("s")).alias("k")).collect()}
    assert (rows["a.b.c"].b, rows["a.b.c"].e) == ("a.b", ".c")
    assert [(rows[s].b, rows[s].e) for s in (".x", "x.", "none")] == [(".x", ""), ("x.", ""), ("none", "")]
    assert rows["a [1] b [ 2 ] c"].id == "2" and rows["a [1] b [ 2 ] c"].k == "#2"
    assert rows["[]"].id is None and rows["x]y["].id is None


ATTACHMENTS = [
    ("00P1", "plan.pdf", "006A", ("006A", "Opp", None, "001A", ("001A", "Acme")), "2024-01-05T10:00:00.000+0000", "2024-01-01T00:00:00Z"),
    ("00P2", None, "006A", ("006A", " ", None, None, ("001B", "Beta")), None, None),
    ("00P3", "x", "006A", None, None, None),
    ("00P4", "x", "", ("006A", "Opp", None, None, None), None, None),
    ("00P5", "x", "006Z", ("006Z", "Opp", None, None, None), None, None),
    ("00P1", "plan.pdf", "006A", ("006A", "Opp", None, "001A", ("001A", "Acme")), "2024-01-05T10:00:00.000+0000", "2024-01-01T00:00:00Z"),
]


@pytest.fixture
def tables(spark):
    return {
        "attachments": spark.createDataFrame(ATTACHMENTS, inv.ATTACHMENT_SCHEMA),
        "links": spark.createDataFrame([
            ("l1", "069A", ("068A", "2024-02-01T00:00:00Z", None, ("Title", "txt", None, None)), "800C",
             ("800C", None, "C-7", "001A", None)),
            ("l2", "069B", ("068B", None, None, ("T", None, None, None)), "006A", ("006A", "Opp", None, "001A", ("001A", "Acme"))),
        ], inv.DOCUMENT_LINK_SCHEMA),
        "parents": {"OPPORTUNITY": spark.createDataFrame([("006A",)], "Id string"),
                    "CONTRACT": spark.createDataFrame([("800C",)], "Id string")},
    }


def test_parent_ids_are_cut_to_those_in_use_before_they_are_made_distinct(spark, tables):
    unused = spark.range(2000).selectExpr("concat('006x', id) AS Id")
    known = unused.unionByName(spark.createDataFrame([("006A",), ("006A",), (None,), ("006Z",)], "Id string"))
    rows = inv.attachment_inventory(tables["attachments"], {"OPPORTUNITY": known, "ACCOUNT": known.filter("Id = '006A'")})
    want = [(i, k) for i in ("00P1", "00P1", "00P2") for k in ("ACCOUNT", "OPPORTUNITY")] + [("00P5", "OPPORTUNITY")]
    assert sorted(rows.select("downloadId", "parentType").collect()) == sorted(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    made_distinct = plan[plan.index("Aggregate [knownId"):]
    assert "LeftSemi" in made_distinct


def test_parent_ids_in_use_are_the_hash_table_and_the_tables_pass_unsorted(spark, tables):
    known = spark.range(2000).selectExpr("concat('006x', id) AS Id").unionByName(
        spark.createDataFrame([("006A",), ("006A",), (None,)], "Id string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = inv.file_inventory(tables["attachments"], tables["links"], {"OPPORTUNITY": known})
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        found = rows.select("downloadId", "parentId").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("ShuffledHashJoin" in line and "BuildRight" in line for line in semi)
    assert sorted(found) == [("00P1", "006A"), ("00P1", "006A"), ("00P2", "006A"), ("068B", "006A")]


def test_the_registered_plans_sort_no_parent_table_to_cut_it(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = export_checks.full_inventory(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and not [line for line in semi if "SortMergeJoin" in line]


def test_inventory_and_paths(tables):
    rows = x.with_targets(inv.file_inventory(**tables)).collect()
    paths = sorted((r.downloadId, r.folderPath, r.targetFileName) for r in rows)
    assert paths == sorted([
        ("00P1", "Acme [001A]/Opportunities/Opp [006A]", "plan [00P1].pdf"),
        ("00P1", "Acme [001A]/Opportunities/Opp [006A]", "plan [00P1].pdf"),
        ("00P2", "Beta [001B]/Opportunities/006A [006A]", "file [00P2]"),
        ("068A", "[001A]/Contracts/C-7 [800C]", "Title [069A].txt"),
        ("068B", "Acme [001A]/Opportunities/Opp [006A]", "T [069B]")])
    assert [r.lastModified for r in rows if r.downloadId == "068A"] == [dt.datetime(2024, 2, 1)]


def test_date_filters(tables):
    rows = inv.file_inventory(**tables)
    day = dt.date(2024, 1, 5)
    assert {r.downloadId for r in x.filter_dates_and_types(rows, x.ExportOptions(modified_since=day, modified_until=day)).collect()} == {"00P1"}
    assert x.filter_dates_and_types(rows, x.ExportOptions(modified_until=dt.date(2024, 1, 4))).count() == 0
    assert x.filter_dates_and_types(rows, x.ExportOptions(types=x.parse_types(["contracts"]))).count() == 1


def test_plan(spark, tables):
    existing = spark.createDataFrame([
        ("", "Old name [001A]", "folder"), ("Old name [001A]", "Opportunities", "folder"),
        ("Old name [001A]/Opportunities/Opp [006A]", "renamed [069B]", "file")], "folderPath string, name string, kind string")
    plan = plan_export(existing=existing, **tables)
    files = {(r.downloadId, r.action): r.files for r in plan["files"].collect()}
    assert files == {("00P1", "upload"): 1, ("00P1", "skip"): 1, ("00P2", "upload"): 1, ("068A", "upload"): 1, ("068B", "skip"): 1}
    assert [(r.name, r.newName) for r in plan["renames"].collect()] == [("renamed [069B]", "T [069B]")]
    folders = {(r.folderPath, r.name): r.action for r in plan["folders"].collect()}
    assert folders[("", "Acme [001A]")] == "rename"
    assert folders[("Acme [001A]/Opportunities", "Opp [006A]")] == "create"
    assert ("Acme [001A]", "Opportunities") not in folders
    assert {r.action: r.files for r in plan["counters"].collect()} == {"upload": 3, "skip": 2, "processed": 5}


def test_targets_use_python_for_names_beyond_ascii_only(spark):
    rows = [("a", "pdf", "Acme", "Opp"), ("e\u0301", "pdf", "Acme", "Opp"), ("b", None, None, "Caf\u0065\u0301"), (None, "", "A", "B"), ("c", "d\u0301", "A", "B")]
    inventory = spark.createDataFrame([(*r, "1", "OPPORTUNITY", "2", "3") for r in rows], "baseName string, extension string, accountName string, "
                                      "parentName string, namingId string, parentType string, accountId string, parentId string")
    got = sorted((r.targetFileName, r.folderPath) for r in x.with_targets(inventory).collect())
    assert got == sorted((r.targetFileName, r.folderPath) for r in x._targets(inventory, n.composed).collect())
    assert ("\u00e9 [1].pdf", "Acme [2]/Opportunities/Opp [3]") in got and len(got) == 5
    assert "Python" not in x._targets(inventory, n.as_it_is)._jdf.queryExecution().executedPlan().toString()


def test_retry_filters(spark, tables):
    report = spark.createDataFrame([
        ("OPPORTUNITY", " 00p1 ", "plan [00p1].pdf", "Acme [001a]/Opportunities/Opp [006A]", "", ""),
        (None, None, None, None, "", "")], inv.REPORT_SCHEMA)
    ids, types = x.id_filters_from_report(report)
    assert {(r.kind, r.id) for r in ids.collect()} == {("FILE", "00P1"), ("OPPORTUNITY", "006A"), ("ACCOUNT", "001A")}
    rows = x.filter_types(x.filter_ids(inv.file_inventory(**tables), ids), types)
    assert [r.downloadId for r in rows.collect()] == ["00P1", "00P1"]


@pytest.mark.parametrize("kinds", [(), ("FILE",), ("CONTRACT",), ("ACCOUNT",), ("FILE", "ACCOUNT", "OPPORTUNITY"), ("OTHER", "ACCOUNT", "CONTRACT")])
def test_id_filter_against_each_row(spark, kinds):
    import random

    rng = random.Random(len(kinds))
    some = lambda: rng.choice(["A", "b", " c ", "D", "E", None])
    rows = [(some(), some(), rng.choice(["ACCOUNT", "CONTRACT", "OPPORTUNITY", None]), some(), some(), rng.randrange(3)) for _ in range(400)]
    rows += rows[:60]
    inventory = spark.createDataFrame(rows, "downloadId string, namingId string, parentType string, parentId string, accountId string, n int")
    wanted = [(k, i) for k in kinds for i in ("A", "C", "C", "X")]
    got = x.filter_ids(inventory, spark.createDataFrame(wanted, "kind string, id string"))
    clean = lambda v: v.strip().upper() if v else v
    asked = {k for k in kinds if k != "OTHER"}

    def stays(r):
        file = "FILE" not in asked or ("FILE", clean(r[0])) in wanted or ("FILE", clean(r[1])) in wanted
        parent = r[2] not in asked or (r[2], clean(r[3])) in wanted
        account = "ACCOUNT" not in asked or r[2] == "ACCOUNT" or ("ACCOUNT", clean(r[4])) in wanted
        return file and parent and account

    order = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(filter(stays, rows), key=order)


def test_id_filter_reads_the_inventory_once(spark, tmp_path):
    spark.range(50).selectExpr("CAST(id AS STRING) AS downloadId", "'x' AS namingId", "'ACCOUNT' AS parentType", "'p' AS parentId",
                               "'a' AS accountId").write.parquet(str(tmp_path / "inv"))
    ids = spark.createDataFrame([("FILE", "3")], "kind string, id string")
    found = x.filter_ids(spark.read.parquet(str(tmp_path / "inv")), ids)
    assert [r.downloadId for r in found.collect()] == ["3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("== Final Plan"):plan.index("== Initial Plan")] if "== Final Plan" in plan else plan
    assert final.count("FileScan") == 1 and final.count("Join") == 1


def test_amounts(spark):
    products = spark.createDataFrame(
        [(1, "Subscription", "A", 10, 5, 12, 2), (1, "Training", "A", 4, 4, 4, 0), (1, None, "B", 3, 3, 3, 0),
         (2, "Support", "C", 8, 8, 9, 1)],
        "opp_id int, product_family string, product_line string, tcv int, acv int, list_price int, discount_amount int")
    total = {r.opp_id: r for r in a.opportunity_amounts(products).collect()}
    assert (total[1].tcv, total[1].tcv_subscription, total[1].tcv_services, total[1].tcv_training) == (17, 10, 3, 4)
    assert round(total[1].discount_pct, 4) == round(200 / 17, 4)
    lines = {r.opp_id: r.asDict() for r in a.product_line_amounts(products, ["A", "B"]).collect()}
    assert lines == {1: {"opp_id": 1, "A": 5, "B": 0, "Other": 0}, 2: {"opp_id": 2, "A": 0, "B": 0, "Other": 8}}
    opps = spark.createDataFrame([(1, True, False, None, 0.5), (2, False, True, 1, 0.25)],
                                 "opp_id int, is_new_business boolean, is_renewal boolean, related_opportunity_id int, probability double")
    classes = {r.opp_id: r for r in a.revenue_classes(opps, a.opportunity_amounts(products)).collect()}
    assert (classes[1].new_arr, classes[1].nao_subs, classes[1].weighted_acv) == (5, 5, 6.0)
    assert (classes[2].renewal_amount, classes[2].new_arr) == (5, 0)
