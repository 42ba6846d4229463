"""Registered queries for opportunity amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.checks.tables import derived, plain_times, table
from tallyward.operators import amounts as a

CALLS: dict = {}
SQL: dict = {}
LINES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8"]

OPP_COLUMNS = {
    "opp_id": "o_orderkey",
    "account_id": "o_custkey",
    "stage": "CASE o_orderstatus WHEN 'F' THEN 'closed won' WHEN 'P' THEN 'open' "
             "ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'closed lost' ELSE 'open' END END",
    "forecast_stage": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Commit' WHEN '2-HIGH' THEN 'Most Likely' "
                      "WHEN '3-MEDIUM' THEN 'Stretch' WHEN '5-LOW' THEN 'Pipeline' "
                      "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Omitted' END END",
    "mgr_forecast": "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 7 = 0 END",
    "mgr_bridge": "o_orderkey % 7 = 1 OR o_orderkey % 210 = 0",
    "is_debooking": "o_orderkey % 31 = 0",
    "probability": "CAST(CAST(o_orderkey % 11 AS DOUBLE) / 10 AS DECIMAL(4,2))",
    "is_new_business": "o_orderkey % 3 = 0",
    "is_renewal": "o_orderkey % 3 = 1",
    "related_opportunity_id": "CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey - 1 - o_orderkey % 50 END",
    "period": "CAST(year(o_orderdate) AS INT)",
}

PRODUCT_COLUMNS = {
    "opp_id": "l_orderkey",
    "product_family": "CASE p_type WHEN 'ECONOMY' THEN 'Subscription' WHEN 'PROMO' THEN 'Support' "
                      "WHEN 'MEDIUM' THEN 'US - Subscription' WHEN 'LARGE' THEN 'Training' "
                      "WHEN 'SMALL' THEN 'Professional Services' ELSE 'Managed Services' END",
    "product_line": "p_brand",
    "list_price": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "discount_amount": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))",
    "tcv": "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) "
           "* CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))",
    "acv": "CAST(floor(l_extendedprice / (1 + l_linenumber % 3)) AS DECIMAL(18,2))",
}
TARGET_COLUMNS = {
    "segment": "c_mktsegment",
    "period": "CAST(1992 + c_custkey % 11 AS INT)",
}


def opportunities(spark, sf_dir):
    orders = derived(table(spark, sf_dir, "orders"), OPP_COLUMNS)
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey AS account_id", "c_mktsegment AS segment")
    return orders.join(customer, "account_id")


def products(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return derived(joined, PRODUCT_COLUMNS)


def targets(spark, sf_dir):
    rows = derived(table(spark, sf_dir, "customer"), TARGET_COLUMNS)
    return rows.groupBy("segment", "period").agg((F.count(F.lit(1)) * 1000).cast("decimal(18,2)").alias("target"))


def columns_sql(columns):
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


CTES = f"""WITH products AS (SELECT {columns_sql(PRODUCT_COLUMNS)} FROM lineitem JOIN part ON l_partkey = p_partkey),
opps AS (SELECT {columns_sql(OPP_COLUMNS)}, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey),
targets AS (SELECT segment, period, CAST(count(*) * 1000 AS DECIMAL(18,2)) AS target
  FROM (SELECT {columns_sql(TARGET_COLUMNS)} FROM customer) GROUP BY 1, 2),
fam AS (SELECT *, product_family IN ('Subscription','Support','US - Subscription','Managed Services') AS subs,
  product_family IN ('Training','Public Training') AS trn FROM products),
amounts AS (SELECT opp_id, sum(tcv) AS tcv, coalesce(sum(tcv) FILTER (subs), 0) AS tcv_subscription,
  coalesce(sum(tcv) FILTER (NOT subs AND NOT trn), 0) AS tcv_services, coalesce(sum(tcv) FILTER (trn), 0) AS tcv_training,
  sum(acv) AS acv, coalesce(sum(acv) FILTER (subs), 0) AS acv_subs,
  coalesce(sum(acv) FILTER (NOT subs AND NOT trn), 0) AS acv_svcs, coalesce(sum(acv) FILTER (trn), 0) AS acv_tng,
  coalesce(sum(list_price) FILTER (subs), 0) AS list_price_subs, sum(list_price) AS total_list_price,
  sum(discount_amount) AS total_discounted_amount FROM fam GROUP BY opp_id)"""


def doubles(df):
    """Exact decimals shown as doubles, so that both engines print them alike."""
    return df.select(*[
        F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`") for n, t in df.dtypes])


def register(name, build, sql):
    CALLS[name] = lambda spark, sf_dir: plain_times(doubles(build(spark, sf_dir)))
    SQL[name] = f"{CTES} {sql}"


def cast_all(names):
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


AMOUNTS = ["tcv", "tcv_subscription", "tcv_services", "tcv_training", "acv", "acv_subs", "acv_svcs", "acv_tng",
           "list_price_subs", "total_list_price", "total_discounted_amount"]
register("m01_m03_m08_opportunity_amounts",
         lambda s, d: a.opportunity_amounts(products(s, d)).withColumn("discount_pct", F.round("discount_pct", 6)),
         f"""SELECT opp_id, {cast_all(AMOUNTS)},
               round(CAST(total_discounted_amount AS DOUBLE) / CAST(tcv AS DOUBLE) * 100, 6) AS discount_pct FROM amounts""")


def classes(s, d):
    return a.revenue_classes(opportunities(s, d), a.opportunity_amounts(products(s, d)))


register(
    "m04_m07_m09_revenue_classes", classes,
    f"""SELECT opp_id, {cast_all(["new_arr", "add_on_acv_subs", "renewal_amount", "weighted_acv"])},
          CAST(new_arr + add_on_acv_subs AS DOUBLE) AS nao_subs FROM (
          SELECT o.opp_id, CASE WHEN is_new_business THEN x.acv_subs ELSE 0 END AS new_arr,
            CASE WHEN NOT is_new_business AND NOT is_renewal THEN x.acv_subs ELSE 0 END AS add_on_acv_subs,
            CASE WHEN is_renewal THEN least(x.acv_subs, coalesce(p.acv_subs, x.acv_subs)) ELSE 0 END AS renewal_amount,
            x.acv * probability AS weighted_acv
          FROM opps o JOIN amounts x ON o.opp_id = x.opp_id LEFT JOIN amounts p ON p.opp_id = o.related_opportunity_id)""")
register("m10_product_line_amounts", lambda s, d: a.product_line_amounts(products(s, d), LINES),
         "SELECT opp_id, " + ", ".join(
             f"""CAST(coalesce(sum(acv) FILTER (product_line = '{n}'), 0) AS DOUBLE) AS "{n}" """ for n in LINES)
         + ", CAST(coalesce(sum(acv) FILTER (product_line NOT IN (" + ", ".join(f"'{n}'" for n in LINES)
         + ")), 0) AS DOUBLE) AS \"Other\" FROM fam WHERE subs GROUP BY opp_id")
register("m11_related_renewals",
         lambda s, d: a.related_renewals(opportunities(s, d), a.opportunity_amounts(products(s, d))),
         """SELECT o.opp_id, o.related_opportunity_id, CAST(p.acv_subs AS DOUBLE) AS related_renewal_amount,
              CAST(p.list_price_subs AS DOUBLE) AS renewal_baseline
            FROM opps o JOIN amounts p ON p.opp_id = o.related_opportunity_id""")
CALL = "coalesce(mgr_forecast OR mgr_bridge OR is_debooking, FALSE)"
FORECAST = {
    "closed": "stage = 'closed won'",
    "rep_commit_closed": "stage = 'closed won' OR (stage = 'open' AND forecast_stage = 'Commit')",
    "mgr_forecast": "mgr_forecast AND stage IN ('open', 'closed won')",
    "mgr_bridge": "mgr_bridge AND stage IN ('open', 'closed won')",
    "total_call": f"{CALL} AND stage IN ('open', 'closed won')",
    "total_call_open": f"{CALL} AND stage = 'open'",
    "most_likely": f"NOT {CALL} AND stage = 'open' AND forecast_stage IN ('Commit', 'Most Likely')",
    "stretch": f"NOT {CALL} AND stage = 'open' AND forecast_stage = 'Stretch'",
    "pipeline": f"NOT {CALL} AND stage = 'open' AND forecast_stage = 'Pipeline'",
    "pipeline_coverage": "stage = 'open'",
    "pipeline_not_forecasted": f"NOT {CALL} AND stage = 'open'",
}
register(
    "m12_m19_forecast",
    lambda s, d: a.forecast(opportunities(s, d), a.opportunity_amounts(products(s, d)), targets(s, d))
    .withColumn("total_to_target", F.round("total_to_target", 6)),
    f"""SELECT segment, period, {", ".join(f"coalesce({n}, 0) AS {n}" for n in FORECAST)}, target,
          target - coalesce(closed, 0) AS target_to_go, round(coalesce(total_call, 0) / target, 6) AS total_to_target FROM (
          SELECT segment, period, {", ".join(
              f"CAST(coalesce(sum(acv) FILTER ({c}), 0) AS DOUBLE) AS {n}" for n, c in FORECAST.items())}
          FROM opps o LEFT JOIN amounts x ON o.opp_id = x.opp_id GROUP BY segment, period) g
        FULL JOIN (SELECT segment, period, CAST(target AS DOUBLE) AS target FROM targets) t USING (segment, period)""")
register("m14_manager_flag_conflicts", lambda s, d: a.manager_flag_conflicts(opportunities(s, d)),
         "SELECT opp_id, stage, forecast_stage FROM opps WHERE mgr_forecast AND mgr_bridge")
