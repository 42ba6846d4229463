"""Opportunity amounts, renewals and forecast columns.

Inputs: ``opportunities`` (opp_id, stage, forecast_stage, mgr_forecast, mgr_bridge, is_debooking,
probability, is_new_business, is_renewal, related_opportunity_id, …), ``products`` (opp_id,
product_family, product_line, tcv, acv, list_price, discount_amount) and ``targets``.
Roll-ups add up partially before the shuffle, so an opportunity with many products is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.fixed import SUBSCRIPTION_FAMILIES, TRAINING_FAMILIES
from tallyward.session import written

OPEN, WON = "open", "closed won"


def is_subscription(family: Column) -> Column:
    return F.coalesce(family.isin(list(SUBSCRIPTION_FAMILIES)), F.lit(False))


def is_training(family: Column) -> Column:
    return F.coalesce(family.isin(list(TRAINING_FAMILIES)), F.lit(False))


def total_where(amount: str | Column, condition: Column) -> Column:
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("decimal(18,2)"))


def opportunity_amounts(products: DataFrame) -> DataFrame:
    """TCV, ACV, discount and list price totals per opportunity, by family, in one pass."""
    family = F.col("product_family")
    subs, training = is_subscription(family), is_training(family)
    services = ~subs & ~training
    return products.groupBy("opp_id").agg(
        F.sum("tcv").alias("tcv"),
        total_where("tcv", subs).alias("tcv_subscription"),
        total_where("tcv", services).alias("tcv_services"),
        total_where("tcv", training).alias("tcv_training"),
        F.sum("acv").alias("acv"),
        total_where("acv", subs).alias("acv_subs"),
        total_where("acv", services).alias("acv_svcs"),
        total_where("acv", training).alias("acv_tng"),
        total_where("list_price", subs).alias("list_price_subs"),
        F.sum("list_price").alias("total_list_price"),
        F.sum("discount_amount").alias("total_discounted_amount"),
        (F.try_divide(F.sum("discount_amount").cast("double"), F.sum("tcv").cast("double")) * 100).alias("discount_pct"))


def product_line_amounts(products: DataFrame, lines: Sequence[str], other: str = "Other") -> DataFrame:
    """ACV subscription per opportunity, one column per named product line and ``other``."""
    subs = products.filter(is_subscription(F.col("product_family")))
    line = F.when(F.col("product_line").isin(list(lines)), F.col("product_line")).otherwise(other)
    wide = (
        subs.withColumn("line", line).groupBy("opp_id")
        .pivot("line", [*lines, other]).agg(F.sum("acv"))
    )
    return wide.fillna(0)


def related_renewals(opportunities: DataFrame, amounts: DataFrame) -> DataFrame:
    """Renewal amount and list-price baseline carried over from the related earlier opportunity."""
    prior = amounts.select(
        F.col("opp_id").alias("related_opportunity_id"),
        F.col("acv_subs").alias("related_renewal_amount"), F.col("list_price_subs").alias("renewal_baseline"))
    return (
        opportunities.filter(F.col("related_opportunity_id").isNotNull())
        .select("opp_id", "related_opportunity_id").join(prior, "related_opportunity_id")
    )


def revenue_classes(opportunities: DataFrame, amounts: DataFrame) -> DataFrame:
    """New ARR, add-on, capped renewal, net annual orders and weighted ACV per opportunity.

    Amounts are added up once, and the opportunities read once.
    """
    own = written(amounts.select("opp_id", "acv", "acv_subs"), "amounts")  # joined twice
    # rows without a related opportunity get a key of their own, so that they do not all meet in one task
    key = F.coalesce(F.concat(F.lit("="), F.col("related_opportunity_id")), F.concat(F.lit("none "), F.col("opp_id")))
    related = own.select(F.concat(F.lit("="), F.col("opp_id")).alias("related_key"), F.col("acv_subs").alias("related_renewal_amount"))
    rows = opportunities.join(own, "opp_id").withColumn("related_key", key).join(related, "related_key", "left")
    subs, zero = F.col("acv_subs"), F.lit(0).cast("decimal(18,2)")
    new, renewal = F.col("is_new_business"), F.col("is_renewal")
    capped = F.least(subs, F.coalesce("related_renewal_amount", subs))
    return rows.select(
        "opp_id",
        F.when(new, subs).otherwise(zero).alias("new_arr"),
        F.when(~new & ~renewal, subs).otherwise(zero).alias("add_on_acv_subs"),
        F.when(renewal, capped).otherwise(zero).alias("renewal_amount"),
        (F.col("acv") * F.col("probability")).alias("weighted_acv"),
    ).withColumn("nao_subs", F.col("new_arr") + F.col("add_on_acv_subs"))


def forecast(opportunities: DataFrame, amounts: DataFrame, targets: DataFrame,
             by: Sequence[str] = ("segment", "period")) -> DataFrame:
    """Actuals, calls and pipeline in ACV per group, next to the group's target.

    Groups with a target alone and with opportunities alone both stay. An opportunity without products counts as 0, a
    missing flag as not set. Not forecasted is all that is open outside the total call, whatever its forecast stage.
    """
    rows = opportunities.join(amounts.select("opp_id", "acv"), "opp_id", "left")
    stage, call = F.col("stage"), F.col("forecast_stage")
    is_open, is_won = stage == OPEN, stage == WON
    forecasted, bridged, debooked = (F.coalesce(F.col(c), F.lit(False)) for c in ("mgr_forecast", "mgr_bridge", "is_debooking"))
    in_call = forecasted | bridged | debooked
    live = is_open | is_won
    grouped = rows.groupBy(*by).agg(
        total_where("acv", is_won).alias("closed"),
        total_where("acv", is_won | (is_open & (call == "Commit"))).alias("rep_commit_closed"),
        total_where("acv", forecasted & live).alias("mgr_forecast"),
        total_where("acv", bridged & live).alias("mgr_bridge"),
        total_where("acv", in_call & live).alias("total_call"),
        total_where("acv", in_call & is_open).alias("total_call_open"),
        total_where("acv", is_open & ~in_call & call.isin("Commit", "Most Likely")).alias("most_likely"),
        total_where("acv", is_open & ~in_call & (call == "Stretch")).alias("stretch"),
        total_where("acv", is_open & ~in_call & (call == "Pipeline")).alias("pipeline"),
        total_where("acv", is_open & ~in_call).alias("pipeline_not_forecasted"),
        total_where("acv", is_open).alias("pipeline_coverage"))
    sums = [c for c in grouped.columns if c not in by]
    total = F.col("total_call").cast("double")
    return (
        grouped.join(targets, list(by), "full")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(18,2)")) for c in sums})
        .withColumns({
            "target_to_go": F.col("target") - F.col("closed"),
            "total_to_target": F.try_divide(total, F.col("target").cast("double"))})
    )


def manager_flag_conflicts(opportunities: DataFrame) -> DataFrame:
    """Opportunities with both manager flags set; the flags exclude each other."""
    return opportunities.filter(F.col("mgr_forecast") & F.col("mgr_bridge")).select("opp_id", "stage", "forecast_stage")
