"""Dashboard queries over the stored core tables and marts.

Every function takes the tables and returns a DataFrame; results that are one record come
as one row. Ordering is done here, at the query, with ties broken by the key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import MONEY, flag_sum, long_sum, mean, money_sum, month_of, ratio, zero_if_null
from souk.operators.marts import NO_PROMOTION
from souk.operators.rollups import STATES, mean_of, order_states
from souk.operators.staging import Tables

# Two-letter to three-letter country codes on the map.
ISO3 = {
    "US": "USA", "CA": "CAN", "MX": "MEX",
    "BR": "BRA", "AR": "ARG", "CL": "CHL", "CO": "COL",
    "GB": "GBR", "DE": "DEU", "FR": "FRA", "ES": "ESP",
    "IT": "ITA", "PT": "PRT", "JP": "JPN", "AU": "AUS",
}

# Advertising spend as a share of monthly sales.
AD_SHARES = {"google_ads": "0.12", "facebook_ads": "0.08", "tiktok_ads": "0.05"}

BASELINE = "baseline (no promo)"
REGULAR = "regular promo"
AGGRESSIVE = "aggressive (>=30% / BOGO)"


def newest_day(t: Tables) -> Column:
    """Latest order date: known for a stored table, otherwise a scalar subquery over its latest month."""
    known = t.span("fct_orders", "order_date") if hasattr(t, "span") else None
    if known is not None:
        return F.lit(known[1])
    orders = t["fct_orders"]
    if "order_month" in orders.columns:
        latest = orders.agg(F.max("order_month").alias("m")).scalar()
        orders = orders.where(F.col("order_month") == latest)
    return orders.agg(F.max("order_date").alias("d")).scalar()


def last_days(t: Tables, days: int, *measures: str) -> DataFrame:
    """Partial sums per day of the last ``days`` days up to the newest order; without rollups, pruned to their months."""
    start = F.date_sub(newest_day(t), days)
    recent = F.col("order_date") > start
    kept = t.rollup("day") if hasattr(t, "rollup") else None
    if kept is not None:
        return kept.where(recent)
    orders = t["fct_orders"].where(recent)
    if "order_month" in orders.columns:
        orders = orders.where(F.col("order_month") >= F.trunc(start, "month"))
    return STATES["day"](orders, [], measures)


# ---- headline numbers -------------------------------------------------------


def kpi_overview(t: Tables) -> DataFrame:
    days = order_states(t, "day", "gmv", "orders", "priced", "units", "counted", "returned", "chargebacks")
    totals = days.agg(
        zero_if_null(F.sum("orders")).alias("orders_total"),
        money_sum("gmv").alias("gmv"),
        long_sum("units").alias("units_sold"),
        long_sum("returned").alias("returns_total"),
        long_sum("chargebacks").alias("chargebacks_total"),
        mean_of("gmv", "priced").alias("avg_order_value"),
        mean_of("units", "counted").alias("avg_units_per_order"),
    )
    return totals.withColumns(
        {
            "return_rate": ratio("returns_total", "orders_total"),
            "chargeback_rate": ratio("chargebacks_total", "orders_total"),
        }
    )


def kpi_30day_summary(t: Tables) -> DataFrame:
    return last_days(t, 30, "gmv", "priced", "units", "counted", "returned").agg(
        money_sum("gmv").alias("sales"),
        long_sum("units").alias("units_sold"),
        long_sum("returned").alias("returns_count"),
        mean_of("gmv", "priced").alias("aov"),
        mean_of("units", "counted").alias("auo"),
    )


def kpi_with_delta_week(t: Tables) -> DataFrame:
    """This week's sales against the week before; no change when there is no base."""
    this_week = F.col("order_date") > F.date_sub(newest_day(t), 7)
    sums = last_days(t, 14, "gmv").agg(
        money_sum(F.when(this_week, F.col("gmv"))).alias("gmv_this_week"),
        money_sum(F.when(~this_week, F.col("gmv"))).alias("gmv_last_week"),
    )
    change = ratio(F.col("gmv_this_week") - F.col("gmv_last_week"), "gmv_last_week")
    return sums.withColumn("gmv_delta_pct", F.when(F.col("gmv_last_week") > 0, change).otherwise(0.0))


# ---- time series ------------------------------------------------------------


def gmv_by_day(t: Tables, days: int = 14) -> DataFrame:
    return (
        last_days(t, days, "gmv", "orders")
        .groupBy(F.col("order_date").alias("order_day"))
        .agg(money_sum("gmv").alias("gmv"), long_sum("orders").alias("orders"))
        .orderBy("order_day")
    )


def gmv_by_month(t: Tables) -> DataFrame:
    return (
        order_states(t, "day", "gmv", "orders", "peak_orders")
        .groupBy(month_of("order_date").alias("month"))
        .agg(money_sum("gmv").alias("gmv"), long_sum("orders").alias("orders"), long_sum("peak_orders").alias("promo_peak_orders"))
        .orderBy("month")
    )


def avg_order_amount_by_weekday(t: Tables) -> DataFrame:
    this_week = F.col("order_date") > F.date_sub(newest_day(t), 7)
    daily = last_days(t, 14, "gmv", "priced").groupBy("order_date").agg(mean_of("gmv", "priced").alias("_mean"))
    return daily.select(
        F.date_format("order_date", "E MMM dd").alias("day_label"),
        "order_date",
        F.when(~this_week, F.col("_mean")).alias("last_week"),
        F.when(this_week, F.col("_mean")).alias("this_week"),
    ).orderBy("order_date")


# ---- geography --------------------------------------------------------------


def _by_country(t: Tables) -> DataFrame:
    states = order_states(t, "country", "gmv", "orders")
    return states.groupBy("ship_country").agg(money_sum("gmv").alias("gmv"), long_sum("orders").alias("orders"))


def gmv_by_country(t: Tables, iso3: Mapping[str, str] = ISO3) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for pair in iso3.items() for x in pair])
    return (
        _by_country(t)
        .withColumn("country_iso3", F.try_element_at(codes, F.col("ship_country")))
        .where(F.col("country_iso3").isNotNull())
    )


def gmv_by_region(t: Tables) -> DataFrame:
    regions = t["dim_geography"].select(F.col("country_code").alias("ship_country"), "region")
    return (
        _by_country(t)
        .join(regions, "ship_country", "left")
        .groupBy("region")
        .agg(money_sum("gmv").alias("gmv"), long_sum("orders").alias("orders"))
        .orderBy(F.desc("gmv"), "region")
    )


def top_countries(t: Tables, limit: int = 10) -> DataFrame:
    names = t["dim_geography"].select(
        F.col("country_code").alias("ship_country"), F.col("country_name").alias("country")
    )
    return (
        _by_country(t)
        .join(names.where(F.col("country").isNotNull()), "ship_country")
        .groupBy("country")
        .agg(money_sum("gmv").alias("gmv"), long_sum("orders").alias("orders"))
        .orderBy(F.desc("gmv"), "country")
        .limit(limit)
    )


# ---- leaders ----------------------------------------------------------------


def top_sellers(t: Tables, limit: int = 10) -> DataFrame:
    columns = ["seller_id", "seller_name", "country_code", "region", "gmv", "orders_count", "products_count"]
    return t["dim_seller"].select(*columns).orderBy(F.desc("gmv"), "seller_id").limit(limit)


def top_products(t: Tables, limit: int = 10) -> DataFrame:
    columns = ["product_id", "product_name", "category", "units_sold", "revenue"]
    return t["dim_product"].select(*columns).orderBy(F.desc("revenue"), "product_id").limit(limit)


def top_categories(t: Tables, limit: int = 10) -> DataFrame:
    return (
        t["dim_category"]
        .select(F.col("category_name").alias("category"), "units_sold", "gross_sales")
        .orderBy(F.desc("gross_sales"), "category")
        .limit(limit)
    )


# ---- logistics --------------------------------------------------------------


def shipping_level_breakdown(t: Tables) -> DataFrame:
    days = F.col("transit_days")
    level = F.when(days <= 2, 1).when(days <= 4, 2).when(days <= 7, 3).otherwise(4)
    names = F.array(*[F.lit(n) for n in ("Express", "Expedited", "Standard", "Slow")])
    return (
        t["fct_orders"]
        .where(days.isNotNull())
        .groupBy(level.alias("_level"))
        .agg(F.count("*").alias("orders"), money_sum("total").alias("gmv"))
        .orderBy("_level")
        .select(names[F.col("_level") - 1].alias("level"), "orders", "gmv")
    )


def sla_by_carrier(t: Tables) -> DataFrame:
    return t["sla_by_carrier"].orderBy(F.desc_nulls_last("sla_miss_rate"), "carrier_id", "ship_country")


# ---- returns and campaigns --------------------------------------------------


def category_region_returns(t: Tables) -> DataFrame:
    return t["category_region_return_rate"].orderBy(F.desc("return_rate"), "category_id", "region")


def gmv_by_promotion(t: Tables) -> DataFrame:
    return t["gmv_by_promotion"].orderBy(F.desc("gmv"), "promotion_id")


def gmv_by_promotion_type(t: Tables) -> DataFrame:
    """Per campaign type; the rates are plain means over campaigns."""
    return (
        t["gmv_by_promotion"]
        .where(F.col("promotion_id") != NO_PROMOTION)
        .groupBy(F.coalesce("promotion_type", F.lit("unknown")).alias("promotion_type"))
        .agg(
            F.count("*").alias("campaigns"),
            long_sum("orders_count").alias("orders"),
            money_sum("gmv").alias("gmv"),
            F.avg("chargeback_rate").alias("avg_chargeback_rate"),
            F.avg("return_rate").alias("avg_return_rate"),
        )
        .orderBy(F.desc("gmv"), "promotion_type")
    )


def aggressive_vs_baseline(t: Tables) -> DataFrame:
    """No campaign, regular and aggressive campaigns side by side.

    ``aov`` is the plain mean over campaigns; the two rates are weighted by sales.
    """
    kind = (
        F.when(F.col("promotion_id") == NO_PROMOTION, BASELINE)
        .when(F.col("is_aggressive"), AGGRESSIVE)
        .otherwise(REGULAR)
    )
    rank = F.when(F.col("bucket") == BASELINE, 1).when(F.col("bucket") == REGULAR, 2).otherwise(3)
    sales = F.col("gmv").cast("double")
    return (
        t["gmv_by_promotion"]
        .groupBy(kind.alias("bucket"))
        .agg(
            F.count("*").alias("campaigns"),
            long_sum("orders_count").alias("orders"),
            money_sum("gmv").alias("gmv"),
            F.when(F.sum("orders_count") != 0, F.avg("avg_order_value")).alias("aov"),
            ratio(F.sum(sales * F.col("chargeback_rate")), F.sum("gmv")).alias("weighted_chargeback_rate"),
            ratio(F.sum(sales * F.col("return_rate")), F.sum("gmv")).alias("weighted_return_rate"),
        )
        .orderBy(rank)
    )


def chargeback_by_method(t: Tables) -> DataFrame:
    return (
        t["dim_payment_method"]
        .select("method_code", "method_name", "transactions", "total_processed", "chargeback_rate", "chargeback_risk")
        .orderBy(F.desc("chargeback_rate"), "method_code")
    )


def reviews_distribution(t: Tables) -> DataFrame:
    return (
        t["fct_reviews"]
        .groupBy("rating")
        .agg(
            F.count("*").alias("reviews_count"),
            flag_sum(F.col("order_status") == "returned").alias("returned_count"),
        )
        .orderBy(F.asc_nulls_last("rating"))
    )


def anomalies_summary(t: Tables, top_n: int = 5) -> DataFrame:
    """Category and region pairs farthest from the plain mean return rate."""
    mart = t["category_region_return_rate"]
    rates = mart.select("category", "region", "return_rate", "gmv_loss_rate", "refund_total")
    norm = mart.agg(F.avg("return_rate").alias("norm")).scalar()
    return (
        rates.withColumn("delta_vs_baseline", F.col("return_rate") - norm)
        .orderBy(F.desc(F.abs("delta_vs_baseline")), "category", "region")
        .limit(top_n)
    )


# ---- growth -----------------------------------------------------------------


def cohort_retention(t: Tables) -> DataFrame:
    return t["customer_cohort_retention"].orderBy("cohort_month", "months_since_acquisition")


def pareto_sellers(t: Tables) -> DataFrame:
    return t["pareto_sellers"].orderBy("rank")


def growth_metrics(t: Tables) -> DataFrame:
    return t["growth_metrics_monthly"].orderBy("month")


def ltv_by_segment(t: Tables) -> DataFrame:
    return t["customer_ltv_by_segment"].orderBy("region", "tenure_bucket", "is_prime")


def monthly_sales_with_ad_spend(t: Tables) -> DataFrame:
    monthly = order_states(t, "day", "gmv").groupBy(month_of("order_date").alias("month")).agg(money_sum("gmv").alias("_sales"))
    spend = [
        (F.col("_sales") * F.lit(share).cast("decimal(3,2)")).cast("decimal(38,4)").alias(name)
        for name, share in AD_SHARES.items()
    ]
    return monthly.select("month", F.col("_sales").cast(MONEY).alias("amazon_sales"), *spend).orderBy("month")


# ---- run log ----------------------------------------------------------------


def pipeline_runs(t: Tables, limit: int = 25) -> DataFrame:
    return t["pipeline_health"].orderBy(F.desc("invocation_at"), "run_id").limit(limit)


def latest_run(t: Tables) -> DataFrame:
    return pipeline_runs(t, 1)


def latest_run_node_breakdown(t: Tables) -> DataFrame:
    log = t["audit_runs"]
    last = log.agg(F.max("invocation_at").alias("m")).scalar()
    return (
        log.where(F.col("invocation_at") == last)
        .select("node_name", "resource_type", "status", "duration_ms", "rows_affected", "message")
        .orderBy(F.desc("duration_ms"), "node_name")
    )


def slowest_models(t: Tables, limit: int = 10) -> DataFrame:
    return (
        t["audit_runs"]
        .where(F.col("resource_type").isin("model", "test"))
        .groupBy("node_name", "resource_type")
        .agg(mean("duration_ms").alias("avg_duration_ms"), F.count("*").alias("runs"))
        .orderBy(F.desc("avg_duration_ms"), "node_name", "resource_type")
        .limit(limit)
    )


def test_outcome_history(t: Tables) -> DataFrame:
    status = F.col("status")
    return (
        t["audit_runs"]
        .where(F.col("resource_type") == "test")
        .groupBy("invocation_at")
        .agg(
            flag_sum(status == "pass").alias("tests_pass"),
            flag_sum(status == "warn").alias("tests_warn"),
            flag_sum(status.isin("fail", "error")).alias("tests_fail"),
        )
        .orderBy("invocation_at")
    )
