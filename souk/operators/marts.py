"""Analytical marts. Facts are reduced to the mart's keys before small tables are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.columns import (
    MONEY,
    flag_sum,
    long_sum,
    mean,
    money_sum,
    month_of,
    months_crossed,
    ratio,
    zero_if_null,
)
from souk.operators.ordered import bracketed_median, median_bracket, running_totals
from souk.operators.rollups import mean_of, order_states
from souk.operators.staging import Tables
from souk.params import Params
from souk.session import settle

NO_PROMOTION = "NO_PROMOTION"


#: Months that fit into one word of bits.
WORD = 62


def _month_number(day: str) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _month_start(number: str) -> Column:
    n = F.col(number)
    return F.make_date(F.floor(n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))


def _bit(month: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (month % WORD).cast("int"))


def _months_in(word: int) -> Column:
    """The numbers of the months whose bits are set in one word."""
    numbers = F.array(*[F.lit(word * WORD + b) for b in range(WORD)])
    mask = F.coalesce(F.col(f"w{word}"), F.lit(0).cast("bigint"))
    return F.filter(numbers, lambda m: mask.bitwiseAND(_bit(m)) != 0)


def active_months(t: Tables) -> DataFrame:
    """(customer_id, months): the numbers of the months each customer ordered in.

    The months are collected as bits of a few integers, which a hash aggregate combines before and after the one shuffle.
    """
    orders = t["fct_orders"].where(F.col("customer_id").isNotNull())
    span = t.span("fct_orders", "order_date") if hasattr(t, "span") else None
    low, high = span or t["fct_orders"].agg(F.min("order_date"), F.max("order_date")).first()
    if low is None:
        return orders.select("customer_id", F.lit(None).cast("array<int>").alias("months"))
    words = range((low.year * 12 + low.month - 1) // WORD, (high.year * 12 + high.month - 1) // WORD + 1)
    number = _month_number("order_date")
    masks = [F.bit_or(F.when(F.floor(number / WORD) == w, _bit(number))).alias(f"w{w}") for w in words]
    return orders.groupBy("customer_id").agg(*masks).select("customer_id", F.concat(*[_months_in(w) for w in words]).alias("months"))


def category_region_return_rate(t: Tables, p: Params) -> DataFrame:
    """Returns against orders per category and region.

    The two sides are keyed differently on purpose: orders are limited to delivered or
    returned ones and placed by ship country, returns are not limited and placed by the
    customer's country. Returns without a matching order group drop out.
    """
    regions = t["stg_geography"].select("country_code", "region")
    key = ["category_id", "category", "region"]
    by_country = order_states(t, "category", "gmv", "orders", "priced")
    orders = (
        by_country.join(regions, by_country.ship_country == regions.country_code, "left")
        .withColumn("region", F.coalesce("region", F.lit("Other")))
        .groupBy(*key)
        .agg(
            long_sum("orders").alias("orders_total"),
            money_sum("gmv").alias("gmv"),
            mean_of("gmv", "priced").alias("avg_order_value"),
        )
    )
    groups = ["product_issue", "fit_issue", "customer_driven", "fulfillment_issue"]
    counts = [f"returns_{g}" for g in groups]
    returns_by_country = (
        t["fct_returns"]
        .where(F.col("category_primary").isNotNull())
        .groupBy("category_id", F.col("category_primary").alias("category"), "customer_country_code")
        .agg(
            F.count("*").alias("returns_total"),
            money_sum("refund_amount").alias("refund_total"),
            flag_sum(~F.col("is_within_policy")).alias("returns_outside_policy"),
            *[flag_sum(F.col("reason_category") == g).alias(c) for g, c in zip(groups, counts)],
        )
    )
    returns = (
        returns_by_country.join(
            regions, returns_by_country.customer_country_code == regions.country_code, "left"
        )
        .withColumn("region", F.coalesce("region", F.lit("Other")))
        .groupBy(*key)
        .agg(
            money_sum("refund_total").alias("refund_total"),
            *[long_sum(c).alias(c) for c in ["returns_total", "returns_outside_policy", *counts]],
        )
    )
    categories = t["stg_categories"].select(
        "category_id", "parent_category", F.col("is_high_return").alias("expected_high_return")
    )
    refunds = zero_if_null("refund_total", MONEY)
    loss = F.when(F.col("gmv") > 0, ratio(refunds, "gmv")).otherwise(0.0)
    return (
        orders.join(returns, key, "left")
        .join(categories, "category_id", "left")
        .select(
            "category_id",
            "category",
            "parent_category",
            "expected_high_return",
            "region",
            "orders_total",
            "gmv",
            "avg_order_value",
            zero_if_null("returns_total").alias("returns_total"),
            refunds.alias("refund_total"),
            ratio(zero_if_null("returns_total"), "orders_total").alias("return_rate"),
            loss.alias("gmv_loss_rate"),
            *[zero_if_null(c).alias(c) for c in [*counts, "returns_outside_policy"]],
        )
    )


def gmv_by_promotion(t: Tables, p: Params) -> DataFrame:
    """Campaign results, with orders outside any campaign as one more row.

    Payments and returns are counted per order first; the joined sides are then unique. The joins leave the
    orders dealt out by order_id, so they are totalled per order where they are, and only totals per campaign
    and task are shuffled once more.
    """
    payments = (
        t["fct_payments"]
        .groupBy("order_id")
        .agg(
            F.count("*").alias("_payments"),
            flag_sum(F.col("is_chargeback")).alias("_chargebacks"),
            flag_sum(F.col("is_refunded")).alias("_refunds"),
        )
    )
    returns = t["fct_returns"].groupBy("order_id").agg(F.count("return_id").alias("_returns"))
    usage = (
        t["fct_orders"]
        .select("order_id", "promotion_id", "total", "is_black_friday_order", "is_cyber_monday_order")
        .withColumn("promotion_id", F.coalesce("promotion_id", F.lit(NO_PROMOTION)))
        .join(payments, "order_id", "left")
        .join(returns, "order_id", "left")
        .groupBy("order_id", "promotion_id")
        .agg(
            F.count("*").alias("_orders"),
            F.sum("total").alias("_gmv"),
            F.count("total").alias("_priced"),
            flag_sum(F.col("is_black_friday_order")).alias("_black_friday"),
            flag_sum(F.col("is_cyber_monday_order")).alias("_cyber_monday"),
            *[F.sum(c).alias(c) for c in ("_payments", "_chargebacks", "_refunds", "_returns")],
        )
        .groupBy("promotion_id")
        .agg(
            long_sum("_orders").alias("orders_count"),
            money_sum("_gmv").alias("gmv"),
            mean_of("_gmv", "_priced").alias("avg_order_value"),
            long_sum("_black_friday").alias("black_friday_orders"),
            long_sum("_cyber_monday").alias("cyber_monday_orders"),
            ratio(F.sum("_chargebacks"), F.sum("_payments")).alias("chargeback_rate"),
            ratio(F.sum("_refunds"), F.sum("_payments")).alias("refund_rate"),
            ratio(F.sum("_returns"), F.count("order_id")).alias("return_rate"),
        )
    )
    campaigns = t["stg_promotions"].select(
        "promotion_id", "promotion_name", "promotion_type", "discount_value", "is_aggressive"
    )
    return usage.join(campaigns, "promotion_id", "left").select(
        *campaigns.columns,
        "orders_count",
        "gmv",
        "avg_order_value",
        "black_friday_orders",
        "cyber_monday_orders",
        *[zero_if_null(c, "double").alias(c) for c in ("chargeback_rate", "refund_rate", "return_rate")],
    )


def sla_by_carrier(t: Tables, p: Params) -> DataFrame:
    """Carrier service per destination; misses are measured against delivered orders."""
    late = (
        t["fct_returns"]
        .where(F.col("reason_code") == "arrived_late")
        .groupBy("order_id")
        .agg(F.count("*").alias("_late"))
    )
    # Late returns are matched by equality on the country, so an unknown country has none.
    by_delay = (
        t["fct_orders"]
        .where(F.col("carrier_id").isNotNull())
        .select("order_id", "carrier_id", "ship_country", "transit_days", "delivered_date")
        .join(late, "order_id", "left")
        .groupBy("carrier_id", "ship_country", "transit_days")
        .agg(
            F.count("*").alias("_orders"),
            F.count("delivered_date").alias("_delivered"),
            F.sum(F.when(F.col("ship_country").isNotNull(), F.col("_late"))).alias("_late"),
        )
    )
    carriers = t["stg_carriers"].drop("origin_country")
    missed = F.when(F.col("transit_days") > F.col("sla_promised_days"), F.col("_orders")).otherwise(0)
    timed = F.when(F.col("transit_days").isNotNull(), F.col("_orders"))
    return (
        by_delay.join(carriers, "carrier_id", "left")
        .groupBy("carrier_id", "carrier_name", "ship_country", "sla_promised_days", "reliability_score")
        .agg(
            long_sum("_orders").alias("orders_total"),
            long_sum("_delivered").alias("orders_delivered"),
            F.round(ratio(F.sum(F.col("transit_days") * F.col("_orders")), F.sum(timed)), 1).alias(
                "avg_transit_days"
            ),
            F.round(ratio(F.sum(missed), F.sum("_delivered")), 3).alias("sla_miss_rate"),
            zero_if_null(F.sum("_late")).alias("late_returns"),
        )
        .withColumn("late_return_rate", F.round(ratio("late_returns", "orders_total"), 4))
    )


def customer_cohort_retention(t: Tables, p: Params) -> DataFrame:
    """Share of each first-order-month cohort active in every later month.

    A customer is one row with a bit per month, so the shuffle takes one row per customer and task, however many orders
    and months they have; its lowest bit is the cohort.
    """
    active = (
        active_months(t)
        .select(F.array_min("months").alias("first"), F.explode("months").alias("month"))
        .groupBy("first", "month")
        .agg(F.count("*").alias("active_customers"))
        .select(_month_start("first").alias("cohort_month"), _month_start("month").alias("activity_month"), "active_customers")
        .withColumn("months_since_acquisition", months_crossed("cohort_month", "activity_month"))
    )
    founders = F.when(F.col("months_since_acquisition") == 0, F.col("active_customers"))
    size = F.max(founders).over(Window.partitionBy("cohort_month"))
    return active.withColumn("cohort_size", size).select(
        "cohort_month",
        "activity_month",
        "months_since_acquisition",
        "active_customers",
        "cohort_size",
        ratio("active_customers", "cohort_size").alias("retention_pct"),
    )


def pareto_sellers(t: Tables, p: Params) -> DataFrame:
    """Sellers by sales with cumulative share and A/B/C class; ties go by seller id."""
    sellers = (
        t["dim_seller"]
        .where(F.col("gmv") > 0)
        .select("seller_id", "seller_name", "country_code", "region", "gmv", "orders_count")
    )
    ranked = running_totals(
        sellers,
        [F.col("gmv").desc(), F.col("seller_id").asc()],
        {"rank": F.lit(1).cast("bigint"), "_sales": F.col("gmv")},
    )
    share = F.col("cumulative_gmv_pct")
    return ranked.select(
        "rank",
        *sellers.columns,
        ratio("_sales", "_sales_total").alias("cumulative_gmv_pct"),
    ).withColumn("pareto_bucket", F.when(share <= 0.50, "A").when(share <= 0.80, "B").otherwise("C"))


def growth_metrics_monthly(t: Tables, p: Params) -> DataFrame:
    """Monthly results with growth. The lags step by rows, so a missing month shifts them.

    The window runs over one row per calendar month.
    """
    sums = (
        order_states(t, "day", "gmv", "orders", "priced", "units")
        .groupBy(month_of("order_date").alias("month"))
        .agg(
            money_sum("gmv").alias("gmv"),
            long_sum("orders").alias("orders"),
            long_sum("units").alias("units_sold"),
            mean_of("gmv", "priced").alias("avg_order_value"),
        )
    )
    customers = active_months(t).select(F.explode("months").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    customers = customers.select(_month_start("m").alias("month"), F.col("n").alias("active_customers"))
    monthly = sums.join(customers, "month", "left").select(
        "month", "gmv", "orders", zero_if_null("active_customers").alias("active_customers"), "units_sold", "avg_order_value"
    )
    line = Window.orderBy("month")

    def growth(base: str):
        return F.when(F.col(base) > 0, ratio(F.col("gmv") - F.col(base), base))

    return (
        monthly.withColumn("gmv_prev_month", F.lag("gmv", 1).over(line))
        .withColumn("gmv_prev_year", F.lag("gmv", 12).over(line))
        .withColumn("mom_growth_pct", growth("gmv_prev_month"))
        .withColumn("yoy_growth_pct", growth("gmv_prev_year"))
        .withColumn("annualized_run_rate", (F.col("gmv") * 12).cast(MONEY))
    )


def customer_ltv_by_segment(t: Tables, p: Params) -> DataFrame:
    """Lifetime value net of refunds per region, prime flag and tenure bucket.

    An unknown tenure falls in the last bucket; customers without a region are left out.
    """
    per_order = t["fct_returns"].groupBy("order_id").agg(money_sum("refund_amount").alias("_refund"))
    refunds = (
        t["fct_orders"]
        .select("order_id", "customer_id")
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(money_sum("_refund").alias("_refunds"))
    )
    tenure = F.col("tenure_days")
    bucket = F.when(tenure < 90, "< 3mo").when(tenure < 365, "3-12mo").when(tenure < 730, "1-2y")
    customers = (
        t["dim_mkt_customer"]
        .where(F.col("region").isNotNull())
        .select("customer_id", "region", "is_prime", tenure, "orders_count", "lifetime_gmv")
        .join(refunds, "customer_id", "left")
        .select(
            "region",
            "is_prime",
            bucket.otherwise("2y+").alias("tenure_bucket"),
            "orders_count",
            "lifetime_gmv",
            (F.col("lifetime_gmv") - zero_if_null("_refunds", MONEY)).cast(MONEY).alias("net_ltv"),
        )
    )
    key = ["region", "is_prime", "tenure_bucket"]
    measures = [
        F.count("*").alias("customers"),
        mean("orders_count").alias("avg_orders_per_customer"),
        mean("lifetime_gmv").alias("avg_lifetime_gmv"),
        mean("net_ltv").alias("avg_net_ltv"),
        money_sum("net_ltv").alias("total_net_ltv"),
    ]
    if p.approx_median:
        middle = F.percentile_approx(F.col("net_ltv").cast("double"), 0.5).alias("median_net_ltv")
        return customers.groupBy(*key).agg(*measures, middle)
    # The facts are joined once; measures and bracket come out of one pass over the customers, the median out of another.
    customers = settle(customers, "customers")
    segments = settle(customers.groupBy(*key).agg(*measures, *median_bracket("net_ltv")), "segments")
    brackets = segments.select(*key, "_values", "_low", "_high")
    medians = bracketed_median(customers.select(*key, "net_ltv"), brackets, key, "net_ltv", "median_net_ltv")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}"))
    return (
        segments.drop("_values", "_low", "_high").alias("s").join(medians.alias("m"), same, "left").select("s.*", "m.median_net_ltv")
    )


def pipeline_health(t: Tables, p: Params) -> DataFrame:
    """One row per recorded run with node counts by outcome."""
    runs = (
        t["audit_runs"]
        .groupBy("run_id", "invocation_at")
        .agg(
            F.max("git_sha").alias("git_sha"),
            F.min("started_at").alias("started_at"),
            F.max("completed_at").alias("completed_at"),
            long_sum("duration_ms").alias("total_duration_ms"),
            F.count("*").alias("nodes_total"),
            flag_sum(F.col("status").isin("success", "pass")).alias("pass_count"),
            flag_sum(F.col("status") == "warn").alias("warn_count"),
            flag_sum(F.col("status").isin("fail", "error")).alias("error_count"),
            flag_sum(F.col("status") == "skipped").alias("skipped_count"),
        )
    )
    health = F.when(F.col("error_count") > 0, "failed").when(F.col("warn_count") > 0, "warning")
    return runs.select(
        "run_id",
        F.substring("run_id", 1, 8).alias("run_short"),
        "git_sha",
        "invocation_at",
        "started_at",
        "completed_at",
        "total_duration_ms",
        (F.col("total_duration_ms").cast("double") / 1000).alias("total_duration_seconds"),
        "nodes_total",
        "pass_count",
        "warn_count",
        "error_count",
        "skipped_count",
        health.otherwise("green").alias("overall_status"),
    )
