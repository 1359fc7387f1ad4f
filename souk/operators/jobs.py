"""Data jobs around the model: calendar, campaign attribution, lifecycle events, signal checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.columns import col, flag_sum, long_sum, month_of, ratio
from souk.operators.staging import Tables
from souk.operators.sweep import first_open
from souk.params import Params

# Shipping steps and the hours after the order at which each happens;
# the delivery step takes its time from the delivery date.
LIFECYCLE_HOURS = {"order_created": 0, "label_printed": 2, "handed_to_carrier": 8, "in_transit": 24}

# Countries watched for crypto fraud.
FRAUD_COUNTRIES = ("BR", "AR", "CL", "CO", "MX")


def calendar(span: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between two date columns, with the retail calendar flags.

    Black Friday is the day after the fourth Thursday of November, Cyber Monday three days
    later.
    """
    day = F.col("date_key")
    thanksgiving = F.date_add(F.next_day(F.make_date(F.year(day), F.lit(10), F.lit(31)), "Thu"), 21)
    weekday = F.date_format(day, "EEEE")
    days = span.select(F.explode(F.sequence(first, last)).alias("date_key"))
    return days.select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        weekday.alias("day_of_week"),
        F.concat(F.lit("Q"), F.quarter(day).cast("string")).alias("quarter"),
        weekday.isin("Saturday", "Sunday").alias("is_weekend"),
        (day == F.date_add(thanksgiving, 1)).alias("is_black_friday"),
        (day == F.date_add(thanksgiving, 4)).alias("is_cyber_monday"),
        ((F.month(day) == 12) & (F.dayofmonth(day) == 24)).alias("is_christmas_eve"),
        ((F.month(day) == 1) & (F.dayofmonth(day) == 1)).alias("is_new_year"),
    )


def promotion_attribution(t: Tables, p: Params) -> DataFrame:
    """For every order: how many campaigns ran at its time and which of them to credit.

    A sweep over campaign starts and ends, one row per distinct time of an order, is joined back by equality. It takes dates and
    instants alike, and no campaign is spread over its days. The earliest-started campaign is credited, then the lowest id. The
    recorded campaign is checked against its own window.
    """
    campaigns = t["stg_promotions"]
    at_time = first_open(t["stg_orders"], "order_date", campaigns, "starts_at", "ends_at", "promotion_id")
    windows = campaigns.select("promotion_id", "starts_at", "ends_at")
    inside = F.col("order_date").between(F.col("starts_at"), F.col("ends_at"))
    return (
        t["stg_orders"]
        .select("order_id", "order_date", "promotion_id")
        .join(at_time, "order_date", "left")
        .join(windows, "promotion_id", "left")
        .select(
            "order_id",
            "order_date",
            "promotion_id",
            F.coalesce("n_open", F.lit(0)).cast("bigint").alias("active_campaigns"),
            F.col("first_open").alias("credited_promotion_id"),
            inside.alias("recorded_in_window"),
        )
    )


def lifecycle_events(t: Tables, p: Params) -> DataFrame:
    """Shipping events implied by an order: four fixed steps and the delivery, if any.

    The event id joins order id and step number, so it needs no global counter.
    """
    placed = F.col("order_date").cast("timestamp_ntz")

    def step(seq: int, name: str, at: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event_type"), at.alias("event_at"))

    steps = [
        step(n, name, placed + F.make_dt_interval(F.lit(0), F.lit(hours)))
        for n, (name, hours) in enumerate(LIFECYCLE_HOURS.items())
    ]
    steps.append(step(len(steps), "delivered", F.col("delivered_date").cast("timestamp_ntz")))
    return (
        t["stg_orders"]
        .where(F.col("status").isin("shipped", "delivered", "returned") & F.col("ship_date").isNotNull())
        .select("order_id", "carrier_id", F.inline(F.array(*steps)))
        .where(F.col("event_at").isNotNull())
        .select(
            F.concat_ws("-", "order_id", "seq").alias("event_id"),
            "order_id",
            "carrier_id",
            "event_type",
            "event_at",
        )
    )


def is_aggressive(kind: str | Column, value: str | Column) -> Column:
    """Buy-one-get-one, or a percentage of thirty and more."""
    return (col(kind) == "bogo") | ((col(kind) == "percentage") & (col(value) >= 30))


def aggressive_rule(t: Tables, p: Params) -> DataFrame:
    """Campaigns with the flag the rule gives beside the flag they carry."""
    expected = is_aggressive("promotion_type", "discount_value")
    return t["stg_promotions"].select(
        "promotion_id",
        "promotion_type",
        "discount_value",
        "is_aggressive",
        expected.alias("expected_aggressive"),
        F.col("is_aggressive").eqNullSafe(expected).alias("agrees"),
    )


def seasonality_report(t: Tables, p: Params) -> DataFrame:
    """Season shares and yearly growth of the order count, one row per signal and period.

    Everything follows from one aggregate per day, which is then cut different ways.
    """
    per_day = t["fct_orders"].groupBy("order_date").agg(F.count("*").alias("n"))
    day, n = F.col("order_date"), F.col("n")
    md = F.month(day) * 100 + F.dayofmonth(day)

    def part(condition: Column) -> Column:
        return long_sum(F.when(condition, n).otherwise(0))

    whole = per_day.agg(
        F.sum("n").alias("orders"),
        part(md.between(1120, 1231)).alias("q4"),
        part(md.between(1124, 1202)).alias("cyber"),
        part(F.month(day) == 7).alias("july"),
        F.countDistinct(month_of(day)).alias("months"),
        F.countDistinct(F.when(F.month(day) == 7, month_of(day))).alias("julys"),
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("signal"), F.lit("all").alias("period"), v.alias("value"))
                    for s, v in {
                        "q4_share": ratio("q4", "orders"),
                        "cyber_week_share": ratio("cyber", "orders"),
                        "july_vs_average_month": ratio(ratio("july", "julys"), ratio("orders", "months")),
                    }.items()
                ]
            )
        )
    )
    years = per_day.groupBy(F.year(day).alias("y")).agg(F.sum("n").alias("orders"))
    before = F.lag("orders").over(Window.orderBy("y"))
    growth = years.withColumn("prev", before).select(
        F.lit("yoy_order_growth").alias("signal"),
        F.col("y").cast("string").alias("period"),
        ratio(F.col("orders") - F.col("prev"), "prev").alias("value"),
    )
    return whole.unionByName(growth)


def crypto_fraud(t: Tables, p: Params, countries: tuple[str, ...] = FRAUD_COUNTRIES) -> DataFrame:
    """Chargeback rate of crypto payments in watched countries against all others."""
    watched = (F.col("payment_method") == "crypto") & F.col("customer_country_code").isin(*countries)
    return (
        t["fct_orders"]
        .where(F.col("payment_status").isNotNull())
        .groupBy(F.when(watched, "crypto_watched").otherwise("rest").alias("segment"))
        .agg(
            F.count("*").alias("payments"),
            flag_sum(F.col("payment_status") == "chargeback").alias("chargebacks"),
        )
        .withColumn("chargeback_rate", ratio("chargebacks", "payments"))
    )


def rating_mix(t: Tables, p: Params) -> DataFrame:
    """Ratings of returned and kept orders, each as a share of its own group."""
    returned = F.coalesce(F.col("order_status") == "returned", F.lit(False))
    counts = t["fct_reviews"].groupBy(returned.alias("returned"), "rating").agg(F.count("*").alias("reviews"))
    return counts.withColumn("share", ratio("reviews", F.sum("reviews").over(Window.partitionBy("returned"))))


def carrier_reliability(t: Tables, p: Params) -> DataFrame:
    """Promised reliability beside observed misses and late returns, per carrier.

    The two correlations, rounded to six places, are repeated on every row.
    """
    missed = F.round(F.col("sla_miss_rate") * F.col("orders_delivered"))
    carriers = (
        t["sla_by_carrier"]
        .groupBy("carrier_id", "reliability_score")
        .agg(
            long_sum("orders_total").alias("orders_total"),
            long_sum("orders_delivered").alias("orders_delivered"),
            long_sum(missed).alias("_missed"),
            long_sum("late_returns").alias("late_returns"),
        )
        .select(
            "carrier_id",
            F.col("reliability_score").cast("double").alias("reliability_score"),
            "orders_total",
            "orders_delivered",
            ratio("_missed", "orders_delivered").alias("sla_miss_rate"),
            ratio("late_returns", "orders_total").alias("late_return_rate"),
        )
    )
    links = carriers.agg(
        F.round(F.corr("reliability_score", "sla_miss_rate"), 6).alias("miss"),
        F.round(F.corr("reliability_score", "late_return_rate"), 6).alias("late"),
    )
    return carriers.withColumn("corr_reliability_miss", links.select("miss").scalar()).withColumn(
        "corr_reliability_late", links.select("late").scalar()
    )
