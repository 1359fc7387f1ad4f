"""Data behind the dashboard's charts and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import long_sum, money_sum, ratio
from souk.operators.marts import NO_PROMOTION
from souk.operators.staging import Tables
from souk.plans import kpis

# Tenure buckets in display order.
TENURE_BUCKETS = ["< 3mo", "3-12mo", "1-2y", "2y+"]


def return_rate_matrix(t: Tables, regions: list[str] | None = None) -> DataFrame:
    """Category by region, mean return rate."""
    return (
        t["category_region_return_rate"].groupBy("category").pivot("region", regions).agg(F.avg("return_rate"))
    )


def cohort_matrix(t: Tables, cohorts: int = 12, ages: Sequence[int] | None = None) -> DataFrame:
    """Retention in percent of the latest cohorts, one column per month since acquisition.

    By default there is a column for every age any cohort of the mart has, at most one per month; ``ages`` names others.
    """
    mart = t["customer_cohort_retention"]
    if ages is None:
        ages = sorted(r[0] for r in mart.select("months_since_acquisition").distinct().collect())
    latest = mart.select("cohort_month").distinct().orderBy(F.desc("cohort_month")).limit(cohorts)
    age = F.col("months_since_acquisition")
    cells = [F.avg(F.when(age == a, F.col("retention_pct") * 100)).alias(f"M{a}") for a in ages]
    return mart.join(latest, "cohort_month", "left_semi").groupBy("cohort_month").agg(*cells).orderBy("cohort_month")


def ltv_matrix(t: Tables) -> DataFrame:
    """Region by tenure bucket, mean net lifetime value, zero where a bucket is empty."""
    return (
        t["customer_ltv_by_segment"]
        .groupBy("region")
        .pivot("tenure_bucket", TENURE_BUCKETS)
        .agg(F.avg("avg_net_ltv"))
        .na.fill(0.0)
    )


def carrier_summary(t: Tables) -> DataFrame:
    """Per carrier, plain means over its destinations."""
    return (
        t["sla_by_carrier"]
        .where(F.col("carrier_name").isNotNull())
        .groupBy("carrier_name")
        .agg(
            F.avg("sla_miss_rate").alias("sla_miss_rate"),
            F.avg("late_return_rate").alias("late_return_rate"),
            long_sum("orders_total").alias("orders_total"),
        )
        .orderBy(F.desc_nulls_last("sla_miss_rate"), "carrier_name")
    )


def review_outcomes(t: Tables) -> DataFrame:
    kept = F.col("reviews_count") - F.col("returned_count")
    return kpis.reviews_distribution(t).select("rating", kept.alias("kept"), F.col("returned_count").alias("returned"))


def pareto_head(t: Tables, limit: int = 200) -> DataFrame:
    """The leading sellers of the curve, with the callout figures repeated on each row."""
    mart = t["pareto_sellers"]
    in_a, in_b = F.col("pareto_bucket") == "A", F.col("pareto_bucket") == "B"
    callout = mart.agg(
        F.count_if(in_a).alias("a_sellers"),
        ratio(F.sum(F.when(in_a, F.col("gmv"))), F.sum("gmv")).alias("a_share"),
        F.count_if(in_b).alias("b_sellers"),
    )
    head = mart.orderBy("rank").limit(limit)
    return head.select(
        "rank",
        "seller_id",
        "gmv",
        (F.col("cumulative_gmv_pct") * 100).alias("cumulative_pct"),
        "pareto_bucket",
        *[callout.select(c).scalar().alias(c) for c in ("a_sellers", "a_share", "b_sellers")],
    )


def promo_strip(t: Tables) -> DataFrame:
    """Campaign headline: size, share of orders, chargeback premium of aggressive campaigns."""
    campaigns = (
        t["gmv_by_promotion"]
        .where(F.col("promotion_id") != NO_PROMOTION)
        .agg(
            F.count("*").alias("campaigns"),
            F.coalesce(long_sum("orders_count"), F.lit(0)).alias("_orders"),
            money_sum("gmv").alias("promo_gmv"),
        )
    )
    buckets = kpis.aggressive_vs_baseline(t).agg(
        *[
            F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("weighted_chargeback_rate"))), F.lit(0.0)).alias(n)
            for n, b in (("baseline_chargeback", kpis.BASELINE), ("aggressive_chargeback", kpis.AGGRESSIVE))
        ]
    )
    everything = kpis.kpi_overview(t).select("orders_total").scalar()
    premium = F.col("aggressive_chargeback") - F.col("baseline_chargeback")
    return campaigns.select(
        "campaigns",
        "promo_gmv",
        ratio("_orders", F.greatest(everything, F.lit(1))).alias("share_of_orders"),
        *[buckets.select(c).scalar().alias(c) for c in ("baseline_chargeback", "aggressive_chargeback")],
    ).select(
        "*",
        premium.alias("chargeback_premium"),
        (premium / F.greatest("baseline_chargeback", F.lit(1e-9))).alias("relative_premium"),
    )


def top_refunds(t: Tables, limit: int = 8) -> DataFrame:
    """Category and region pairs with the largest refunds, rates as percent."""
    return (
        t["category_region_return_rate"]
        .orderBy(F.desc("refund_total"), "category", "region")
        .limit(limit)
        .select(
            "category",
            "region",
            "orders_total",
            "returns_total",
            F.round(F.col("return_rate") * 100, 1).alias("return_rate_pct"),
            "refund_total",
            F.round(F.col("gmv_loss_rate") * 100, 1).alias("gmv_loss_pct"),
        )
    )


def top_campaigns(t: Tables, limit: int = 5) -> DataFrame:
    return (
        t["gmv_by_promotion"]
        .where(F.col("promotion_id") != NO_PROMOTION)
        .orderBy(F.desc("gmv"), "promotion_id")
        .limit(limit)
        .select(
            "promotion_name",
            "promotion_type",
            "discount_value",
            "is_aggressive",
            "orders_count",
            "gmv",
            F.round(F.col("chargeback_rate") * 100, 2).alias("chargeback_rate_pct"),
            F.round(F.col("return_rate") * 100, 1).alias("return_rate_pct"),
        )
    )
