"""Executive summaries: the marts with rates as percentages and rounded money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.staging import Tables


def _percent(name: str, digits: int) -> Column:
    return F.round(F.col(name) * 100, digits)


def _rounded(name: str, digits: int) -> Column:
    return F.round(F.col(name).cast("double"), digits)


def returns_by_category_region(t: Tables) -> DataFrame:
    return (
        t["category_region_return_rate"]
        .select(
            "category",
            "region",
            "orders_total",
            "returns_total",
            _percent("return_rate", 1).alias("return_rate_pct"),
            _rounded("gmv", 0).alias("gmv"),
            _rounded("refund_total", 0).alias("refund_total"),
            _percent("gmv_loss_rate", 1).alias("gmv_loss_pct"),
            "returns_product_issue",
            "returns_fit_issue",
            "returns_customer_driven",
            "returns_outside_policy",
        )
        .orderBy(F.desc("refund_total"), "category", "region")
    )


def promotions_roi(t: Tables) -> DataFrame:
    return (
        t["gmv_by_promotion"]
        .select(
            "promotion_id",
            "promotion_name",
            "promotion_type",
            "discount_value",
            "is_aggressive",
            "orders_count",
            _rounded("gmv", 0).alias("gmv"),
            _rounded("avg_order_value", 2).alias("aov"),
            _percent("chargeback_rate", 2).alias("chargeback_rate_pct"),
            _percent("refund_rate", 2).alias("refund_rate_pct"),
            _percent("return_rate", 2).alias("return_rate_pct"),
            "black_friday_orders",
            "cyber_monday_orders",
        )
        .orderBy(F.desc("gmv"), "promotion_id")
    )


def sla_by_carrier(t: Tables) -> DataFrame:
    return (
        t["sla_by_carrier"]
        .select(
            "carrier_id",
            "carrier_name",
            "ship_country",
            "sla_promised_days",
            "reliability_score",
            "orders_total",
            "orders_delivered",
            "avg_transit_days",
            _percent("sla_miss_rate", 1).alias("sla_miss_pct"),
            "late_returns",
            _percent("late_return_rate", 2).alias("late_return_pct"),
        )
        .orderBy(F.desc_nulls_last("sla_miss_pct"), "carrier_id", "ship_country")
    )
