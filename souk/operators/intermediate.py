"""Cleaned orders and classified returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import days_between
from souk.operators.staging import Tables
from souk.params import Params

# Which group each return reason belongs to.
REASON_GROUPS = {
    "product_issue": ["defective", "damaged", "wrong_item", "not_as_described", "quality_issue"],
    "fulfillment_issue": ["arrived_late"],
    "fit_issue": ["size_mismatch", "color_different"],
    "customer_driven": ["changed_mind"],
}

def int_orders_clean(t: Tables, p: Params) -> DataFrame:
    """Orders with a readable date, without cancelled orders that never saw a payment.

    An order is one row, however many payments it has. With no payment an order of unknown
    status is dropped, with one it is kept.
    """
    paid = t["stg_payments"].groupBy("order_id").agg(F.lit(True).alias("has_payment"))
    return (
        t["stg_orders"]
        .where(F.col("order_date").isNotNull())
        .join(paid, "order_id", "left")
        .withColumn("has_payment", F.coalesce("has_payment", F.lit(False)))
        .where(~((F.col("status") == "cancelled") & ~F.col("has_payment")))
    )


def int_returns_classified(t: Tables, p: Params) -> DataFrame:
    """Returns with the delay after delivery, a reason group and the policy flag.

    A return dated before delivery has a negative delay and is outside the policy.
    """
    delivered = t["int_orders_clean"].select("order_id", "delivered_date")
    group = F.lit("other")
    for name, reasons in REASON_GROUPS.items():
        group = F.when(F.col("reason").isin(reasons), name).otherwise(group)
    return (
        t["stg_returns"]
        .join(delivered, "order_id", "left")
        .withColumn("days_to_return", days_between("delivered_date", "return_date"))
        .withColumn("reason_category", group)
        .withColumn("is_within_policy", F.col("days_to_return").between(0, p.return_window_days))
    )
