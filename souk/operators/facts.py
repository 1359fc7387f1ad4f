"""Six facts built on the cleaned orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import days_between, hours_crossed, ratio, reshuffled
from souk.operators.ordered import keep_first
from souk.operators.staging import Tables
from souk.params import Params
from souk.session import settle


def primary_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Category of the first line of each order that has one, looked up per column.

    Products are brought to one row per id first, so that a repeated id does not multiply lines.
    """
    known = products.groupBy("product_id").agg(F.min("category_id").alias("category_id"), F.min("category").alias("category"))
    lines = items.select("order_id", "line_no", "product_id")
    heads = lines.where(F.col("product_id").isNotNull()).groupBy("order_id").agg(F.min(F.struct("line_no", "product_id")).alias("first"))
    found = heads.select("order_id", F.col("first.product_id").alias("product_id")).join(known, "product_id", "left")
    # The first line tells both columns of most orders; only the lines of the others are all looked up.
    found = settle(found.select("order_id", "category_id", F.col("category").alias("category_primary")), "categories")
    told = F.col("category_id").isNotNull() & F.col("category_primary").isNotNull()
    others = found.where(~told).select(F.col("order_id").alias("_id"))
    if others.isEmpty():
        return found
    lines = lines.join(others, F.col("order_id").eqNullSafe(F.col("_id")), "left_semi")
    return found.where(told).unionByName(_first_named(lines, known))


def _first_named(lines: DataFrame, known: DataFrame) -> DataFrame:
    first = F.struct("line_no", "product_id")
    return (
        lines.join(known, "product_id")
        .groupBy("order_id")
        .agg(
            F.min_by("category_id", F.when(F.col("category_id").isNotNull(), first)).alias("category_id"),
            F.min_by("category", F.when(F.col("category").isNotNull(), first)).alias("category_primary"),
        )
    )


def fct_orders(t: Tables, p: Params, newer_than: date | None = None) -> DataFrame:
    """Order header fact, one row per order. ``newer_than`` keeps only orders after that date.

    Of several payments of an order the one with the smallest payment_id is shown; all of them
    are in ``fct_payments``. A missing payment counts as an amount mismatch. The joins on order_id come first so
    that they share one partitioning of the orders. With a date given, payments and lines
    are first cut down to the orders concerned.
    """
    orders, payments, items = t["int_orders_clean"], t["stg_payments"], t["stg_order_items"]
    if newer_than is not None:
        orders = orders.where(F.col("order_date") > F.lit(newer_than))
        wanted = orders.select("order_id")
        payments = payments.join(wanted, "order_id", "left_semi")
        items = items.join(wanted, "order_id", "left_semi")
    payments = keep_first(payments, ["order_id"], [F.col("payment_id").asc_nulls_last()]).select(
        "order_id",
        F.col("status").alias("payment_status"),
        F.col("amount").alias("payment_amount"),
        F.col("method").alias("payment_method"),
    )
    customers = t["stg_mkt_customers"].select(
        "customer_id", F.col("country").alias("customer_country_code"), "is_prime"
    )
    calendar = t["stg_dates"].select(
        F.col("date_key").alias("order_date"), "is_black_friday", "is_cyber_monday"
    )
    gap = F.abs(F.coalesce("payment_amount", F.lit(0)) - F.col("total"))
    return (
        orders.join(payments, "order_id", "left")
        .join(primary_category(items, t["stg_products"]), "order_id", "left")
        .join(customers, "customer_id", "left")
        .join(calendar, "order_date", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_country_code",
            "ship_country",
            "order_date",
            F.col("status").alias("order_status"),
            "ship_date",
            "delivered_date",
            "items_count",
            "subtotal",
            "shipping_cost",
            "total",
            "carrier_id",
            "promotion_id",
            "category_id",
            "category_primary",
            "payment_status",
            "payment_amount",
            "payment_method",
            (gap > F.lit("0.01").cast("decimal(3,2)")).alias("has_payment_amount_mismatch"),
            days_between("ship_date", "delivered_date").alias("transit_days"),
            F.coalesce("is_black_friday", F.lit(False)).alias("is_black_friday_order"),
            F.coalesce("is_cyber_monday", F.lit(False)).alias("is_cyber_monday_order"),
            "is_prime",
            p.load_time().alias("_loaded_at"),
        )
    )


def fct_order_items(t: Tables, p: Params) -> DataFrame:
    """Order lines of cleaned orders with their product's category."""
    orders = t["int_orders_clean"].select("order_id", "order_date", "ship_country")
    products = t["stg_products"].select("product_id", F.col("category").alias("category_name"), "category_id")
    return (
        t["stg_order_items"]
        .join(orders, "order_id")
        .join(products, "product_id", "left")
        .select(
            "order_id",
            "line_no",
            "product_id",
            "seller_id",
            "category_id",
            "category_name",
            "order_date",
            "ship_country",
            "quantity",
            "unit_price",
            "line_total",
        )
    )


def fct_payments(t: Tables, p: Params) -> DataFrame:
    """Payments with their order; the mismatch flag is NULL when the order is missing."""
    orders = t["int_orders_clean"].select(
        "order_id", F.col("total").alias("order_total"), "customer_id", "ship_country"
    )
    gap = F.abs(F.col("amount") - F.col("order_total"))
    return (
        t["stg_payments"]
        .join(orders, "order_id", "left")
        .select(
            "payment_id",
            "order_id",
            F.col("method").alias("method_code"),
            F.col("status").alias("payment_status"),
            "amount",
            "currency",
            "paid_at",
            "order_total",
            "customer_id",
            "ship_country",
            (gap > F.lit("0.01").cast("decimal(3,2)")).alias("has_amount_mismatch"),
            (F.col("status") == "chargeback").alias("is_chargeback"),
            (F.col("status") == "refunded").alias("is_refunded"),
        )
    )


def fct_returns(t: Tables, p: Params) -> DataFrame:
    """Returns with order attributes; the reason group comes from the reason dimension."""
    orders = t["fct_orders"].select(
        "order_id",
        "customer_country_code",
        "category_id",
        F.col("total").alias("order_total"),
        "payment_method",
        "carrier_id",
    )
    reasons = t["stg_return_reasons"].withColumnRenamed("reason_code", "reason")
    share = F.when(F.col("order_total") > 0, ratio("refund_amount", "order_total"))
    return (
        t["int_returns_classified"]
        .drop("reason_category")
        .join(orders, "order_id", "left")
        .join(reasons, "reason", "left")
        .select(
            "return_id",
            "order_id",
            "customer_country_code",
            "ship_region",
            "category_primary",
            "category_id",
            "return_date",
            "delivered_date",
            "days_to_return",
            "is_within_policy",
            F.col("reason").alias("reason_code"),
            "reason_label",
            "reason_category",
            "is_actionable_by_seller",
            "refund_amount",
            "order_total",
            share.alias("refund_pct"),
            "payment_method",
            "carrier_id",
            "processed",
        )
    )


def fct_reviews(t: Tables, p: Params) -> DataFrame:
    orders = t["int_orders_clean"].select(
        "order_id", F.col("status").alias("order_status"), "ship_country", F.col("total").alias("order_total")
    )
    reviews = t["stg_reviews"]
    return reviews.join(orders, "order_id", "left").select(
        *reviews.columns,
        "order_status",
        "ship_country",
        "order_total",
        (F.col("rating") <= 2).alias("is_negative_review"),
        (F.col("rating") >= 4).alias("is_positive_review"),
    )


def fct_shipping_events(t: Tables, p: Params) -> DataFrame:
    """Shipping events with the hours since the order's first creation event.

    The anchor is an aggregate joined back rather than a window, so an order with very
    many events is combined inside each task and its rows may be split over tasks.
    """
    events = t["stg_shipping_events"]
    anchors = (
        events.where(F.col("event_type") == "order_created")
        .groupBy("order_id")
        .agg(F.min("event_at").alias("_anchor"))
        .select(reshuffled("order_id"), "_anchor")
    )
    return events.join(anchors, "order_id", "left").select(
        "event_id",
        "order_id",
        "carrier_id",
        "event_type",
        "event_at",
        hours_crossed("_anchor", "event_at").alias("hours_since_order"),
    )
