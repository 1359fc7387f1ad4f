"""Staging: one typed, cleaned table per raw source.

Every builder takes a mapping of tables and the build settings. A value that cannot be
read becomes NULL; only the calendar flags are strict.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import (
    blank_to_null,
    seller_key,
    to_day,
    to_decimal,
    to_flag,
    to_flag_strict,
    to_instant,
    to_int,
    to_mixed_day,
    upper_trim,
)
from souk.params import Params

Tables = Mapping[str, DataFrame]


def stg_orders(t: Tables, p: Params) -> DataFrame:
    return t["raw_orders"].select(
        "order_id",
        "customer_id",
        to_mixed_day("order_date").alias("order_date"),
        F.lower("status").alias("status"),
        to_day("ship_date").alias("ship_date"),
        to_day("delivered_date").alias("delivered_date"),
        upper_trim("ship_country").alias("ship_country"),
        blank_to_null("carrier_id").alias("carrier_id"),
        blank_to_null("carrier").alias("carrier_name"),
        blank_to_null("promotion_id").alias("promotion_id"),
        to_int("items_count").alias("items_count"),
        *[to_decimal(c).alias(c) for c in ("subtotal", "shipping_cost", "total")],
    )


def stg_order_items(t: Tables, p: Params) -> DataFrame:
    return t["raw_order_items"].select(
        "order_id",
        to_int("line_no").alias("line_no"),
        "product_id",
        seller_key("seller_id").alias("seller_id"),
        to_int("quantity").alias("quantity"),
        to_decimal("unit_price").alias("unit_price"),
        to_decimal("line_total").alias("line_total"),
    )


def stg_payments(t: Tables, p: Params) -> DataFrame:
    return t["raw_payments"].select(
        "payment_id",
        "order_id",
        F.lower("method").alias("method"),
        F.lower("status").alias("status"),
        to_decimal("amount").alias("amount"),
        F.upper("currency").alias("currency"),
        to_instant("paid_at").alias("paid_at"),
    )


def stg_returns(t: Tables, p: Params) -> DataFrame:
    return t["raw_returns"].select(
        "return_id",
        "order_id",
        to_day("return_date").alias("return_date"),
        F.lower("reason").alias("reason"),
        to_decimal("refund_amount").alias("refund_amount"),
        "category_primary",
        "ship_region",
        to_flag("processed").alias("processed"),
    )


def stg_reviews(t: Tables, p: Params) -> DataFrame:
    return t["raw_reviews"].select(
        "review_id",
        "order_id",
        "customer_id",
        to_int("rating").alias("rating"),
        "title",
        "body",
        to_day("review_date").alias("review_date"),
        to_flag("verified_purchase").alias("verified_purchase"),
    )


def stg_shipping_events(t: Tables, p: Params) -> DataFrame:
    return t["raw_shipping_events"].select(
        "event_id",
        "order_id",
        "carrier_id",
        F.lower("event_type").alias("event_type"),
        to_instant("event_at").alias("event_at"),
    )


def stg_mkt_customers(t: Tables, p: Params) -> DataFrame:
    # The shape test looks at the address as it arrived, padding included.
    shaped = F.col("email").like("%@%.%")
    return t["raw_customers"].select(
        "customer_id",
        "full_name",
        blank_to_null("email").alias("email"),
        F.coalesce(blank_to_null("email").isNotNull() & shaped, F.lit(False)).alias("has_valid_email"),
        upper_trim("country").alias("country"),
        to_day("signup_date").alias("signup_date"),
        to_flag("is_prime").alias("is_prime"),
    )


def stg_sellers(t: Tables, p: Params) -> DataFrame:
    return t["raw_sellers"].select(
        seller_key("seller_id").alias("seller_id"),
        "seller_name",
        upper_trim("country").alias("country"),
        to_flag("is_verified").alias("is_verified"),
        to_day("join_date").alias("join_date"),
        blank_to_null("contact_email").alias("contact_email"),
    )


def stg_products(t: Tables, p: Params) -> DataFrame:
    price, stock = to_decimal("unit_price"), to_int("stock_qty")
    return t["raw_products"].select(
        "product_id",
        "sku",
        "product_name",
        "category",
        blank_to_null("category_id").alias("category_id"),
        seller_key("seller_id").alias("seller_id"),
        price.alias("unit_price"),
        stock.alias("stock_qty"),
        to_day("created_at").alias("created_at"),
        (price < 0).alias("has_negative_price"),
        (stock < 0).alias("has_negative_stock"),
    )


def stg_categories(t: Tables, p: Params) -> DataFrame:
    return t["raw_categories"].select(
        "category_id",
        "category_name",
        "parent_category",
        to_int("return_window_days").alias("return_window_days"),
        to_flag("is_high_return").alias("is_high_return"),
    )


def stg_geography(t: Tables, p: Params) -> DataFrame:
    return t["raw_geography"].select(
        upper_trim("country_code").alias("country_code"),
        "country_name",
        "region",
        "continent",
        F.upper("currency").alias("currency"),
        F.lower("language").alias("language"),
        to_flag("is_eu").alias("is_eu"),
    )


def stg_dates(t: Tables, p: Params) -> DataFrame:
    flags = ("is_weekend", "is_black_friday", "is_cyber_monday", "is_christmas_eve", "is_new_year")
    return t["raw_dates"].select(
        to_day("date_key").alias("date_key"),
        *[to_int(c).alias(c) for c in ("year", "month", "day")],
        "day_of_week",
        "quarter",
        *[to_flag_strict(c).alias(c) for c in flags],
    )


def stg_carriers(t: Tables, p: Params) -> DataFrame:
    return t["raw_carriers"].select(
        "carrier_id",
        "carrier_name",
        F.upper("origin_country").alias("origin_country"),
        to_int("sla_promised_days").alias("sla_promised_days"),
        to_decimal("reliability_score", 3, 2).alias("reliability_score"),
    )


def stg_payment_methods(t: Tables, p: Params) -> DataFrame:
    return t["raw_payment_methods"].select(
        F.lower("method_code").alias("method_code"),
        "method_name",
        to_decimal("processor_fee_pct", 5, 4).alias("processor_fee_pct"),
        to_int("settlement_days").alias("settlement_days"),
        "chargeback_risk",
    )


def stg_return_reasons(t: Tables, p: Params) -> DataFrame:
    return t["raw_return_reasons"].select(
        F.lower("reason_code").alias("reason_code"),
        "reason_label",
        "reason_category",
        to_flag("is_actionable_by_seller").alias("is_actionable_by_seller"),
    )


def stg_promotions(t: Tables, p: Params) -> DataFrame:
    return t["raw_promotions"].select(
        "promotion_id",
        "promotion_name",
        F.lower("promotion_type").alias("promotion_type"),
        to_int("discount_value").alias("discount_value"),
        to_day("starts_at").alias("starts_at"),
        to_day("ends_at").alias("ends_at"),
        to_flag("is_aggressive").alias("is_aggressive"),
    )
