"""Ten dimensions, each with the rollups its consumers need.

Facts are aggregated to the dimension key before they meet the dimension, so joins see one
row per key and a hot key costs no more than the partial sums of each task. Spark's own
size-checked rule decides which of these joins broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import (
    MONEY,
    days_between,
    flag_sum,
    long_sum,
    money_sum,
    ratio,
    reshuffled,
    zero_if_null,
)
from souk.operators.staging import Tables
from souk.params import Params


def dim_mkt_customer(t: Tables, p: Params) -> DataFrame:
    """Customer with geography and order rollup; the rollup covers every staged order."""
    orders = (
        t["stg_orders"]
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders_count"),
            money_sum("total").alias("lifetime_gmv"),
            flag_sum(F.col("status") == "returned").alias("returned_orders_count"),
        )
    )
    places = t["stg_geography"].select(
        F.col("country_code").alias("country"), "country_name", "region", "continent", "currency"
    )
    return (
        t["stg_mkt_customers"]
        .join(places, "country", "left")
        .join(orders, "customer_id", "left")
        .select(
            "customer_id",
            "full_name",
            "email",
            "has_valid_email",
            F.col("country").alias("country_code"),
            "country_name",
            "region",
            "continent",
            "currency",
            "signup_date",
            days_between("signup_date", p.today()).alias("tenure_days"),
            "is_prime",
            zero_if_null("orders_count").alias("orders_count"),
            zero_if_null("lifetime_gmv", MONEY).alias("lifetime_gmv"),
            zero_if_null("returned_orders_count").alias("returned_orders_count"),
        )
    )


def product_sales(t: Tables) -> DataFrame:
    """(product_id, _lines, _units, _sales): order lines per product, which two dimensions read."""
    per_product = (
        t["stg_order_items"]
        .groupBy("product_id")
        .agg(
            F.count("*").alias("_lines"),
            long_sum("quantity").alias("_units"),
            money_sum("line_total").alias("_sales"),
        )
    )
    return t.once("product_sales", per_product) if hasattr(t, "once") else per_product


def dim_seller(t: Tables, p: Params) -> DataFrame:
    """Seller with catalogue and sales; sums do not travel with the pairs of seller and order that are counted."""
    catalogue = t["stg_products"].groupBy("seller_id").agg(F.count("*").alias("products_count"))
    items = t["stg_order_items"]
    sales = items.groupBy("seller_id").agg(money_sum("line_total").alias("gmv"))
    served = items.groupBy("seller_id").agg(F.countDistinct("order_id").alias("orders_count"))
    places = t["stg_geography"].select(
        F.col("country_code").alias("country"), "country_name", "region", "continent"
    )
    return (
        t["stg_sellers"]
        .join(places, "country", "left")
        .join(catalogue, "seller_id", "left")
        .join(sales, "seller_id", "left")
        .join(served, "seller_id", "left")
        .select(
            "seller_id",
            "seller_name",
            F.col("country").alias("country_code"),
            "country_name",
            "region",
            "continent",
            "is_verified",
            "join_date",
            days_between("join_date", p.today()).alias("tenure_days"),
            zero_if_null("products_count").alias("products_count"),
            zero_if_null("orders_count").alias("orders_count"),
            zero_if_null("gmv", MONEY).alias("gmv"),
        )
    )


def dim_product(t: Tables, p: Params) -> DataFrame:
    """Product with sales; a return counts on every line of its order."""
    items = t["stg_order_items"]
    sales = product_sales(t).select("product_id", F.col("_units").alias("units_sold"), F.col("_sales").alias("revenue"))
    per_order = t["stg_returns"].groupBy("order_id").agg(F.count("*").alias("_returns"))
    returned = (
        items.select("order_id", "product_id")
        .join(per_order.select(reshuffled("order_id"), "_returns"), "order_id")
        .groupBy("product_id")
        .agg(long_sum("_returns").alias("returns_count"))
    )
    products = t["stg_products"]
    return (
        products.join(sales, "product_id", "left")
        .join(returned, "product_id", "left")
        .select(
            *products.columns,
            zero_if_null("units_sold").alias("units_sold"),
            zero_if_null("revenue", MONEY).alias("revenue"),
            zero_if_null("returns_count").alias("returns_count"),
        )
    )


def dim_category(t: Tables, p: Params) -> DataFrame:
    """Category with sales; ``products_count`` counts order lines, not products."""
    sales = (
        t["stg_products"]
        .select("product_id", "category_id")
        .where(F.col("category_id").isNotNull())
        .join(product_sales(t), "product_id")
        .groupBy("category_id")
        .agg(
            long_sum("_lines").alias("products_count"),
            long_sum("_units").alias("units_sold"),
            money_sum("_sales").alias("gross_sales"),
        )
    )
    categories = t["stg_categories"]
    return categories.join(sales, "category_id", "left").select(
        *categories.columns,
        zero_if_null("products_count").alias("products_count"),
        zero_if_null("units_sold").alias("units_sold"),
        zero_if_null("gross_sales", MONEY).alias("gross_sales"),
    )


def dim_geography(t: Tables, p: Params) -> DataFrame:
    return t["stg_geography"]


def dim_date(t: Tables, p: Params) -> DataFrame:
    peak = F.col("is_black_friday") | F.col("is_cyber_monday")
    return t["stg_dates"].withColumn("is_promo_peak_day", peak)


def dim_carrier(t: Tables, p: Params) -> DataFrame:
    """Carrier with observed transit. Misses are measured against all shipped orders."""
    by_delay = (
        t["stg_orders"]
        .where(F.col("ship_date").isNotNull())
        .groupBy("carrier_id", days_between("ship_date", "delivered_date").alias("_days"))
        .agg(F.count("*").alias("_orders"))
    )
    carriers = t["stg_carriers"]
    late = F.col("_days") > F.col("sla_promised_days")
    delivered = F.when(F.col("_days").isNotNull(), F.col("_orders"))
    observed = (
        by_delay.join(carriers.select("carrier_id", "sla_promised_days"), "carrier_id")
        .groupBy("carrier_id")
        .agg(
            long_sum("_orders").alias("orders_shipped"),
            ratio(F.sum(F.col("_days") * F.col("_orders")), F.sum(delivered)).alias("avg_transit_days"),
            ratio(F.sum(F.when(late, F.col("_orders")).otherwise(0)), F.sum("_orders")).alias("sla_miss_rate"),
        )
    )
    return carriers.join(observed, "carrier_id", "left").select(
        *carriers.columns,
        zero_if_null("orders_shipped").alias("orders_shipped"),
        "avg_transit_days",
        zero_if_null("sla_miss_rate", "double").alias("sla_miss_rate"),
    )


def dim_payment_method(t: Tables, p: Params) -> DataFrame:
    usage = (
        t["stg_payments"]
        .groupBy(F.col("method").alias("method_code"))
        .agg(
            F.count("*").alias("transactions"),
            money_sum("amount").alias("total_processed"),
            ratio(flag_sum(F.col("status") == "chargeback"), F.count("*")).alias("chargeback_rate"),
        )
    )
    methods = t["stg_payment_methods"]
    return methods.join(usage, "method_code", "left").select(
        *methods.columns,
        zero_if_null("transactions").alias("transactions"),
        zero_if_null("total_processed", MONEY).alias("total_processed"),
        zero_if_null("chargeback_rate", "double").alias("chargeback_rate"),
    )


def dim_return_reason(t: Tables, p: Params) -> DataFrame:
    return t["stg_return_reasons"]


def dim_promotion(t: Tables, p: Params) -> DataFrame:
    """Campaign with usage and the chargeback rate over the payments of its orders."""
    payments = (
        t["stg_payments"]
        .groupBy("order_id")
        .agg(F.count("*").alias("_payments"), flag_sum(F.col("status") == "chargeback").alias("_chargebacks"))
    )
    usage = (
        t["stg_orders"]
        .where(F.col("promotion_id").isNotNull())
        .select("order_id", "promotion_id", "total")
        .join(payments, "order_id", "left")
        .groupBy("promotion_id")
        .agg(
            F.count("*").alias("orders_count"),
            money_sum("total").alias("gmv"),
            ratio(F.sum("_chargebacks"), F.sum("_payments")).alias("chargeback_rate"),
        )
    )
    promotions = t["stg_promotions"]
    return promotions.join(usage, "promotion_id", "left").select(
        *promotions.columns,
        zero_if_null("orders_count").alias("orders_count"),
        zero_if_null("gmv", MONEY).alias("gmv"),
        zero_if_null("chargeback_rate", "double").alias("chargeback_rate"),
    )
