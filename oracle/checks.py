"""The declared checks and the models, as the expected results know them: stated here, not taken from the code they check."""

from __future__ import annotations

# Fixed values: (table, column) that must be present.
NOT_NULL = [
    ("raw_orders", "order_id"),
    ("raw_payments", "payment_id"),
    ("raw_returns", "return_id"),
    ("raw_reviews", "review_id"),
    ("raw_shipping_events", "event_id"),
    ("raw_customers", "customer_id"),
    ("raw_products", "product_id"),
    ("raw_categories", "category_id"),
    ("raw_categories", "category_name"),
    ("raw_geography", "country_code"),
    ("raw_dates", "date_key"),
    ("raw_carriers", "carrier_id"),
    ("raw_payment_methods", "method_code"),
    ("raw_return_reasons", "reason_code"),
    ("raw_promotions", "promotion_id"),
    ("int_orders_clean", "order_id"),
    ("int_returns_classified", "return_id"),
    ("dim_mkt_customer", "customer_id"),
    ("dim_seller", "seller_id"),
    ("dim_product", "product_id"),
    ("dim_category", "category_id"),
    ("dim_geography", "country_code"),
    ("dim_date", "date_key"),
    ("dim_carrier", "carrier_id"),
    ("dim_payment_method", "method_code"),
    ("dim_return_reason", "reason_code"),
    ("dim_promotion", "promotion_id"),
    ("fct_orders", "order_id"),
    ("fct_payments", "payment_id"),
    ("fct_returns", "return_id"),
    ("fct_reviews", "review_id"),
    ("fct_shipping_events", "event_id"),
    ("gmv_by_promotion", "promotion_id"),
    ("pareto_sellers", "seller_id"),
    ("growth_metrics_monthly", "month"),
    ("raw_sellers", "seller_id"),
    ("int_orders_clean", "order_date"),
    ("dim_category", "category_name"),
    ("fct_orders", "customer_id"),
    ("fct_orders", "order_date"),
    ("category_region_return_rate", "category_id"),
    ("customer_cohort_retention", "cohort_month"),
]

# Fixed values: (table, column) without repeated values.
UNIQUE = [
    ("raw_orders", "order_id"),
    ("raw_payments", "payment_id"),
    ("raw_returns", "return_id"),
    ("raw_reviews", "review_id"),
    ("raw_shipping_events", "event_id"),
    ("raw_customers", "customer_id"),
    ("raw_products", "product_id"),
    ("raw_categories", "category_id"),
    ("raw_categories", "category_name"),
    ("raw_geography", "country_code"),
    ("raw_dates", "date_key"),
    ("raw_carriers", "carrier_id"),
    ("raw_payment_methods", "method_code"),
    ("raw_return_reasons", "reason_code"),
    ("raw_promotions", "promotion_id"),
    ("int_orders_clean", "order_id"),
    ("int_returns_classified", "return_id"),
    ("dim_mkt_customer", "customer_id"),
    ("dim_seller", "seller_id"),
    ("dim_product", "product_id"),
    ("dim_category", "category_id"),
    ("dim_geography", "country_code"),
    ("dim_date", "date_key"),
    ("dim_carrier", "carrier_id"),
    ("dim_payment_method", "method_code"),
    ("dim_return_reason", "reason_code"),
    ("dim_promotion", "promotion_id"),
    ("fct_orders", "order_id"),
    ("fct_payments", "payment_id"),
    ("fct_returns", "return_id"),
    ("fct_reviews", "review_id"),
    ("fct_shipping_events", "event_id"),
    ("gmv_by_promotion", "promotion_id"),
    ("pareto_sellers", "seller_id"),
    ("growth_metrics_monthly", "month"),
]

# The accepted codes of the marketplace, in lower case as staging has them.
STATUSES = ("delivered", "shipped", "processing", "cancelled", "returned")
EVENT_TYPES = ("order_created", "label_printed", "handed_to_carrier", "in_transit", "delivered")
RATINGS = ("1", "2", "3", "4", "5")
CATEGORIES = (
    "Electronics",
    "Fashion",
    "Home & Kitchen",
    "Beauty & Personal Care",
    "Books",
    "Toys & Games",
    "Sports & Outdoors",
    "Automotive Parts",
    "Health & Wellness",
)

# The codes the test tables hold instead.
TEST_STATUSES = ("Delivered", "Shipped", "Processing", "Cancelled", "Returned")
TEST_EVENT_TYPES = ("Order_Created", "label_printed", "handed_to_carrier", "in_transit", "delivered")
TEST_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TEST_CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def accepted(statuses, event_types, regions, categories):
    """(table, column, values) of the columns with a list of accepted values."""
    return [
        ("raw_orders", "status", statuses),
        ("raw_reviews", "rating", RATINGS),
        ("raw_shipping_events", "event_type", event_types),
        ("raw_geography", "region", regions),
        ("dim_mkt_customer", "region", regions),
        ("dim_product", "category", categories),
        ("pareto_sellers", "pareto_bucket", ("A", "B", "C")),
    ]


# Fixed values: (table, column, parent, severity).
RELATIONSHIPS = [
    ("fct_orders", "customer_id", "dim_mkt_customer", "error"),
    ("fct_returns", "order_id", "fct_orders", "warn"),
]

# Fixed values: (kind, table, column) of the business rules, all of which only warn.
RULES = [
    ("positive_price", "dim_product", "unit_price"),
    ("payment_matches_order", "fct_orders", "total"),
    ("returned_within_policy", "fct_returns", "days_to_return"),
]

# The models that are stored, and those that are not.
STORED = [
    "stg_orders",
    "stg_order_items",
    "stg_payments",
    "stg_returns",
    "stg_reviews",
    "stg_shipping_events",
    "stg_mkt_customers",
    "stg_sellers",
    "stg_products",
    "stg_categories",
    "stg_geography",
    "stg_dates",
    "stg_carriers",
    "stg_payment_methods",
    "stg_return_reasons",
    "stg_promotions",
    "int_orders_clean",
    "dim_mkt_customer",
    "dim_seller",
    "dim_product",
    "dim_category",
    "dim_geography",
    "dim_date",
    "dim_carrier",
    "dim_payment_method",
    "dim_return_reason",
    "dim_promotion",
    "fct_orders",
    "fct_order_items",
    "fct_payments",
    "fct_returns",
    "fct_reviews",
    "fct_shipping_events",
    "category_region_return_rate",
    "gmv_by_promotion",
    "sla_by_carrier",
    "customer_cohort_retention",
    "pareto_sellers",
    "growth_metrics_monthly",
    "customer_ltv_by_segment",
]
COMPUTED = ["int_returns_classified", "pipeline_health"]
