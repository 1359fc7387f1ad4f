"""Data checks: declared column rules, three business rules, severities and freshness."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.staging import Tables
from souk.params import Params

# Accepted codes.
ORDER_STATUSES = ("delivered", "shipped", "processing", "cancelled", "returned")
EVENT_TYPES = ("order_created", "label_printed", "handed_to_carrier", "in_transit", "delivered")
RATINGS = ("1", "2", "3", "4", "5")
REGIONS = ("North America", "LATAM", "Europe", "APAC")
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


@dataclass(frozen=True)
class Check:
    """One rule on one table. ``warn`` records a finding, ``error`` stops dependants."""

    kind: str
    table: str
    column: str
    severity: str = "error"
    values: tuple[str, ...] = ()
    parent: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.table}_{self.column}"


class CheckFailed(Exception):
    """An error-level check found failures."""


# Fixed values: (table, column) of keys, which must be present and unique.
_KEYED = (
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
)

# Fixed values: (table, column) of what must be present but may repeat.
_PRESENT = (
    ("raw_sellers", "seller_id"),
    ("int_orders_clean", "order_date"),
    ("dim_category", "category_name"),
    ("fct_orders", "customer_id"),
    ("fct_orders", "order_date"),
    ("category_region_return_rate", "category_id"),
    ("customer_cohort_retention", "cohort_month"),
)


def declared_checks(
    regions: Sequence[str] = REGIONS,
    categories: Sequence[str] = CATEGORIES,
    statuses: Sequence[str] = ORDER_STATUSES,
    event_types: Sequence[str] = EVENT_TYPES,
) -> list[Check]:
    """The suite; the value lists depend on the data at hand."""
    checks = [Check("not_null", *c) for c in (*_KEYED, *_PRESENT)]
    checks += [Check("unique", *c) for c in _KEYED]
    checks += [
        Check("accepted_values", *where.split("."), values=tuple(values))
        for where, values in {
            "raw_orders.status": statuses,
            "raw_reviews.rating": RATINGS,
            "raw_shipping_events.event_type": event_types,
            "raw_geography.region": regions,
            "dim_mkt_customer.region": regions,
            "dim_product.category": categories,
            "pareto_sellers.pareto_bucket": ("A", "B", "C"),
        }.items()
    ]
    checks += [
        Check("relationships", "fct_orders", "customer_id", parent="dim_mkt_customer"),
        Check("relationships", "fct_returns", "order_id", "warn", parent="fct_orders"),
        Check("positive_price", "dim_product", "unit_price", "warn"),
        Check("payment_matches_order", "fct_orders", "total", "warn"),
        Check("returned_within_policy", "fct_returns", "days_to_return", "warn"),
    ]
    return checks


# ---- failing rows -----------------------------------------------------------


def positive_price(t: Tables) -> DataFrame:
    """Products priced at zero or below."""
    return t["dim_product"].where(F.col("unit_price") <= 0).select("product_id", "sku", "unit_price")


def payment_matches_order(t: Tables) -> DataFrame:
    """Captured or refunded payments off the order total by more than a cent."""
    payments = (
        t["stg_payments"]
        .where(F.col("status").isin("captured", "refunded"))
        .select("order_id", F.col("amount").alias("payment_amount"), F.col("status").alias("payment_status"))
    )
    orders = t["fct_orders"].select("order_id", F.col("total").alias("order_total"))
    return (
        payments.join(orders, "order_id")
        .withColumn("delta", F.abs(F.col("payment_amount") - F.col("order_total")))
        .where(F.col("delta") > F.lit("0.01").cast("decimal(3,2)"))
        .select("order_id", "order_total", "payment_amount", "payment_status", "delta")
    )


def returned_within_policy(t: Tables, p: Params) -> DataFrame:
    """Returns filed after the policy window; returns before delivery are not counted here."""
    return (
        t["fct_returns"]
        .where(F.col("days_to_return") > p.return_window_days)
        .select("return_id", "order_id", "delivered_date", "return_date", "days_to_return")
    )


def failing_rows(t: Tables, check: Check, p: Params) -> DataFrame:
    """What a check objects to: rows, or for value rules the values themselves."""
    table, value = t[check.table], F.col(check.column)
    if check.kind == "not_null":
        return table.where(value.isNull())
    if check.kind == "unique":
        counts = table.where(value.isNotNull()).groupBy(check.column).agg(F.count("*").alias("rows"))
        return counts.where("rows > 1")
    if check.kind == "accepted_values":
        outside = ~value.cast("string").isin(*check.values)
        return table.where(outside).select(check.column).distinct()
    if check.kind == "relationships":
        keys = t[check.parent].select(check.column)
        return table.where(value.isNotNull()).select(check.column).join(keys, check.column, "left_anti")
    if check.kind == "positive_price":
        return positive_price(t)
    if check.kind == "payment_matches_order":
        return payment_matches_order(t)
    if check.kind == "returned_within_policy":
        return returned_within_policy(t, p)
    raise ValueError(f"unknown check kind {check.kind}")


# ---- summaries --------------------------------------------------------------


def _findings(t: Tables, table: str, checks: list[tuple[int, Check]]) -> list[DataFrame]:
    """(check number, value) rows of the column rules of one table.

    Uniqueness sends every key, each from a scan of that column alone. The other rules send only what they object
    to: they share one scan, whose rows are filtered before any is taken apart, and files without nulls are not read for nulls.
    """
    parts, hits, cells = [], [], []
    for number, c in checks:
        value = F.col(c.column)
        if c.kind == "unique":
            parts.append(t[table].where(value.isNotNull()).select(F.lit(number).alias("no"), value.cast("string").alias("value")))
            continue
        hits.append(value.isNull() if c.kind == "not_null" else ~value.cast("string").isin(*c.values))
        cells.append(F.when(hits[-1], F.struct(F.lit(number).alias("no"), value.cast("string").alias("value"))))
    if hits:
        rows = t[table].where(reduce(Column.__or__, hits))
        parts.append(rows.select(F.explode(F.array_compact(F.array(*cells))).alias("found")).select("found.*"))
    return parts


def summarize(t: Tables, checks: Sequence[Check], p: Params | None = None) -> DataFrame:
    """One row per check with its number of failures and its status.

    All checks share one grouping by check and value, which is combined inside each task
    before anything is shuffled.
    """
    p = p or Params()
    by_table: dict[str, list[tuple[int, Check]]] = defaultdict(list)
    parts = []
    for number, c in enumerate(checks):
        if c.kind in ("not_null", "unique", "accepted_values"):
            by_table[c.table].append((number, c))
        else:
            nothing = F.lit(None).cast("string").alias("value")
            parts.append(failing_rows(t, c, p).select(F.lit(number).alias("no"), nothing))
    for table, group in by_table.items():
        parts += _findings(t, table, group)
    counts = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("no", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("no")
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("values"),
            F.count_if(F.col("n") > 1).alias("repeated"),
        )
    )
    listed = counts.sparkSession.createDataFrame(
        [(at, c.name, c.kind, c.table, c.column, c.severity) for at, c in enumerate(checks)],
        "no int, check string, kind string, table string, column string, severity string",
    )
    measure = F.when(F.col("kind") == "unique", F.col("repeated")).when(
        F.col("kind") == "accepted_values", F.col("values")
    )
    failures = F.coalesce(measure.otherwise(F.col("rows")), F.lit(0)).cast("bigint")
    status = F.when(failures == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return listed.join(counts, "no", "left").select(
        "check", "kind", "table", "column", "severity", failures.alias("failures"), status.alias("status")
    )


def enforce(summary: DataFrame) -> DataFrame:
    """Raise if any error-level check failed; warnings pass through."""
    failed = summary.where("status = 'fail'").select("check", "failures").collect()
    if failed:
        raise CheckFailed(", ".join(f"{r['check']} ({r['failures']})" for r in failed))
    return summary


def _age(newest: DataFrame, as_of: Column, warn_hours: int, error_hours: int) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("newest"), as_of.cast("timestamp_ntz")) / 3600
    status = F.when(F.col("age_hours") > error_hours, "fail").when(F.col("age_hours") > warn_hours, "warn")
    return newest.withColumn("age_hours", age).withColumn(
        "status", F.when(F.col("newest").isNull(), "fail").otherwise(status.otherwise("pass"))
    )


def freshness(df: DataFrame, loaded_at: str, as_of: Column, warn_hours: int = 26, error_hours: int = 48) -> DataFrame:
    """Age of the newest row in hours, with the status it earns; an empty table fails."""
    newest = df.agg(F.max(F.col(loaded_at)).cast("timestamp_ntz").alias("newest"))
    return _age(newest, as_of, warn_hours, error_hours)


def stored_freshness(t: Tables, table: str, loaded_at: str, as_of: Column, warn_hours: int = 26, error_hours: int = 48) -> DataFrame:
    """``freshness`` of a table, without a scan where its greatest value was noted when it was written."""
    known = t.span(table, loaded_at) if hasattr(t, "span") else None
    if known is None:
        return freshness(t[table], loaded_at, as_of, warn_hours, error_hours)
    newest = t[table].sparkSession.range(1).select(F.lit(str(known[1])).cast("timestamp_ntz").alias("newest"))
    return _age(newest, as_of, warn_hours, error_hours)
