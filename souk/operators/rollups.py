"""Maintained totals of the order fact: one state per part of the table, merged when they are asked for.

The parts of a versioned table never change; a write only adds parts and takes others out. So a total over the table is the merged
total of its parts, and after a write only the new parts are read: the states of those that stayed are at hand, and those of the
parts that went are left out, which takes their rows back out of the total.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import flag_sum, long_sum, money_sum, ratio
from souk.operators.staging import Tables
from souk.sources.versions import COMMIT, Manifest, VersionedTable

PART = ["part_commit", "part_value"]


#: Sums over orders that can be added up.
MEASURES: dict[str, Callable[[], Column]] = {
    "gmv": lambda: money_sum("total"),
    "orders": lambda: F.count("*"),
    "priced": lambda: F.count("total"),
    "units": lambda: long_sum("items_count"),
    "counted": lambda: F.count("items_count"),
    "returned": lambda: flag_sum(F.col("order_status") == "returned"),
    "chargebacks": lambda: flag_sum(F.col("payment_status") == "chargeback"),
    "peak_orders": lambda: flag_sum(F.col("is_black_friday_order") | F.col("is_cyber_monday_order")),
}


def _sums(orders: DataFrame, keys: Sequence[Column | str], measures: Sequence[str]) -> DataFrame:
    return orders.groupBy(*keys).agg(*[MEASURES[m]().alias(m) for m in measures])


def _by_day(orders: DataFrame, keys: Sequence[str], measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    return _sums(orders, [*keys, "order_date"], measures)


def _by_country(orders: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("gmv", "orders")) -> DataFrame:
    return _sums(orders, [*keys, "ship_country"], measures)


def _by_category(orders: DataFrame, keys: Sequence[str], measures: Sequence[str] = ("gmv", "orders", "priced")) -> DataFrame:
    """Delivered and returned orders with a category."""
    kept = orders.where(F.col("order_status").isin("delivered", "returned") & F.col("category_primary").isNotNull())
    return _sums(kept, [*keys, "category_id", F.col("category_primary").alias("category"), "ship_country"], measures)


#: State of some orders: sums per the given keys and the rollup's own.
STATES: dict[str, Callable[..., DataFrame]] = {"day": _by_day, "country": _by_country, "category": _by_category}


def rollup_table(orders: VersionedTable, name: str) -> VersionedTable:
    return VersionedTable(orders.spark, f"{orders.path}/rollups/{name}")


def refresh(orders: VersionedTable, now: Manifest, name: str) -> Manifest:
    """Bring the states of a rollup in line with a version of the orders; reads only parts without a state."""
    table, spark = rollup_table(orders, name), orders.spark
    last = table.manifest()
    live = {(p.commit, p.value): p for p in now.parts}
    states = table.read(last) if last else None
    known = {tuple(r) for r in states.select(*PART).distinct().collect()} if states is not None else set()
    if states is not None and known == set(live):
        return last
    missing = [p for key, p in live.items() if key not in known]
    rows = orders.read(now, missing, with_commit=True)
    value = F.coalesce(F.col(orders.by).cast("string"), F.lit("")).alias(PART[1])
    fresh = STATES[name](rows.withColumnRenamed(COMMIT, PART[0]).withColumn(PART[1], value), PART)
    if states is not None:
        staying = spark.createDataFrame([k for k in live if k in known], "part_commit string, part_value string")
        fresh = fresh.unionByName(states.join(staying, PART, "left_semi"))
    return table.commit(fresh.coalesce(1))


def order_states(t: Tables, name: str, *measures: str) -> DataFrame:
    """Partial sums of the order fact: the maintained ones where the tables keep them, else ``measures`` over the orders."""
    kept = t.rollup(name) if hasattr(t, "rollup") else None
    return kept if kept is not None else STATES[name](t["fct_orders"], [], measures)


def mean_of(total: str, count: str) -> Column:
    """Average over partial sums, as a double from exact sums."""
    return ratio(F.sum(total), F.sum(count))
