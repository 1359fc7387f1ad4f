"""Incremental load of the order fact into a versioned table partitioned by order month.

A run adds the orders that are new, replaces those that have changed and removes those that no longer count. Every row
carries two hidden numbers: a mark of its key and a digest of its values. They tell what is new or
changed without reading anything else, and are read only from parts whose keys overlap those of the run. Usually a run
only adds files; of a changed order the one part that holds it is written anew, all others stay as they are.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import month_of
from souk.operators.facts import fct_orders
from souk.operators.ordered import keep_first
from souk.operators.staging import Tables
from souk.params import Params
from souk.session import settle
from souk.sources.versions import COMMIT, NO_VALUE, Manifest, Part, VersionedTable

MONTH = "order_month"
MARK, DIGEST = "_mark", "_digest"
ZONES = ("order_id", "order_date")


def order_table(spark: SparkSession, path: str, key: str = "order_id") -> VersionedTable:
    return VersionedTable(spark, path, MONTH, (key, *ZONES))


def visible(df: DataFrame) -> DataFrame:
    return df.drop(MARK, DIGEST)


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with columns added by later runs NULL in older rows; None if there is none."""
    table = order_table(spark, path)
    now = table.manifest()
    return visible(table.read(now)) if now else None


def _digest(columns: Sequence[str]) -> Column:
    """A number for the values of a row. NULLs are left out, so a column that is NULL may as well be missing."""
    named = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in sorted(columns)]
    # Two hashes of 64 bits in one decimal: equal for rows of unequal values about once in 10^38 pairs.
    one, two = (F.xxhash64(F.lit(seed), *named).cast("decimal(38,0)") for seed in (1, 2))
    return one * F.lit(1 << 62).cast("decimal(19,0)") + two


def one_per_key(rows: DataFrame, key: str, newest: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in the order ``newest``; remaining ties go by all values."""
    return keep_first(rows, [key], [*newest, *[F.col(c).desc_nulls_last() for c in rows.columns]])


def _overlapping(now: Manifest, key: str, keys: DataFrame) -> list[Part]:
    """Parts whose span of keys meets that of the run."""
    low, high = keys.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
    return [p for p in now.parts if low is not None and p.may_hold(key, low, high)]


def upsert(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    key: str,
    newest: Sequence[Column] = (),
    seen: DataFrame | None = None,
    but: Sequence[str] = ("_loaded_at", MONTH),
    counted: Callable[[int], None] = lambda n: None,
    unique: bool = False,
) -> DataFrame:
    """Add ``rows`` to the table at ``path``, replacing rows of the same key that differ in other columns than ``but``.

    Of several rows of a key in ``rows`` the first in the order ``newest`` counts, ties going by all values. ``seen`` has the keys
    the run looked at: the table's rows of those among them that ``rows`` lacks are removed. Keys are text; rows without one are
    left out. ``counted`` is told the number of rows added or changed. ``unique`` says that no key repeats in ``rows``. Equal runs
    write nothing the second time.
    """
    table = order_table(spark, path, key)
    now = table.manifest()
    values = [c for c in rows.columns if c not in but]
    rows = rows.where(F.col(key).isNotNull())
    rows = rows if unique else one_per_key(rows, key, newest)
    hidden = {MARK: F.xxhash64(key), DIGEST: _digest(values)}
    if now is None:
        now = table.commit(rows, instead_of=(), derived=hidden)
        counted(now.rows())
        return visible(table.read(now))
    rows = settle(rows.withColumns(hidden), "delta")
    keys = rows.select(key, MARK)
    if seen is not None:
        lost = seen.select(key).where(F.col(key).isNotNull()).distinct().join(keys, key, "left_anti")
        lost = settle(lost.withColumn(MARK, F.xxhash64(key)), "lost")
        keys = keys.unionByName(lost)
    held = table.read(now, _overlapping(now, key, keys), with_commit=True).select(COMMIT, MONTH, MARK, DIGEST)
    # One pass over the marks; what it finds is no larger than the run.
    held = settle(held.join(keys.select(MARK).distinct(), MARK, "left_semi"), "held")
    fresh = settle(rows.join(held.select(MARK, DIGEST), [MARK, DIGEST], "left_anti"), "fresh")
    gone = fresh.select(key, MARK)
    if seen is not None:
        gone = gone.unionByName(lost.join(held.select(MARK), MARK, "left_semi"))
    # At most one row per part of the table.
    month = F.coalesce(F.col(MONTH).cast("string"), F.lit(NO_VALUE)).alias(MONTH)
    where = held.join(gone.select(MARK), MARK, "left_semi").select(COMMIT, month).distinct()
    touched = {(r[COMMIT], r[MONTH]) for r in where.collect()}
    over = [p for p in now.parts if (p.commit, p.value) in touched]
    added = fresh.count()
    counted(added)
    if not over and not added:
        return visible(table.read(now))
    out = fresh
    if over:
        out = table.read(now, over).join(gone.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    return visible(table.read(table.commit(out, instead_of=over, base=now)))


def _one_row_each(t: Tables) -> Tables:
    """The tables behind the order fact with the one row of each order, customer and day that ``one_per_key`` would choose in it.

    Chosen before the joins, repeated keys multiply nothing and the fact needs no shuffle by order of its own. The order of the
    columns is that of the fact: the newest order, then the greatest values, its customer's country ahead of the prime flag.
    """

    def greatest(*columns: str | Column) -> list[Column]:
        return [F.desc_nulls_last(c) for c in columns]

    orders = greatest(
        "order_date", "customer_id", "ship_country", "status", "ship_date", "delivered_date", "items_count", "subtotal",
        "shipping_cost", "total", "carrier_id", "promotion_id",
    )
    flags = [F.coalesce(c, F.lit(False)).desc() for c in ("is_black_friday", "is_cyber_monday")]
    return ChainMap(
        {
            "int_orders_clean": keep_first(t["int_orders_clean"].where(F.col("order_id").isNotNull()), ["order_id"], orders),
            "stg_mkt_customers": keep_first(t["stg_mkt_customers"], ["customer_id"], greatest("country", "is_prime")),
            "stg_dates": keep_first(t["stg_dates"], ["date_key"], flags),
        },
        t,
    )


def load_orders(
    t: Tables, p: Params, spark: SparkSession, path: str, counted: Callable[[int], None] = lambda n: None
) -> DataFrame:
    """One run of the order fact: everything at first, afterwards the orders that are new or changed.

    Orders may arrive in any order of dates. An order of ``stg_orders`` that no longer counts, because it was cancelled without
    payment or lost its date, is removed. With ``lookback_days`` only orders dated after the newest loaded
    one, less those days, are looked at, and none is removed.
    """
    now = order_table(spark, path).manifest()
    loaded = now.span("order_date") if now is not None and p.lookback_days is not None else None
    newest = loaded[1] - timedelta(days=p.lookback_days) if loaded else None
    rows = fct_orders(_one_row_each(t), p, newer_than=newest).withColumn(MONTH, month_of("order_date"))
    seen = t["stg_orders"] if p.lookback_days is None and "stg_orders" in t else None
    return upsert(spark, path, rows, "order_id", [F.col("order_date").desc()], seen, counted=counted, unique=True)
