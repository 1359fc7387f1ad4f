"""A hot key holding a third of the rows: results stay whole and the work is split."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from souk.operators import dimensions, facts, jobs
from souk.params import Params
from souk.session import size_shuffles
from tests.helpers import plan

P = Params()
ROWS = 60_000

# Thresholds scaled down so that a test-sized hot key counts as skewed.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(number, spread):
    """A third of the rows share key 0, the others spread evenly."""
    return F.when(number % 3 == 0, 0).otherwise(number % spread)


@pytest.fixture
def tables(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(0, ROWS, numPartitions=4)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int"))
    key = F.concat(F.lit("ORD-"), hot(n, 5000).cast("string"))
    frames = {
        "stg_shipping_events": rows.select(
            F.concat(F.lit("E"), n.cast("string")).alias("event_id"),
            key.alias("order_id"),
            F.lit("K").alias("carrier_id"),
            F.when(n < 6000, "order_created").otherwise("in_transit").alias("event_type"),
            (F.lit("2024-01-01 00:30:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (n % 50).cast("int"))).alias(
                "event_at"
            ),
        ),
        "stg_order_items": rows.select(
            key.alias("order_id"),
            n.cast("int").alias("line_no"),
            F.concat(F.lit("P"), hot(n + 1, 900).cast("string")).alias("product_id"),
            F.lit("S").alias("seller_id"),
            F.lit(1).alias("quantity"),
            *[F.lit("1.00").cast("decimal(12,2)").alias(c) for c in ("unit_price", "line_total")],
        ),
        "int_orders_clean": spark.range(5000).select(
            F.concat(F.lit("ORD-"), n.cast("string")).alias("order_id"), day.alias("order_date"), F.lit("US").alias("ship_country")
        ),
        "stg_products": spark.range(900).select(
            F.concat(F.lit("P"), n.cast("string")).alias("product_id"), F.lit("Books").alias("category"), F.lit("C").alias("category_id")
        ),
        "stg_returns": spark.range(5000).select(F.concat(F.lit("ORD-"), n.cast("string")).alias("order_id")),
        "stg_orders": rows.select(
            F.concat(F.lit("ORD-"), n.cast("string")).alias("order_id"),
            F.when(n % 3 == 0, F.lit("2024-06-01").cast("date")).otherwise(day).alias("order_date"),
            F.when(n % 3 == 0, "P1").alias("promotion_id"),
        ),
        "stg_promotions": spark.range(40).select(
            F.concat(F.lit("P"), n.cast("string")).alias("promotion_id"),
            F.lit("2024-01-01").cast("date").alias("starts_at"),
            day.alias("ends_at"),
        ),
    }
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / name))
    return {name: spark.read.parquet(str(tmp_path / name)) for name in frames}


def test_event_fact(spark, tables):
    with settings(spark, SMALL):
        df = facts.fct_shipping_events(tables, P)
        assert df.where("hours_since_order is not null").count() > 0
        assert df.agg(F.count("*"), F.countDistinct("event_id")).first() == (ROWS, ROWS)
        df.collect()
        assert "skew=true" in plan(df)


def test_item_fact(spark, tables):
    """The lines are hot by order in one join and by product in the next."""
    with settings(spark, SMALL):
        df = facts.fct_order_items(tables, P)
        assert len(df.collect()) == ROWS
        final = plan(df).split("Initial Plan")[0]
        assert final.count("skew=true") == 2


def test_product_dimension(spark, tables):
    with settings(spark, SMALL):
        df = dimensions.dim_product(tables, P)
        # Every order has one return, which counts on each of its lines.
        assert df.agg(F.sum("units_sold"), F.sum("returns_count")).first() == (ROWS, ROWS)
        df.collect()
        assert "skew=true" in plan(df)


def test_attribution(spark, tables):
    with settings(spark, SMALL):
        df = jobs.promotion_attribution(tables, P)
        assert len(df.collect()) == ROWS
        assert "NestedLoop" not in plan(df)
        assert df.where("order_date = '2024-01-02'").first()["active_campaigns"] == 39


def test_shuffle_partitions_follow_file_sizes(spark, tables, tmp_path):
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"}):
        assert size_shuffles(spark, str(tmp_path)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert size_shuffles(spark, str(tmp_path), partition_bytes=1000) > 100
