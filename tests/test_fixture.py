"""The adapter of the test tables writes lines and orders once and nothing that is a mere projection of them."""

import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from souk.session import bound_tasks
from souk.sources.fixture import PROJECTED, FixtureSource
from tests.helpers import frame, plan, values


@pytest.fixture
def folder(spark, tmp_path):
    at = datetime(1995, 3, 4)
    tables = {
        "region": frame(spark, "r_regionkey int, r_name string", (0, "ASIA")),
        "nation": frame(spark, "n_nationkey int, n_name string, n_regionkey int", (3, "X", 0)),
        "customer": frame(spark, "c_custkey bigint, c_name string, c_nationkey int", (1, "c", 3)),
        "part": frame(spark, "p_partkey bigint, p_type string", (5, "PROMO"), (6, "SMALL"), (7, None)),
        "orders": frame(
            spark, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp",
            *[(k, 1, 10.0, at) for k in (0, 8, 17)],
        ),
        "lineitem": frame(
            spark, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
            "l_shipdate timestamp, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
            *[(k, n, p, 1, 2.0, 8.0, at, 0.0, 0.0, "N", "O") for k, n, p in ((0, 2, 5), (0, 1, 6), (8, 1, 7), (8, 1, 5), (8, None, 6), (17, 3, 7))],
        ),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}.parquet")
    return f"{tmp_path}/in"


def test_lines_are_numbered_once_and_the_first_one_places_the_return(spark, folder, tmp_path):
    source, plain = FixtureSource(spark, folder, f"{tmp_path}/out"), FixtureSource(spark, folder)
    for name in ("order_items", "returns", "payments", "reviews", "shipping_events", "orders"):
        assert values(source(name)) == values(plain(name))
    assert values(source("order_items"), "order_id", "line_no", "product_id") == [
        ("ORD-0000000", "1", "PROD-000006"), ("ORD-0000000", "2", "PROD-000005"), ("ORD-0000008", "1", "PROD-000006"),
        ("ORD-0000008", "2", "PROD-000005"), ("ORD-0000008", "3", "PROD-000007"), ("ORD-0000017", "1", "PROD-000007"),
    ]
    assert values(source("returns"), "order_id", "category_primary") == [("ORD-0000000", "SMALL"), ("ORD-0000008", "SMALL"), ("ORD-0000017", None)]
    assert not set(os.listdir(f"{tmp_path}/out/raw")) & set(PROJECTED)
    assert "Exchange" not in plan(source("order_items")) and "Exchange" not in plan(source("payments"))


def test_tasks_grow_with_the_input(spark, tmp_path):
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "f", "wb") as f:
        f.truncate(1 << 30)
    try:
        bound_tasks(spark, str(tmp_path / "in"))
        assert [spark.conf.get(n) for n in names] == ["64", str(32 << 20)]
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_orders_are_not_written_once_more_and_only_what_is_kept_of_a_line_is_shuffled(spark, folder, tmp_path):
    source, plain = FixtureSource(spark, folder, f"{tmp_path}/out"), FixtureSource(spark, folder)
    assert values(source("orders"), "order_id", "items_count", "status") == [
        ("ORD-0000000", "2", "Delivered"), ("ORD-0000008", "3", "Returned"), ("ORD-0000017", "1", "Returned"),
    ]
    assert "Exchange" not in plan(source("orders"))
    assert "l_shipdate" not in plan(plain.lines) and "l_linestatus" not in plan(plain.lines)


def test_a_task_reads_no_more_of_a_shuffle_than_of_a_file(spark, tmp_path):
    name, of_input = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {n: spark.conf.get(n, None) for n in (name, of_input)}
    (tmp_path / "f").write_text("x")
    try:
        for given, expected in (("64MB", str(32 << 20)), ("1MB", "1MB")):
            spark.conf.set(name, given)
            bound_tasks(spark, str(tmp_path))
            assert spark.conf.get(name) == expected
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_the_returns_mart_numbers_lines_by_all_their_columns(spark, folder, tmp_path):
    sql = contract.oracle_sql()["mrt-01"]
    at, later = datetime(1995, 3, 4), datetime(1996, 3, 4)
    lines = [(0, 1, 6, 1, 2.0, 8.0, d, x, 0.0, "N", s) for d, x, s in ((later, 0.1, "F"), (at, 0.0, "O"), (later, 0.0, "O"))]
    lines += [(0, 1, 5, 1, 2.0, 8.0, later, 0.2, 0.0, "R", "F"), (8, 1, 5, 1, 2.0, 8.0, at, 0.0, 0.0, "N", "O"), (17, 2, 6, 1, 2.0, 8.0, at, 0.0, 0.0, "A", "F")]
    read = spark.read.parquet(f"{folder}/lineitem.parquet")
    for order in ("partition by l_orderkey order by ", "from lineitem order by l_orderkey, "):
        assert sql.split(order)[1].replace(")", "\n").split("\n")[0].split(", ") == [c for c in read.columns if c != "l_orderkey"]
    os.mkdir(f"{tmp_path}/tied")
    for name in os.listdir(folder):
        if name not in ("lineitem.parquet", "part.parquet"):
            os.symlink(f"{folder}/{name}", f"{tmp_path}/tied/{name}")
    parts = frame(spark, "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double", (5, "p", "PROMO", 1, 2.0), (6, "q", "SMALL", 1, 2.0))
    parts.write.parquet(f"{tmp_path}/tied/part.parquet")
    frame(spark, read.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), *lines).write.parquet(f"{tmp_path}/tied/lineitem.parquet")
    con = duckdb.connect()
    for name in os.listdir(f"{tmp_path}/tied"):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{tmp_path}/tied/{name}/*.parquet'")
    want = con.sql(sql)
    found = contract.queries()["mrt-01"](spark, f"{tmp_path}/tied")
    assert len(want.fetchall()) == 2 and values(found, *want.columns) == sorted(con.sql(sql).fetchall(), key=lambda r: tuple((v is not None, str(v)) for v in r))
