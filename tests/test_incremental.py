import glob
import os
from collections import ChainMap
from datetime import date, datetime
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from souk.operators import upsert as u
from souk.params import Params
from souk.sources import files
from souk.sources.versions import ConcurrentWrite, VersionedTable
from souk.streaming.orders import ingest_orders, ingest_orders_and_payments
from tests.helpers import frame, plan, raw, values
from tests.test_models import P, fact_inputs, order


def load(spark, path, orders, params=P, payments=()):
    t = fact_inputs(spark, orders, payments)
    return u.load_orders(t, params, spark, path)


def test_second_run_takes_what_is_new_or_changed(spark, tmp_path):
    path = str(tmp_path / "orders")
    load(spark, path, [order("a", day=date(2024, 1, 5)), order("b", day=date(2024, 2, 10)), order("z", day=date(2099, 1, 1))])
    second = [
        order("a", day=date(2024, 1, 5)),
        order("b", day=date(2024, 2, 10), total="7"),
        order("same-day", day=date(2024, 2, 10)),
        order("late", day=date(2023, 12, 1)),
        order("later", day=date(2024, 3, 1)),
    ]
    want = [("a", "10.00"), ("b", "7.00"), ("late", "10.00"), ("later", "10.00"), ("same-day", "10.00"), ("z", "10.00")]
    for _ in range(2):
        got = load(spark, path, second)
        assert [(o, str(v)) for o, v in values(got, "order_id", "total")] == want


def test_unchanged_orders_are_not_written_again(spark, tmp_path):
    path = str(tmp_path / "orders")
    orders = [order("a", day=date(2024, 1, 5)), order("b", day=date(2024, 2, 10), ship_date=None)]
    load(spark, path, orders)
    before = set(glob.glob(f"{path}/data/*/*/*.parquet"))
    later = Params(as_of_date=P.as_of_date, loaded_at=datetime(2030, 1, 1))
    load(spark, path, orders, later)
    assert set(glob.glob(f"{path}/data/*/*/*.parquet")) == before


def test_strict_run_adds_only_newer_orders(spark, tmp_path):
    path = str(tmp_path / "orders")
    strict = Params(as_of_date=P.as_of_date, loaded_at=P.loaded_at, lookback_days=0)
    first = [order("a", day=date(2024, 1, 5)), order("b", day=date(2024, 2, 10))]
    assert values(load(spark, path, first), "order_id") == [("a",), ("b",)]
    second = [
        *first,
        order("same-day", day=date(2024, 2, 10)),
        order("late-arrival", day=date(2024, 1, 20)),
        order("c", day=date(2024, 2, 11)),
        order("d", day=date(2024, 3, 1)),
    ]
    assert values(load(spark, path, second, strict), "order_id") == [("a",), ("b",), ("c",), ("d",)]
    # Running again changes nothing.
    assert values(load(spark, path, second, strict), "order_id") == [("a",), ("b",), ("c",), ("d",)]


def test_lookback_reopens_days_without_duplicates(spark, tmp_path):
    path = str(tmp_path / "orders")
    load(spark, path, [order("a", day=date(2024, 2, 9), total="1"), order("b", day=date(2024, 2, 10))])
    again = [
        order("a", day=date(2024, 2, 9), total="7"),
        order("b", day=date(2024, 2, 10)),
        order("late", day=date(2024, 2, 8)),
    ]
    params = Params(as_of_date=P.as_of_date, loaded_at=P.loaded_at, lookback_days=5)
    got = load(spark, path, again, params)
    assert values(got, "order_id", "total") == [("a", Decimal("7.00")), ("b", Decimal("10.00")), ("late", Decimal("10.00"))]


def test_order_moved_to_a_later_month_replaces_the_old_row(spark, tmp_path):
    path = str(tmp_path / "orders")
    load(spark, path, [order("a", day=date(2024, 1, 5)), order("x", day=date(2023, 12, 1)), order("b", day=date(2024, 2, 1))])
    untouched = set(glob.glob(f"{path}/data/*/order_month=2023-12-01/*.parquet"))
    got = load(spark, path, [order("a", day=date(2024, 3, 5), total="3")])
    assert values(got, "order_id", "order_date") == [
        ("a", date(2024, 3, 5)),
        ("b", date(2024, 2, 1)),
        ("x", date(2023, 12, 1)),
    ]
    assert untouched == set(glob.glob(f"{path}/data/*/order_month=2023-12-01/*.parquet"))


def test_new_columns_are_null_in_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    month = F.trunc("day", "month").alias("order_month")
    old = frame(spark, "order_id string, day date", ("a", date(2024, 1, 1))).select("*", month)
    new = frame(spark, "order_id string, day date, note string", ("b", date(2024, 2, 1), "n")).select("*", month)
    u.upsert(spark, path, old, "order_id")
    assert values(u.upsert(spark, path, new, "order_id"), "order_id", "note") == [("a", None), ("b", "n")]
    narrow = frame(spark, "order_id string, day date", ("b", date(2024, 2, 2))).select("*", month)
    assert values(u.upsert(spark, path, narrow, "order_id"), "order_id", "day", "note") == [
        ("a", date(2024, 1, 1), None),
        ("b", date(2024, 2, 2), None),
    ]


def test_in_two_runs_equals_in_one(spark, tmp_path):
    orders = [order(str(n), day=date(2024, 1 + n % 6, 1 + n)) for n in range(24)]
    payments = [(f"p{n}", str(n), "pix", "captured", Decimal("10")) for n in range(0, 24, 2)]
    whole = fact_inputs(spark, orders, payments)
    early = whole["int_orders_clean"].where("order_date < '2024-03-15'")
    u.load_orders(ChainMap({"int_orders_clean": early}, whole), P, spark, str(tmp_path / "two"))
    two = u.load_orders(whole, P, spark, str(tmp_path / "two"))
    one = u.load_orders(whole, P, spark, str(tmp_path / "one"))
    assert values(two.select(sorted(two.columns))) == values(one.select(sorted(one.columns)))


def test_stream_loads_each_file_once(spark, tmp_path):
    header = "order_id,customer_id,order_date,status,ship_date,delivered_date,ship_country,carrier_id,carrier,promotion_id,items_count,subtotal,shipping_cost,total\n"
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def others(name):
        rows = {"dates": [{"date_key": "2024-01-01", "is_black_friday": "false", "is_cyber_monday": "false"}]}
        return raw(spark, name, *rows.get(name, [{}]))

    def run():
        q = ingest_orders(
            spark, str(inbox), others, str(tmp_path / "target"), str(tmp_path / "checkpoint"),
            Params(loaded_at=datetime(2024, 1, 1)),
        )
        q.awaitTermination()
        return values(u.read_target(spark, str(tmp_path / "target")), "order_id", "order_date")

    (inbox / "1.csv").write_text(header + "a,c,2024-01-05,shipped,,,US,,,,1,1,0,1\n")
    assert run() == [("a", date(2024, 1, 5))]
    (inbox / "2.csv").write_text(header + "b,c,06/02/2024,shipped,,,US,,,,1,1,0,1\n")
    assert run() == [("a", date(2024, 1, 5)), ("b", date(2024, 2, 6))]
    assert run() == [("a", date(2024, 1, 5)), ("b", date(2024, 2, 6))]
    row = "{},c,{},shipped,,,US,,,,1,1,0,1\n"
    days = {"future": "2099-12-31", "same": "2024-02-06", "earlier": "2024-01-01", "later": "2024-03-01"}
    (inbox / "3.csv").write_text(header + row.format("future", days["future"]))
    run()
    (inbox / "4.csv").write_text(header + "".join(row.format(o, d) for o, d in days.items()))
    want = {"a": date(2024, 1, 5), "b": date(2024, 2, 6)} | {o: date.fromisoformat(d) for o, d in days.items()}
    assert run() == sorted(want.items())


# ---- one row per key, and keys that go ----------------------------------------------------------


def monthly(spark, schema, *rows):
    return frame(spark, schema, *rows).withColumn("order_month", F.trunc("day", "month"))


def test_a_key_repeated_in_one_batch_is_one_row(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = "order_id string, day date, v int"
    u.upsert(spark, path, monthly(spark, kinds, ("O1", date(2024, 4, 1), 1), ("O2", date(2024, 4, 2), 1)), "order_id")
    twice = monthly(spark, kinds, ("O1", date(2024, 5, 1), 3), ("O1", date(2024, 6, 1), 4), ("O3", date(2024, 6, 1), 5), ("O3", date(2024, 6, 1), 5))
    for _ in range(2):
        got = u.upsert(spark, path, twice, "order_id", [F.desc("day")])
        assert values(got, "order_id", "v") == [("O1", 4), ("O2", 1), ("O3", 5)]
    first = monthly(spark, kinds, ("A", date(2024, 5, 1), 3), ("A", date(2024, 6, 1), 4), (None, date(2024, 6, 1), 4))
    assert values(u.upsert(spark, str(tmp_path / "first"), first, "order_id", [F.asc("day")]), "order_id", "v") == [("A", 3)]


def test_an_order_that_no_longer_counts_is_removed(spark, tmp_path):
    path = str(tmp_path / "orders")
    day = date(2024, 1, 5)
    start = fact_inputs(spark, [order("a", day=day), order("b", day=day), order("c", day=date(2024, 2, 1))])
    u.load_orders(start, P, spark, path)
    # b has been cancelled without payment: staging still has it, the clean orders don't. The run says nothing about c.
    now = fact_inputs(spark, [order("a", day=day)])
    now["stg_orders"] = frame(spark, "order_id string", ("a",), ("b",), ("unknown",))
    told = []
    for _ in range(2):
        assert values(u.load_orders(now, P, spark, path, told.append), "order_id") == [("a",), ("c",)]
    assert told == [0, 0]


def test_only_the_part_of_a_changed_order_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    kinds = "order_id string, day date, v int"
    days = [date(2024, m, 3) for m in (1, 2, 3)]
    u.upsert(spark, path, monthly(spark, kinds, *[(f"k{n}", d, n) for n, d in enumerate(days)]), "order_id")
    u.upsert(spark, path, monthly(spark, kinds, ("k1b", days[1], 7)), "order_id")
    table = u.order_table(spark, path)
    before = set(table.manifest().parts)
    got = u.upsert(spark, path, monthly(spark, kinds, ("k1", days[1], 9)), "order_id")
    assert values(got, "order_id", "v") == [("k0", 0), ("k1", 9), ("k1b", 7), ("k2", 2)]
    gone = before - set(table.manifest().parts)
    assert [(p.value, p.rows) for p in gone] == [("2024-02-01", 1)]


def test_new_keys_read_no_part_they_cannot_be_in(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    kinds = "order_id string, day date, v int"
    u.upsert(spark, path, monthly(spark, kinds, *[(f"k{n:04d}", date(2024, 1 + n // 100, 3), n) for n in range(1200)]), "order_id")
    read = []
    plain = VersionedTable.read
    monkeypatch.setattr(VersionedTable, "read", lambda self, m=None, parts=None, **kw: read.append((parts, kw)) or plain(self, m, parts, **kw))

    def rows_read(*rows):
        read.clear()
        u.upsert(spark, path, monthly(spark, kinds, *rows), "order_id")
        return sum(p.rows for parts, kw in read if parts is not None and kw for p in parts)

    # Keys after all others read nothing; one that may be in one month reads the marks of that month.
    assert rows_read(*[(f"k{n}", date(2024, 12, 5), n) for n in range(2000, 2300)]) == 0
    assert rows_read(("k0150x", date(2024, 12, 5), 1)) == 100
    assert u.read_target(spark, path).count() == 1501


def test_marks_alone_are_read_to_find_changes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    kinds = "order_id string, day date, v int, note string"
    rows = monthly(spark, kinds, *[(f"k{n}", date(2024, 1, 3), n, "text") for n in range(50)])
    u.upsert(spark, path, rows, "order_id")
    plans = []
    settle = u.settle
    monkeypatch.setattr(u, "settle", lambda df, label="step": plans.append((label, plan(df))) or settle(df, label))
    u.upsert(spark, path, rows, "order_id")
    held = next(p for label, p in plans if label == "held")
    assert "struct<_mark:bigint,_digest:decimal(38,0)>" in held and "note" not in held


# ---- versions -----------------------------------------------------------------------------------


def numbers(spark, *n):
    return frame(spark, "n int", *[(x,) for x in n])


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), zones=("n",))
    table.commit(numbers(spark, 1, 2))
    # It dies while tasks write, and before the manifest is there.
    with pytest.raises(Exception, match="broken"):
        table.commit(numbers(spark, 3).select(F.raise_error(F.lit("broken")).cast("int").alias("n")))
    with monkeypatch.context() as m:
        m.setattr(files, "create_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            table.commit(numbers(spark, 4))
    assert values(table.read()) == [(1,), (2,)]
    assert len(table.remove_strays()) == 2
    assert values(table.read()) == [(1,), (2,)]
    assert table.manifest().span("n") == ("1", "2")
    table.commit(numbers(spark, 5))
    assert values(table.read()) == [(5,)]


def test_old_versions_are_readable_once_more_and_then_removed(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.commit(numbers(spark, 1))
    first = table.read()
    table.commit(numbers(spark, 2))
    assert values(first) == [(1,)] and values(table.read(table.manifest(1))) == [(1,)]
    table.commit(numbers(spark, 3))
    assert values(table.read()) == [(3,)] and table.manifest(1) is None
    assert len(os.listdir(tmp_path / "t" / "data")) == 2
    assert sorted(n for n in os.listdir(tmp_path / "t" / "versions") if n.endswith(".json")) == ["00000002.json", "00000003.json"]


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    base = table.commit(numbers(spark, 1))
    table.commit(numbers(spark, 2), instead_of=(), base=base)
    with pytest.raises(ConcurrentWrite):
        table.commit(numbers(spark, 3), instead_of=(), base=base)
    # Both looked before either wrote: the manifest of a number can be added once.
    now = table.manifest()
    monkeypatch.setattr(table, "manifest", lambda version=None: base)
    with pytest.raises(ConcurrentWrite):
        table.commit(numbers(spark, 4), instead_of=(), base=base)
    monkeypatch.undo()
    assert values(table.read()) == [(1,), (2,)] and table.manifest() == now


# ---- payments in files of their own ---------------------------------------------------------------


def test_a_late_payment_changes_the_stored_order(spark, tmp_path):
    inbox, paybox, target = tmp_path / "inbox", tmp_path / "paybox", str(tmp_path / "target")
    inbox.mkdir()
    paybox.mkdir()
    head = "order_id,customer_id,order_date,status,ship_date,delivered_date,ship_country,carrier_id,carrier,promotion_id,items_count,subtotal,shipping_cost,total\n"
    pay_head = "payment_id,order_id,method,status,amount,currency,paid_at\n"

    def others(name):
        rows = {"dates": [{"date_key": "2024-01-01", "is_black_friday": "false", "is_cyber_monday": "false"}]}
        return raw(spark, name, *rows.get(name, [{}]))

    def run():
        ingest_orders_and_payments(
            spark, str(inbox), str(paybox), others, target, str(tmp_path / "checkpoint"), Params(loaded_at=datetime(2024, 1, 1))
        ).awaitTermination()
        got = u.read_target(spark, target)
        return values(got, "order_id", "order_status", "payment_status", "payment_amount", "has_payment_amount_mismatch")

    row = "{},c,2024-01-05,{},,,US,,,,1,1,0,10\n"
    (inbox / "1.csv").write_text(head + row.format("a", "shipped") + row.format("b", "cancelled") + row.format("c", "shipped") + "broken\n")
    (paybox / "1.csv").write_text(pay_head + "p7,c,pix,captured,10,usd,\np9,early,pix,captured,10,usd,\n")
    assert run() == [("a", "shipped", None, None, True), ("c", "shipped", "captured", Decimal("10.00"), False)]
    # Payments for a stored order, for one left out as cancelled and unpaid, and an earlier id for c; the order of p9 arrives.
    (paybox / "2.csv").write_text(pay_head + "p1,a,pix,captured,9,usd,\np2,b,pix,refunded,10,usd,\np3,c,pix,chargeback,10,usd,\np8,c,pix,captured,10,usd,\n")
    (inbox / "2.csv").write_text(head + row.format("early", "delivered"))
    want = [
        ("a", "shipped", "captured", Decimal("9.00"), True),
        ("b", "cancelled", "refunded", Decimal("10.00"), False),
        ("c", "shipped", "chargeback", Decimal("10.00"), False),
        ("early", "delivered", "captured", Decimal("10.00"), False),
    ]
    assert run() == want
    before = u.order_table(spark, target).manifest()
    (paybox / "3.csv").write_text((paybox / "2.csv").read_text())
    assert run() == want and u.order_table(spark, target).manifest() == before
    rejects = spark.read.parquet(f"{target}_rejects")
    assert values(rejects, "line") == [("broken",)]


def test_an_order_and_its_correction_in_two_files_of_one_batch(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    head = "order_id,customer_id,order_date,status,ship_date,delivered_date,ship_country,carrier_id,carrier,promotion_id,items_count,subtotal,shipping_cost,total\n"
    row = "{},c,{},shipped,,,US,,,,1,1,0,{}\n"
    (inbox / "z.csv").write_text(head + row.format("a", "2024-06-05", 1) + row.format("b", "2024-01-05", 1) + row.format("b", "2024-01-04", 2) + row.format("", "2024-01-04", 2))
    os.utime(inbox / "z.csv", (1_700_000_000, 1_700_000_000))
    (inbox / "y.csv").write_text(head + row.format("a", "2024-05-05", 3))

    def others(name):
        rows = {"dates": [{"date_key": "2024-01-01", "is_black_friday": "false", "is_cyber_monday": "false"}]}
        return raw(spark, name, *rows.get(name, [{}]))

    target = str(tmp_path / "target")
    ingest_orders(spark, str(inbox), others, target, str(tmp_path / "checkpoint"), Params(loaded_at=datetime(2024, 1, 1))).awaitTermination()
    got = [(o, d, int(v)) for o, d, v in values(u.read_target(spark, target), "order_id", "order_date", "total")]
    assert got == [("a", date(2024, 5, 5), 3), ("b", date(2024, 1, 4), 2)]
    assert spark.read.parquet(f"{target}_rejects").count() == 1


def test_repeated_orders_customers_and_days_do_not_multiply_rows_of_a_run(spark, tmp_path, monkeypatch):
    orders = [
        *[order("a", customer=c, day=date(2024, 11, 29), total=str(n), ship_country=s) for n, (c, s) in enumerate([("c1", "BR"), ("c2", "US"), ("c2", "AR")] * 4)],
        order("a", customer="c3", day=date(2024, 1, 1)),
        order("b", customer="c2", day=None),
        order("c", customer=None, day=date(2024, 3, 1)),
        order("d", customer="c1", day=date(2024, 11, 29), ship_date=None),
        order("d", customer="c1", day=date(2024, 11, 29)),
    ]
    t = dict(fact_inputs(spark, orders, [("p1", "a", "pix", "captured", Decimal("1"))]))
    homes = [("c1", None, True), ("c1", "BR", False), ("c1", "BR", None), ("c2", "AR", True), ("c2", "US", False), ("c2", "US", True), (None, "X", True)]
    t["stg_mkt_customers"] = frame(spark, "customer_id string, country string, is_prime boolean", *homes)
    day = date(2024, 11, 29)
    t["stg_dates"] = frame(spark, "date_key date, is_black_friday boolean, is_cyber_monday boolean", (day, None, True), (day, True, None), (day, True, True), (None, True, True))
    want = u.one_per_key(u.fct_orders(t, P).where("order_id is not null"), "order_id", [F.desc("order_date")])
    entered = []

    def counted(*args, **kwargs):
        rows = real(*args, **kwargs)
        entered.append(rows.count())
        return rows

    real = u.fct_orders
    monkeypatch.setattr(u, "fct_orders", counted)
    got = u.load_orders(t, P, spark, str(tmp_path / "orders"))
    assert entered == [3]
    assert values(got.drop("order_month"), *want.columns) == values(want)


def test_derived_columns_are_added_after_rows_are_dealt_out_to_their_months(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "m", ("n",))
    written = frame(spark, "n int, m string", (1, "a"), (2, "b"), (3, None))
    manifest = table.commit(written, derived={"twice": F.col("n") * 2})
    assert values(table.read(manifest).select("n", "m", "twice")) == [(1, "a", 2), (2, "b", 4), (3, None, 6)]
    assert manifest.rows() == 3 and manifest.span("n") is not None
