import hashlib
import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from souk.operators import jobs
from souk.operators.sweep import first_open
from souk.params import Params
from souk.plans import payloads
from tests.helpers import frame, plan, values

P = Params()


def test_calendar(spark):
    span = frame(spark, "a date, b date", (date(2022, 1, 1), date(2025, 12, 31)))
    days = jobs.calendar(span, "a", "b")
    assert days.count() == 1461
    assert values(days.where("is_black_friday"), "date_key") == [
        (date(2022, 11, 25),), (date(2023, 11, 24),), (date(2024, 11, 29),), (date(2025, 11, 28),),
    ]
    assert values(days.where("is_cyber_monday"), "date_key", "day_of_week") == [
        (date(2022, 11, 28), "Monday"), (date(2023, 11, 27), "Monday"), (date(2024, 12, 2), "Monday"), (date(2025, 12, 1), "Monday"),
    ]
    assert values(days.where("date_key = '2024-12-24'"), "quarter", "is_christmas_eve", "is_weekend") == [("Q4", True, False)]


def test_attribution_matches_brute_force_without_pairs(spark):
    campaigns = [(f"P{i}", date(2024, 1, 1 + i), date(2024, 1, 1 + i + (i * 3) % 7)) for i in range(12)] + [("bad", date(2024, 2, 2), date(2024, 2, 1))]
    orders = [(f"o{n}", date(2024, 1, 1 + n % 28), f"P{n % 14}" if n % 3 else None) for n in range(80)] + [("undated", None, "P1")]
    t = {
        "stg_promotions": frame(spark, "promotion_id string, starts_at date, ends_at date", *campaigns),
        "stg_orders": frame(spark, "order_id string, order_date date, promotion_id string", *orders),
    }
    expected = {}
    for o, d, p in orders:
        running = [(s, c) for c, s, e in campaigns if d and s <= d <= e]
        window = next(((s, e) for c, s, e in campaigns if c == p), None)
        inside = None if window is None or d is None else window[0] <= d <= window[1]
        expected[o] = (len(running), min(running)[1] if running else None, inside)
    df = jobs.promotion_attribution(t, P)
    assert {r["order_id"]: (r["active_campaigns"], r["credited_promotion_id"], r["recorded_in_window"]) for r in df.collect()} == expected
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_lifecycle(spark):
    schema = "order_id string, carrier_id string, status string, order_date date, ship_date date, delivered_date date"
    day = date(2024, 1, 1)
    t = {
        "stg_orders": frame(
            spark, schema, ("a", "k", "delivered", day, day, date(2024, 1, 4)), ("b", "k", "shipped", day, day, None),
            ("c", "k", "processing", day, None, None),
        )
    }
    got = values(jobs.lifecycle_events(t, P), "event_id", "event_type", "event_at")
    assert len(got) == 9
    assert got[3:5] == [("a-3", "in_transit", datetime(2024, 1, 2)), ("a-4", "delivered", datetime(2024, 1, 4))]


def test_aggressive_rule(spark):
    rows = [("1", "percentage", 29, False), ("2", "percentage", 30, True), ("3", "bogo", 100, True), ("4", "flat_amount", 90, True)]
    t = {"stg_promotions": frame(spark, "promotion_id string, promotion_type string, discount_value int, is_aggressive boolean", *rows)}
    assert values(jobs.aggressive_rule(t, P), "promotion_id", "expected_aggressive", "agrees") == [
        ("1", False, True), ("2", True, True), ("3", True, True), ("4", False, False),
    ]


def test_documents_nest_records_and_keep_nulls(spark):
    mart = frame(
        spark,
        "category string, region string, orders_total bigint, returns_total bigint, return_rate double, gmv_loss_rate double, refund_total decimal(38,2)",
        ("Books", "Europe", 10, 1, 0.1, 1 / 3, Decimal("5.00")), ("Toys", None, 4, 2, 0.5, 0.25, Decimal("1.50")),
    )
    found = payloads.returns_document({"category_region_return_rate": mart})
    text = found.first()["payload"]
    read = json.loads(text)
    assert list(read) == sorted(read)
    assert read["global_avg_return_rate"] == 0.3 and read["global_total_refunds"] == 6.5
    assert [r["category"] for r in read["top_5_offenders"]] == ["Toys", "Books"]
    assert read["top_5_offenders"][0]["region"] is None
    assert read["top_5_offenders"][1] == {
        "category": "Books", "gmv_loss_rate": 0.333333, "orders_total": 10, "refund_total": 5.0, "region": "Europe",
        "return_rate": 0.1, "returns_total": 1,
    }
    assert [r["return_rate"] for r in read["bottom_3_safe_zones"]] == [0.1, 0.5]
    expected = hashlib.sha256(('{"payload":' + text + ',"section":"returns"}').encode()).hexdigest()[:16]
    assert payloads.signature(found).first()["signature"] == expected


def test_documents_of_empty_tables(spark):
    mart = frame(
        spark,
        "category string, region string, orders_total bigint, returns_total bigint, return_rate double, gmv_loss_rate double, refund_total decimal(38,2)",
    )
    read = json.loads(payloads.returns_document({"category_region_return_rate": mart}).first()["payload"])
    assert read == {
        "anomalies_vs_baseline": [], "bottom_3_safe_zones": [], "global_avg_return_rate": None, "global_total_refunds": 0, "top_5_offenders": [],
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_sweep_equals_looking_at_every_interval(spark, seed):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    moment = lambda: base + timedelta(minutes=rng.randint(0, 400))
    intervals = [(f"k{n:02d}", *((a, b) if rng.random() < 0.9 else (b, a))) for n in range(40) for a, b in [sorted((moment(), moment()))]]
    intervals += [("open", None, base), ("same", base, base), ("sama", base, base), ("all", base - timedelta(days=9), base - timedelta(days=8))]
    points = [(moment(),) for _ in range(200)] + [(base,), (None,)] + [(i[1],) for i in intervals if i[1]]
    shorts = frame(spark, "key string, a timestamp_ntz, b timestamp_ntz", *intervals)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["at"]: (r["n_open"], r["first_open"]) for r in first_open(frame(spark, "at timestamp_ntz", *points), "at", shorts, "a", "b", "key").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for (at,) in points:
        if at is not None:
            held = sorted((a, k) for k, a, b in intervals if a is not None and a <= at <= b)
            want[at] = (len(held), held[0][1] if held else None)
    assert got == want
