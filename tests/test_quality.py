from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.operators import quality as q
from souk.params import Params
from tests.helpers import frame, plan, values

P = Params()


def test_suite_size():
    kinds = [c.kind for c in q.declared_checks()]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "not_null": 42,
        "unique": 35,
        "accepted_values": 7,
        "relationships": 2,
        "positive_price": 1,
        "payment_matches_order": 1,
        "returned_within_policy": 1,
    }
    assert len({c.name for c in q.declared_checks()}) == 89


@pytest.fixture
def tables(spark):
    return {
        "people": frame(
            spark,
            "id string, kind string, parent_id string",
            ("1", "a", "x"), ("1", "b", "x"), (None, "zz", None), (None, "zz", "y"), ("2", "yy", "gone"), ("3", None, "gone"),
        ),
        "parents": frame(spark, "parent_id string", ("x",), ("y",)),
        "dim_product": frame(
            spark, "product_id string, sku string, unit_price decimal(12,2)",
            ("p", "s", Decimal("0")), ("r", "s", Decimal("-1")), ("q", "s", Decimal("1")), ("n", "s", None),
        ),
    }


def test_failures_per_kind(tables):
    checks = [
        q.Check("not_null", "people", "id"),
        q.Check("unique", "people", "id"),
        q.Check("accepted_values", "people", "kind", values=("a", "b")),
        q.Check("relationships", "people", "parent_id", "warn", parent="parents"),
        q.Check("positive_price", "dim_product", "unit_price", "warn"),
        q.Check("not_null", "parents", "parent_id"),
        q.Check("unique", "parents", "parent_id", "warn"),
    ]
    got = {r["check"]: (r["failures"], r["status"]) for r in q.summarize(tables, checks).collect()}
    assert got == {
        "not_null_people_id": (2, "fail"),
        "unique_people_id": (1, "fail"),
        "accepted_values_people_kind": (2, "fail"),
        "relationships_people_parent_id": (2, "warn"),
        "positive_price_dim_product_unit_price": (2, "warn"),
        "not_null_parents_parent_id": (0, "pass"),
        "unique_parents_parent_id": (0, "pass"),
    }
    for c in checks:
        assert q.failing_rows(tables, c, P).count() == got[c.name][0]


def test_enforce_raises_on_errors_only(tables):
    warn = q.summarize(tables, [q.Check("positive_price", "dim_product", "unit_price", "warn")])
    assert q.enforce(warn) is warn
    with pytest.raises(q.CheckFailed, match=r"unique_people_id \(1\)"):
        q.enforce(q.summarize(tables, [q.Check("unique", "people", "id")]))


def test_business_rules(spark):
    t = {
        "fct_orders": frame(spark, "order_id string, total decimal(12,2)", ("a", Decimal("10")), ("b", Decimal("10"))),
        "stg_payments": frame(
            spark, "order_id string, amount decimal(12,2), status string",
            ("a", Decimal("10.01"), "captured"), ("a", Decimal("10.02"), "refunded"),
            ("b", Decimal("99"), "failed"), ("gone", Decimal("1"), "captured"),
        ),
        "fct_returns": frame(
            spark, "return_id string, order_id string, delivered_date date, return_date date, days_to_return bigint",
            ("r1", "a", None, None, 31), ("r2", "a", None, None, 30), ("r3", "a", None, None, -5), ("r4", "a", None, None, None),
        ),
    }
    assert values(q.payment_matches_order(t), "order_id", "delta") == [("a", Decimal("0.02"))]
    assert values(q.returned_within_policy(t, P), "return_id") == [("r1",)]


@pytest.mark.parametrize("hour, status", [(1, "pass"), (26, "pass"), (27, "warn"), (48, "warn"), (49, "fail")])
def test_freshness(spark, hour, status):
    df = frame(spark, "at timestamp_ntz", (datetime(2024, 1, 1),), (datetime(2023, 1, 1),))
    as_of = F.lit(f"2024-01-0{1 + hour // 24} {hour % 24:02d}:00:00").cast("timestamp_ntz")
    row = q.freshness(df, "at", as_of).first()
    assert (row["age_hours"], row["status"]) == (hour, status)
    assert q.freshness(df.where("false"), "at", as_of).first()["status"] == "fail"


def test_only_keys_are_scanned_whole_and_rows_without_a_finding_are_not_taken_apart(spark, tables, tmp_path):
    tables["people"].write.parquet(f"{tmp_path}/people")
    stored = {"people": spark.read.parquet(f"{tmp_path}/people")}
    kinds = [("not_null", "id", ()), ("not_null", "parent_id", ()), ("accepted_values", "kind", ("a", "b")), ("unique", "id", ())]
    checks = [q.Check(kind, "people", c, values=v) for kind, c, v in kinds]
    assert values(q.summarize(stored, checks), "check", "failures") == [
        ("accepted_values_people_kind", 2), ("not_null_people_id", 2), ("not_null_people_parent_id", 1), ("unique_people_id", 1),
    ]
    assert "IsNull(id)" in plan(q.summarize(stored, checks[:1]))
    assert "Generate" not in plan(q.summarize(stored, checks[3:]))
