from datetime import date, datetime
from decimal import Decimal

from souk.operators import dimensions, facts, intermediate, marts
from souk.operators.marts import customer_cohort_retention, growth_metrics_monthly
from souk.params import Params
from souk.plans import kpis
from souk.plans.warehouse import Warehouse
from tests.helpers import frame, plan, raw, values

P = Params(as_of_date=date(2024, 12, 31), loaded_at=datetime(2024, 12, 31))
D = Decimal

ORDERS = (
    "order_id string, customer_id string, order_date date, status string, ship_date date, delivered_date date, "
    "ship_country string, carrier_id string, carrier_name string, promotion_id string, items_count int, "
    "subtotal decimal(12,2), shipping_cost decimal(12,2), total decimal(12,2)"
)
PAYMENTS = "payment_id string, order_id string, method string, status string, amount decimal(12,2)"


def order(order_id, status="delivered", day=date(2024, 1, 1), customer="c1", total="10", **more):
    row = {
        "order_id": order_id, "customer_id": customer, "order_date": day, "status": status, "ship_date": None,
        "delivered_date": None, "ship_country": "US", "carrier_id": "K1", "carrier_name": None, "promotion_id": None,
        "items_count": 1, "subtotal": D(total), "shipping_cost": D("0"), "total": D(total),
    }
    return tuple((row | more).values())


def test_clean_orders_rules_and_several_payments(spark):
    t = {
        "stg_orders": frame(
            spark,
            ORDERS,
            order("paid"),
            order("unpaid"),
            order("undated", day=None),
            order("cancelled-paid", "cancelled"),
            order("cancelled-unpaid", "cancelled"),
            order("null-paid", None),
            order("null-unpaid", None),
            order("twice"),
        ),
        "stg_payments": frame(
            spark,
            PAYMENTS,
            *[(f"p{n}", o, "pix", "captured", D("10")) for n, o in enumerate(["paid", "cancelled-paid", "null-paid", "twice", "twice"])],
        ),
    }
    assert values(intermediate.int_orders_clean(t, P), "order_id", "has_payment") == [
        ("cancelled-paid", True),
        ("null-paid", True),
        ("paid", True),
        ("twice", True),
        ("unpaid", False),
    ]


def test_returns_policy_edges_and_reasons(spark):
    day = date(2024, 3, 1)
    returns = [("r-1", date(2024, 2, 29)), ("r0", day), ("r30", date(2024, 3, 31)), ("r31", date(2024, 4, 1))]
    reasons = ["defective", "arrived_late", "changed_mind", "size_mismatch"]
    schema = (
        "return_id string, order_id string, return_date date, reason string, refund_amount decimal(12,2), "
        "category_primary string, ship_region string, processed boolean"
    )
    t = {
        "stg_returns": frame(
            spark,
            schema,
            *[(r, "o", d, why, D("1"), "Books", "LATAM", True) for (r, d), why in zip(returns, reasons)],
            ("lost", "missing", day, "strange", D("1"), "Books", "LATAM", True),
        ),
        "int_orders_clean": frame(spark, ORDERS, order("o", delivered_date=day)),
    }
    df = intermediate.int_returns_classified(t, P)
    assert values(df, "return_id", "days_to_return", "is_within_policy", "reason_category") == [
        ("lost", None, None, "other"),
        ("r-1", -1, False, "product_issue"),
        ("r0", 0, True, "fulfillment_issue"),
        ("r30", 30, True, "customer_driven"),
        ("r31", 31, False, "fit_issue"),
    ]
    wide = intermediate.int_returns_classified(t, Params(return_window_days=31))
    assert wide.where("return_id = 'r31'").first()["is_within_policy"] is True


def fact_inputs(spark, orders, payments=(), items=(), products=()):
    t = {
        "stg_orders": frame(spark, ORDERS, *orders),
        "stg_payments": frame(spark, PAYMENTS, *payments),
        "stg_order_items": frame(
            spark,
            "order_id string, line_no int, product_id string, seller_id string, quantity int, "
            "unit_price decimal(12,2), line_total decimal(12,2)",
            *items,
        ),
        "stg_products": frame(spark, "product_id string, category string, category_id string, seller_id string", *products),
        "stg_mkt_customers": frame(
            spark, "customer_id string, country string, is_prime boolean", ("c1", "BR", True)
        ),
        "stg_dates": frame(
            spark,
            "date_key date, is_black_friday boolean, is_cyber_monday boolean",
            (date(2024, 11, 29), True, False),
        ),
    }
    t["int_orders_clean"] = intermediate.int_orders_clean(t, P)
    return t


def test_order_fact(spark):
    t = fact_inputs(
        spark,
        [
            order("a", day=date(2024, 11, 29), ship_date=date(2024, 11, 30), delivered_date=date(2024, 12, 5)),
            order("b", customer="nobody"),
            order("c", total="0"),
        ],
        [("p1", "a", "pix", "captured", D("10.01"))],
        [("a", 1, "plain", "s", 1, D("1"), D("1")), ("a", 2, "book", "s", 1, D("1"), D("1")),
         ("a", 3, "toy", "s", 1, D("1"), D("1")), ("b", 1, "unknown", "s", 1, D("1"), D("1"))],
        [("plain", "Misc", None, "s"), ("book", "Books", "C5", "s"), ("toy", "Toys", "C6", "s")],
    )
    df = facts.fct_orders(t, P)
    assert values(
        df, "order_id", "customer_country_code", "category_id", "category_primary", "has_payment_amount_mismatch",
        "transit_days", "is_black_friday_order", "is_cyber_monday_order",
    ) == [
        ("a", "BR", "C5", "Misc", False, 5, True, False),
        ("b", None, None, None, True, None, False, False),
        ("c", "BR", None, None, False, None, False, False),
    ]
    assert df.first()["_loaded_at"] == datetime(2024, 12, 31)


def test_several_payments_and_returns_of_an_order(spark):
    """k payments are k rows of the payment fact and one order; a return is one row."""
    paid = [(f"p{n}", "a", f"method{n}", "captured", D("10") + n) for n in (4, 2, 3)]
    t = fact_inputs(spark, [order("a"), order("b")], [*paid, ("p9", "b", "pix", "captured", D("10"))])
    assert values(t["int_orders_clean"], "order_id", "has_payment") == [("a", True), ("b", True)]
    assert values(facts.fct_orders(t, P), "order_id", "payment_method") == [("a", "method2"), ("b", "pix")]
    t["stg_payments"] = t["stg_payments"].selectExpr("*", "'USD' as currency", "null as paid_at")
    assert values(facts.fct_payments(t, P), "payment_id", "order_id") == [("p2", "a"), ("p3", "a"), ("p4", "a"), ("p9", "b")]
    t["stg_returns"] = frame(
        spark,
        "return_id string, order_id string, return_date date, reason string, refund_amount decimal(12,2), "
        "category_primary string, ship_region string, processed boolean",
        ("r1", "a", date(2024, 1, 9), "damaged", D("5"), "Books", "EU", True),
        ("r2", "a", date(2024, 1, 9), "damaged", D("5"), "Books", "EU", True),
    )
    t["int_returns_classified"] = intermediate.int_returns_classified(t, P)
    t["fct_orders"] = facts.fct_orders(t, P)
    reasons = "reason_code string, reason_label string, reason_category string, is_actionable_by_seller boolean"
    t["stg_return_reasons"] = frame(spark, reasons, ("damaged", "Damaged", "product_issue", True))
    assert values(facts.fct_returns(t, P), "return_id", "payment_method") == [("r1", "method2"), ("r2", "method2")]


def test_payment_and_review_facts_keep_orphans(spark):
    t = {
        "stg_payments": frame(
            spark,
            PAYMENTS + ", currency string, paid_at timestamp_ntz",
            ("p1", "a", "pix", "chargeback", D("10.02"), "USD", None),
            ("p2", "gone", "pix", None, D("1"), "USD", None),
        ),
        "stg_reviews": frame(spark, "review_id string, order_id string, rating int", ("r1", "gone", 2), ("r2", "a", None)),
        "int_orders_clean": frame(spark, ORDERS, order("a")),
    }
    assert values(facts.fct_payments(t, P), "payment_id", "has_amount_mismatch", "is_chargeback", "is_refunded") == [
        ("p1", True, True, False),
        ("p2", None, None, None),
    ]
    assert values(facts.fct_reviews(t, P), "review_id", "order_status", "is_negative_review", "is_positive_review") == [
        ("r1", None, True, False),
        ("r2", "delivered", None, None),
    ]


def test_event_hours_count_boundaries_from_first_creation(spark):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    t = {
        "stg_shipping_events": frame(
            spark,
            "event_id string, order_id string, carrier_id string, event_type string, event_at timestamp_ntz",
            ("e1", "a", "k", "order_created", at(10, 59)),
            ("e2", "a", "k", "order_created", at(12, 0)),
            ("e3", "a", "k", "in_transit", at(11, 1)),
            ("e4", "b", "k", "in_transit", at(11, 1)),
        )
    }
    assert values(facts.fct_shipping_events(t, P), "event_id", "hours_since_order") == [
        ("e1", 0), ("e2", 2), ("e3", 1), ("e4", None),
    ]


def test_dimension_quirks(spark):
    items = frame(
        spark,
        "order_id string, product_id string, seller_id string, quantity int, line_total decimal(12,2)",
        ("o1", "p1", "s1", 2, D("5")), ("o1", "p1", "s1", 1, D("2")), ("o2", "p2", "s1", 1, D("3")),
    )
    t = {
        "stg_order_items": items,
        "stg_returns": frame(spark, "return_id string, order_id string", ("r1", "o1")),
        "stg_products": frame(spark, "product_id string, category_id string, seller_id string", ("p1", "c1", "s1"), ("p2", None, "s1")),
        "stg_categories": frame(spark, "category_id string, category_name string", ("c1", "Books"), ("c2", "Toys")),
        "stg_sellers": frame(
            spark, "seller_id string, seller_name string, country string, is_verified boolean, join_date date",
            ("s1", "S", "US", True, date(2024, 12, 1)), ("s2", "T", None, True, None),
        ),
        "stg_geography": frame(spark, "country_code string, country_name string, region string, continent string", ("US", "United", "NA", "Am")),
    }
    # A return counts on each line of its order; category "products" are lines.
    assert values(dimensions.dim_product(t, P), "product_id", "units_sold", "returns_count") == [("p1", 3, 2), ("p2", 1, 0)]
    assert values(dimensions.dim_category(t, P), "category_id", "products_count", "gross_sales") == [
        ("c1", 2, D("7.00")), ("c2", 0, D("0.00")),
    ]
    assert values(dimensions.dim_seller(t, P), "seller_id", "region", "tenure_days", "products_count", "orders_count", "gmv") == [
        ("s1", "NA", 30, 2, 2, D("10.00")), ("s2", None, None, 0, 0, D("0.00")),
    ]


def test_carrier_rates_use_different_denominators(spark):
    shipped = dict(ship_date=date(2024, 1, 1))
    orders = [
        order("late", delivered_date=date(2024, 1, 9), **shipped),
        order("ok", delivered_date=date(2024, 1, 2), **shipped),
        order("lost", **shipped),
        order("waiting"),
    ]
    carriers = frame(
        spark,
        "carrier_id string, carrier_name string, origin_country string, sla_promised_days int, reliability_score decimal(3,2)",
        ("K1", "Kay", "US", 3, D("0.9")), ("K2", "Two", "US", 3, D("0.9")),
    )
    t = fact_inputs(spark, orders) | {"stg_carriers": carriers}
    assert values(dimensions.dim_carrier(t, P), "carrier_id", "orders_shipped", "avg_transit_days", "sla_miss_rate") == [
        ("K1", 3, 4.5, 1 / 3), ("K2", 0, None, 0.0),
    ]
    t["fct_orders"] = facts.fct_orders(t, P)
    t["fct_returns"] = frame(spark, "order_id string, reason_code string", ("late", "arrived_late"))
    assert values(marts.sla_by_carrier(t, P), "orders_total", "orders_delivered", "sla_miss_rate", "late_returns", "late_return_rate") == [
        (4, 2, 0.5, 1, 0.25)
    ]


def test_return_mart_mixes_ship_and_customer_country(spark):
    t = {
        "fct_orders": frame(
            spark,
            "order_id string, order_status string, category_id string, category_primary string, ship_country string, total decimal(12,2)",
            ("a", "delivered", "c1", "Books", "US", D("10")),
            ("b", "returned", "c1", "Books", "ZZ", D("30")),
            ("c", "shipped", "c1", "Books", "US", D("99")),
            ("d", "delivered", "c1", None, "US", D("99")),
            ("e", "delivered", None, "Odd", "US", D("5")),
        ),
        "fct_returns": frame(
            spark,
            "category_id string, category_primary string, customer_country_code string, refund_amount decimal(12,2), "
            "is_within_policy boolean, reason_category string",
            ("c1", "Books", "US", D("4"), False, "fit_issue"),
            ("c1", "Books", "BR", D("50"), True, "fit_issue"),
            (None, "Odd", "US", D("5"), None, "product_issue"),
        ),
        "stg_geography": frame(spark, "country_code string, region string", ("US", "North"), ("BR", "LATAM")),
        "stg_categories": frame(
            spark, "category_id string, parent_category string, is_high_return boolean", ("c1", "Media", False)
        ),
    }
    got = marts.category_region_return_rate(t, P)
    assert values(
        got, "category", "region", "orders_total", "returns_total", "refund_total", "return_rate", "gmv_loss_rate",
        "returns_fit_issue", "returns_outside_policy", "parent_category",
    ) == [
        ("Books", "North", 1, 1, D("4.00"), 1.0, 0.4, 1, 1, "Media"),
        ("Books", "Other", 1, 0, D("0.00"), 0.0, 0.0, 0, 0, "Media"),
        ("Odd", "North", 1, 0, D("0.00"), 0.0, 0.0, 0, 0, None),
    ]


def orders_fact(spark, *rows):
    return frame(spark, "order_id string, customer_id string, order_date date, total decimal(12,2), items_count int", *rows)


def test_cohorts(spark):
    rows = [(f"o{n}", c, date(2024, m, 5), D("1"), 1) for n, (c, m) in enumerate([("a", 1), ("a", 1), ("a", 3), ("b", 1), ("c", 3), (None, 1)])]
    got = customer_cohort_retention({"fct_orders": orders_fact(spark, *rows)}, P)
    assert values(got, "cohort_month", "months_since_acquisition", "active_customers", "cohort_size", "retention_pct") == [
        (date(2024, 1, 1), 0, 2, 2, 1.0), (date(2024, 1, 1), 2, 1, 2, 0.5), (date(2024, 3, 1), 0, 1, 1, 1.0),
    ]


def test_growth_lags_step_over_missing_months(spark):
    rows = [("a", "x", date(2024, 1, 1), D("100"), 1), ("b", "x", date(2024, 4, 1), D("150"), 1), ("c", "y", date(2024, 4, 2), D("0"), 1)]
    got = growth_metrics_monthly({"fct_orders": orders_fact(spark, *rows)}, P)
    assert values(got, "month", "gmv", "gmv_prev_month", "mom_growth_pct", "active_customers", "annualized_run_rate") == [
        (date(2024, 1, 1), D("100.00"), None, None, 1, D("1200.00")),
        (date(2024, 4, 1), D("150.00"), D("100.00"), 0.5, 2, D("1800.00")),
    ]


def test_pareto_ties_and_end_at_one(spark):
    sellers = [(f"s{i}", "n", "US", "R", D("25"), 1) for i in range(4)] + [("zero", "n", "US", "R", D("0"), 0)]
    t = {"dim_seller": frame(spark, "seller_id string, seller_name string, country_code string, region string, gmv decimal(38,2), orders_count bigint", *sellers)}
    got = marts.pareto_sellers(t, P)
    assert values(got, "rank", "seller_id", "cumulative_gmv_pct", "pareto_bucket") == [
        (1, "s0", 0.25, "A"), (2, "s1", 0.5, "A"), (3, "s2", 0.75, "B"), (4, "s3", 1.0, "C"),
    ]


def test_promotion_mart_counts_per_order(spark):
    t = {
        "fct_orders": frame(
            spark,
            "order_id string, promotion_id string, total decimal(12,2), is_black_friday_order boolean, is_cyber_monday_order boolean",
            ("a", "P1", D("10"), True, False), ("b", "P1", D("20"), False, False), ("c", None, D("5"), False, True),
        ),
        "fct_payments": frame(
            spark, "order_id string, is_chargeback boolean, is_refunded boolean", ("a", True, False), ("a", False, True), ("b", None, None)
        ),
        "fct_returns": frame(spark, "return_id string, order_id string", ("r1", "a"), ("r2", "a")),
        "stg_promotions": frame(
            spark,
            "promotion_id string, promotion_name string, promotion_type string, discount_value int, is_aggressive boolean",
            ("P1", "One", "bogo", 100, True),
        ),
    }
    got = marts.gmv_by_promotion(t, P)
    assert values(got, "promotion_id", "orders_count", "gmv", "chargeback_rate", "refund_rate", "return_rate", "black_friday_orders") == [
        ("NO_PROMOTION", 1, D("5.00"), 0.0, 0.0, 0.0, 0),
        ("P1", 2, D("30.00"), 1 / 3, 1 / 3, 1.0, 1),
    ]


def test_lifetime_value_buckets(spark):
    schema = "customer_id string, region string, is_prime boolean, tenure_days bigint, orders_count bigint, lifetime_gmv decimal(38,2)"
    people = [("a", "R", True, 89, 1, D("10")), ("b", "R", True, 10, 3, D("20.05")), ("c", "R", True, None, 0, D("0")),
              ("d", None, True, 1, 1, D("9")), ("e", "R", None, 364, 1, D("7"))]
    t = {
        "dim_mkt_customer": frame(spark, schema, *people),
        "fct_orders": frame(spark, "order_id string, customer_id string", ("o", "a")),
        "fct_returns": frame(spark, "order_id string, refund_amount decimal(12,2)", ("o", D("4")), ("o", D("1"))),
    }
    got = marts.customer_ltv_by_segment(t, P)
    assert values(got, "region", "is_prime", "tenure_bucket", "customers", "total_net_ltv", "median_net_ltv") == [
        ("R", None, "3-12mo", 1, D("7.00"), 7.0),
        ("R", True, "2y+", 1, D("0.00"), 0.0),
        ("R", True, "< 3mo", 2, D("25.05"), 12.525),
    ]
    rough = marts.customer_ltv_by_segment(t, Params(approx_median=True))
    assert rough.columns == got.columns


def test_week_windows_are_strict(spark):
    rows = [(str(n), "c", date(2024, 1, n), D(n), 1) for n in (1, 2, 8, 9, 15)]
    t = {"fct_orders": orders_fact(spark, *rows)}
    # Newest day 15: this week is the 9th to 15th, last week the 2nd to 8th.
    assert values(kpis.kpi_with_delta_week(t)) == [(D("24.00"), D("10.00"), 1.4)]
    assert values(kpis.gmv_by_day(t, 7), "order_day") == [(date(2024, 1, 9),), (date(2024, 1, 15),)]


def test_joins_stay_equi(spark):
    t = fact_inputs(spark, [order("a")])
    text = plan(facts.fct_orders(t, P))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_first_lines_meet_the_products_unless_one_tells_too_little(spark):
    products = frame(
        spark, "product_id string, category_id string, category string",
        ("p1", "c1", "Books"), ("p2", "c2", "Toys"), ("p2", "c1", "Toys"), ("half", None, "Half"), ("bare", None, None),
    )
    items = "order_id string, line_no int, product_id string"
    told = frame(spark, items, ("a", 2, "p1"), ("a", 1, "p2"), ("b", 1, None), ("b", 3, "p1"), (None, 1, "p2"), ("a", 1, "p2"))
    found = facts.primary_category(told, products)
    assert values(found) == [(None, "c1", "Toys"), ("a", "c1", "Toys"), ("b", "c1", "Books")]
    assert "Join" not in plan(found)  # settled: one row per order met the products
    some = [("c", 1, "gone"), ("c", 2, "half"), ("c", 3, "p1"), ("d", 1, "gone"), ("e", 1, "bare"), (None, 1, "half"), (None, 2, "p1")]
    found = facts.primary_category(frame(spark, items, ("a", 1, "p1"), *some), products)
    assert values(found) == [(None, "c1", "Half"), ("a", "c1", "Books"), ("c", "c1", "Half"), ("e", None, None)]


def test_orders_of_a_campaign_are_totalled_where_the_joins_left_them(spark):
    orders = "order_id string, promotion_id string, total decimal(12,2), is_black_friday_order boolean, is_cyber_monday_order boolean"
    rows = [("a", "P1", D("10"), True, None), ("a", "P1", None, True, False), (None, "P1", D("4"), None, True), (None, None, None, False, False)]
    t = {
        "fct_orders": frame(spark, orders, *rows),
        "fct_payments": frame(spark, "order_id string, is_chargeback boolean, is_refunded boolean", ("a", True, False), (None, True, True)),
        "fct_returns": frame(spark, "return_id string, order_id string", ("r1", "a"), (None, "a")),
        "stg_promotions": frame(
            spark, "promotion_id string, promotion_name string, promotion_type string, discount_value int, is_aggressive boolean",
            ("P1", "One", "bogo", 100, True),
        ),
    }
    got = marts.gmv_by_promotion(t, P)
    # A repeated order counts its payments and returns twice, but is one order of the return rate; unknown orders are none.
    assert values(got, "promotion_id", "orders_count", "gmv", "avg_order_value", "cyber_monday_orders", "chargeback_rate", "refund_rate", "return_rate") == [
        ("NO_PROMOTION", 1, None, None, 0, 0.0, 0.0, 0.0), ("P1", 3, D("14.00"), 7.0, 1, 1.0, 0.0, 2.0),
    ]
    assert "count(distinct" not in plan(got)


def test_lines_per_product_are_summed_once_for_two_dimensions(spark, tmp_path):
    frames = {
        "order_items": raw(spark, "order_items", *[dict(order_id="o", line_no=str(n), product_id=p, seller_id=s, quantity="2", line_total="3") for n, p, s in ((1, "p", "a"), (2, "p", "a"), (3, None, None))]),
        "products": raw(spark, "products", dict(product_id="p", category_id="C", category="Books"), dict(product_id="q", category_id="C")),
        "categories": raw(spark, "categories", dict(category_id="C"), dict(category_id="D")),
        "returns": raw(spark, "returns"),
        "sellers": raw(spark, "sellers", dict(seller_id="a"), dict(seller_id="b"), dict()),
        "geography": raw(spark, "geography"),
    }
    t = Warehouse(spark, frames.__getitem__, root=str(tmp_path))
    products, categories, sellers = (t.build(n) for n in ("dim_product", "dim_category", "dim_seller"))
    assert values(products, "product_id", "units_sold", "revenue") == [("p", 4, D("6.00")), ("q", 0, D("0.00"))]
    assert values(categories, "category_id", "products_count", "gross_sales") == [("C", 2, D("6.00")), ("D", 0, D("0.00"))]
    assert values(sellers, "seller_id", "orders_count", "gmv") == [(None, 0, D("0.00")), ("A", 1, D("6.00")), ("B", 0, D("0.00"))]
    step = [f for f in products.inputFiles() if "product_sales" in f]
    assert step and set(step) < set(categories.inputFiles())
    # Stored tables and steps are compressed tightly, since they count as data written.
    assert all(f.endswith(".zstd.parquet") for f in [*step, *t["stg_products"].inputFiles()])
