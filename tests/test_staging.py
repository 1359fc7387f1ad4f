from datetime import date, datetime
from decimal import Decimal

import pytest

from souk.operators import staging as s
from souk.params import Params
from souk.sources.raw import read_raw
from tests.helpers import raw, values

P = Params()


def test_orders(spark):
    t = {
        "raw_orders": raw(
            spark,
            "orders",
            {"order_id": "a", "order_date": "31/01/2024", "status": "Delivered", "ship_country": " br ", "carrier_id": " ",
             "carrier": "", "promotion_id": "P1 ", "items_count": "2", "total": "10.005", "ship_date": ""},
            {"order_id": "b", "order_date": "nonsense", "total": "abc"},
        )
    }
    df = s.stg_orders(t, P)
    assert values(
        df, "order_id", "order_date", "status", "ship_country", "carrier_id", "carrier_name", "promotion_id", "total", "ship_date"
    ) == [
        ("a", date(2024, 1, 31), "delivered", "BR", None, None, "P1", Decimal("10.01"), None),
        ("b", None, None, None, None, None, None, None, None),
    ]


def test_seller_ids_meet_across_tables(spark):
    t = {
        "raw_sellers": raw(spark, "sellers", {"seller_id": "seller_0001", "country": "us", "contact_email": " "}),
        "raw_order_items": raw(spark, "order_items", {"seller_id": " SELLER-0001"}),
        "raw_products": raw(
            spark,
            "products",
            {"product_id": "1", "seller_id": "Seller_0001", "unit_price": "-5", "stock_qty": "x", "category_id": ""},
            {"product_id": "2", "unit_price": "0", "stock_qty": "-1"},
        ),
    }
    ids = {
        r["seller_id"]
        for build in (s.stg_sellers, s.stg_order_items, s.stg_products)
        for r in build(t, P).where("seller_id is not null").collect()
    }
    assert ids == {"SELLER-0001"}
    assert values(s.stg_sellers(t, P), "country", "contact_email") == [("US", None)]
    assert values(s.stg_products(t, P), "product_id", "category_id", "has_negative_price", "has_negative_stock") == [
        ("1", None, True, None),
        ("2", None, False, True),
    ]


@pytest.mark.parametrize(
    "email, cleaned, valid",
    [("a@b.c", "a@b.c", True), (" a@b.c ", "a@b.c", True), ("a.b.c", "a.b.c", False), ("a@b", "a@b", False),
     ("  ", None, False), (None, None, False), (".", ".", False)],
)
def test_customer_email(spark, email, cleaned, valid):
    t = {"raw_customers": raw(spark, "customers", {"customer_id": "1", "email": email})}
    assert values(s.stg_mkt_customers(t, P), "email", "has_valid_email") == [(cleaned, valid)]


def test_instants_and_codes(spark):
    t = {
        "raw_payments": raw(
            spark, "payments", {"method": "PIX", "status": "Captured", "currency": "usd", "paid_at": "2024-01-01 10:59:00"}
        ),
        "raw_shipping_events": raw(spark, "shipping_events", {"event_type": "Delivered", "event_at": "soon"}),
    }
    assert values(s.stg_payments(t, P), "method", "status", "currency", "paid_at") == [
        ("pix", "captured", "USD", datetime(2024, 1, 1, 10, 59))
    ]
    assert values(s.stg_shipping_events(t, P), "event_type", "event_at") == [("delivered", None)]


def test_calendar_flags_are_strict(spark):
    good = {"raw_dates": raw(spark, "dates", {"date_key": "2024-01-01", "year": "2024", "is_weekend": "false"})}
    assert values(s.stg_dates(good, P), "date_key", "year", "is_weekend") == [(date(2024, 1, 1), 2024, False)]
    bad = {"raw_dates": raw(spark, "dates", {"date_key": "2024-01-01", "is_new_year": "perhaps"})}
    with pytest.raises(Exception, match="not a boolean"):
        s.stg_dates(bad, P).collect()


def test_csv_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "reviews.csv").write_text(
        "review_id,order_id,customer_id,rating,title,body,review_date,verified_purchase\n"
        'R1,O1,C1,5,"Said ""wow"", twice",,2024-01-05,true\n'
    )
    df = read_raw(spark, str(tmp_path), "reviews")
    assert {k for _, k in df.dtypes} == {"string"}
    assert values(df, "title", "body") == [('Said "wow", twice', None)]
    assert values(s.stg_reviews({"raw_reviews": df}, P), "rating", "review_date", "verified_purchase") == [
        (5, date(2024, 1, 5), True)
    ]


def test_csv_header_has_to_match(spark, tmp_path):
    (tmp_path / "carriers.csv").write_text("carrier_name,carrier_id,origin_country,sla_promised_days,reliability_score\nx,K,US,1,0.5\n")
    with pytest.raises(Exception, match="header"):
        read_raw(spark, str(tmp_path), "carriers").collect()


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    folder = tmp_path / "reviews.csv"
    folder.mkdir()
    header = "review_id,order_id,customer_id,rating,title,body,review_date,verified_purchase\n"
    (folder / "1.csv").write_text(header + 'R1,O1,C1,5,t,"two\nlines",2024-01-05,true\n')
    (folder / "2.csv").write_text(header + "R2,O1,C1,4,t,one,2024-01-05,true\n")
    df = read_raw(spark, str(tmp_path), "reviews", multi_line=True)
    assert values(df, "review_id", "body") == [("R1", "two\nlines"), ("R2", "one")]
