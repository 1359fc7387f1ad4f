"""Raw marketplace files: sixteen CSV tables read as text, typed later in staging."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from souk.sources.quoted_csv import read_quoted_csv

# The column layout of the raw files.
RAW_COLUMNS: dict[str, str] = {
    "orders": "order_id customer_id order_date status ship_date delivered_date ship_country "
    "carrier_id carrier promotion_id items_count subtotal shipping_cost total",
    "order_items": "order_id line_no product_id seller_id quantity unit_price line_total",
    "payments": "payment_id order_id method status amount currency paid_at",
    "returns": "return_id order_id return_date reason refund_amount category_primary ship_region processed",
    "reviews": "review_id order_id customer_id rating title body review_date verified_purchase",
    "shipping_events": "event_id order_id carrier_id event_type event_at",
    "customers": "customer_id full_name email country signup_date is_prime",
    "sellers": "seller_id seller_name country is_verified join_date contact_email",
    "products": "product_id sku product_name category category_id seller_id unit_price stock_qty created_at",
    "categories": "category_id category_name parent_category return_window_days is_high_return",
    "geography": "country_code country_name region continent currency language is_eu",
    "dates": "date_key year month day day_of_week quarter is_weekend is_black_friday "
    "is_cyber_monday is_christmas_eve is_new_year",
    "carriers": "carrier_id carrier_name origin_country sla_promised_days reliability_score",
    "payment_methods": "method_code method_name processor_fee_pct settlement_days chargeback_risk",
    "return_reasons": "reason_code reason_label reason_category is_actionable_by_seller",
    "promotions": "promotion_id promotion_name promotion_type discount_value starts_at ends_at is_aggressive",
}


def raw_schema(name: str) -> StructType:
    return StructType([StructField(c, StringType()) for c in RAW_COLUMNS[name].split()])


# A header line that must name the columns in order; quotes inside quoted fields are doubled.
CSV_OPTIONS = {"header": "true", "enforceSchema": "false", "quote": '"', "escape": '"'}


# Tables whose free text may hold line breaks.
MULTI_LINE = ("reviews", "customers", "sellers", "products", "promotions")

#: Holds a line that has another number of fields than its table, or cannot be read at all.
CORRUPT = "_corrupt_record"


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


class CsvSource:
    """The raw tables of a folder of CSV files as text, each from a file or a folder of them.

    ``multi_line`` names the tables whose quoted fields may hold line breaks. Malformed lines are left out of the tables; ``rejects``
    has them whole.
    """

    def __init__(self, spark: SparkSession, folder: str, multi_line: Collection[str] = MULTI_LINE):
        self.spark, self.folder, self.multi_line = spark, folder, multi_line
        self._lines: dict[str, DataFrame] = {}

    def lines(self, name: str) -> DataFrame:
        if name not in self._lines:
            self._lines[name] = self._read(name)
        return self._lines[name]

    def _read(self, name: str) -> DataFrame:
        path, schema = f"{self.folder}/{name}.csv", _with_corrupt(raw_schema(name))
        if name in self.multi_line:
            return read_quoted_csv(self.spark, path, schema, CORRUPT)
        reader = self.spark.read.schema(schema).options(**CSV_OPTIONS)
        return reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)

    def __call__(self, name: str) -> DataFrame:
        return self.lines(name).where(F.col(CORRUPT).isNull()).drop(CORRUPT)

    def rejects(self) -> DataFrame:
        """(table, line): the malformed lines of all raw tables, whole."""
        found = None
        for name in RAW_COLUMNS:
            lines = self.lines(name).where(F.col(CORRUPT).isNotNull())
            # Spark wants a query to ask for more than the malformed line.
            line = F.coalesce(CORRUPT, RAW_COLUMNS[name].split()[0])
            part = lines.select(F.lit(name).alias("table"), line.alias("line"))
            found = part if found is None else found.unionByName(part)
        return found


def read_raw(spark: SparkSession, folder: str, name: str, multi_line: bool | None = None) -> DataFrame:
    """One raw table as text, without malformed lines.

    ``multi_line`` says whether quoted fields may hold line breaks; by default those of the tables
    in ``MULTI_LINE`` may.
    """
    multi_line = name in MULTI_LINE if multi_line is None else multi_line
    return CsvSource(spark, folder, [name] if multi_line else [])(name)


def csv_source(spark: SparkSession, folder: str, multi_line: Collection[str] = MULTI_LINE) -> CsvSource:
    return CsvSource(spark, folder, multi_line)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
