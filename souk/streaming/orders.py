"""Continuous forms of the incremental order load: files dropped in a folder are loaded once."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from souk.operators.intermediate import int_orders_clean
from souk.operators.ordered import keep_first
from souk.operators.upsert import load_orders, read_target, upsert
from souk.params import Params
from souk.plans.warehouse import Warehouse
from souk.session import settle, ship
from souk.sources.raw import CORRUPT, CSV_OPTIONS, raw_schema

#: Where a row came from: when its file was written, which file, and how far into it.
ORIGIN = ("_at", "_file", "_begin")


def _arrivals(spark: SparkSession, inbox: str, name: str) -> DataFrame:
    lines = StructType([*raw_schema(name).fields, StructField(CORRUPT, StringType())])
    reader = spark.readStream.schema(lines).options(**CSV_OPTIONS).option("columnNameOfCorruptRecord", CORRUPT)
    origin = {"_at": "file_modification_time", "_file": "file_path", "_begin": "file_block_start"}
    return reader.csv(inbox).select("*", *[F.col(f"_metadata.{m}").alias(a) for a, m in origin.items()])


def _set_apart(lines: DataFrame, name: str, path: str, batch_id: int) -> DataFrame:
    """The readable rows with an order id; the others are written as they came.

    One folder per batch, so that a replayed batch reports its lines once.
    """
    readable = F.col(CORRUPT).isNull() & F.col("order_id").isNotNull()
    columns = raw_schema(name).names
    line = F.coalesce(CORRUPT, F.to_csv(F.struct(*columns))).alias("line")
    lines.where(~readable).select(line).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return lines.where(readable).drop(CORRUPT)


def _load(session: SparkSession, tables: Callable[[str], DataFrame], params: Params, target: str) -> None:
    """Load the raw orders of a batch; payments and lines are cut down to them before anything is shuffled by order."""
    plans = Warehouse(session, tables, params, stored=False)
    wanted = tables("orders").select("order_id").distinct()
    near = {n: plans[n].join(wanted, "order_id", "left_semi") for n in ("stg_payments", "stg_order_items")}
    all_tables = ChainMap(near, plans)
    near["int_orders_clean"] = int_orders_clean(all_tables, params)
    load_orders(all_tables, params, session, target)


def ingest_orders(
    spark: SparkSession,
    inbox: str,
    raw: Callable[[str], DataFrame],
    target: str,
    checkpoint: str,
    params: Params | None = None,
) -> StreamingQuery:
    """Load new order files from ``inbox`` into the order fact at ``target``, then stop.

    Spark's checkpoint remembers which files were read. Orders are added by their id whatever
    their date, so late, same-day and far-future ones are all loaded, and a batch that is
    replayed after a failure adds nothing twice. Of several rows of an order in the files of a batch the one in the newest
    file counts, within a file the last one. Malformed lines and rows without order id are written beside the target,
    to ``<target>_rejects``. ``raw`` serves the other raw tables.
    """
    params = replace(params or Params(), lookback_days=None)

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        lines = settle(batch.withColumn("_row", F.monotonically_increasing_id()), "arrivals")
        rows = _set_apart(lines, "orders", f"{target}_rejects", batch_id)
        newest = [F.desc(c) for c in (*ORIGIN, "_row")]
        orders = keep_first(rows, ["order_id"], newest).select(*raw_schema("orders").names)
        _load(session, lambda name: orders if name == "orders" else raw(name), params, target)

    return (
        _arrivals(spark, inbox, "orders")
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# ---- orders and payments that arrive apart --------------------------------------------------------

_STATE = "order string, order_origin string, payment string, payment_id string, payment_origin string"
_KNOWN = "order_id string, order string, payment string, reject string"


def _events(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows as text, with an origin that sorts as the rows arrived; within a file part, by the text of the row.

    Rows that cannot be used become rejects, each a group of its own.
    """
    fields = F.struct(*[f for f in rows.columns if f not in (*ORIGIN, CORRUPT)])
    usable = F.col(CORRUPT).isNull() & F.col("order_id").isNotNull()
    row = F.when(usable, F.to_json(fields)).otherwise(F.coalesce(CORRUPT, F.to_csv(fields)))
    origin = F.concat_ws("|", F.date_format("_at", "yyyyMMddHHmmssSSS"), "_file", F.lpad(F.col("_begin").cast("string"), 15, "0"), row)
    return rows.select(
        F.when(usable, F.col("order_id")).otherwise(F.concat(F.lit("reject "), F.sha2(origin, 256))).alias("order_id"),
        F.when(usable, kind).otherwise("reject").alias("kind"),
        F.coalesce(F.col(key), F.lit("")).alias("id"),
        origin.alias("origin"),
        row.alias("row"),
        # The time of the batch: it never runs backwards, so no row is late for the watermark that lets timers run out.
        F.current_timestamp().alias("seen"),
        F.unix_millis(F.current_timestamp()).alias("seen_ms"),
    )


def _tracker(keep_ms: int):
    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The newest row of an order and its payment with the smallest id, handed on whenever one of them changes."""
        if state.hasTimedOut:
            state.remove()
            return
        order, order_origin, payment, payment_id, payment_origin = before = state.get if state.exists else (None,) * 5
        rejects, seen = [], 0
        for rows in batches:
            seen = max(seen, int(rows["seen_ms"].max()))
            for r in rows.itertuples(index=False):
                if r.kind == "reject":
                    rejects.append(r.row)
                elif r.kind == "order" and (order is None or r.origin >= order_origin):
                    order, order_origin = r.row, r.origin
                elif r.kind == "payment" and (payment is None or r.id < payment_id or (r.id == payment_id and r.origin >= payment_origin)):
                    payment, payment_id, payment_origin = r.row, r.id, r.origin
        if rejects:
            yield pd.DataFrame({"order_id": None, "order": None, "payment": None, "reject": rejects})
            return
        state.update((order, order_origin, payment, payment_id, payment_origin))
        state.setTimeoutTimestamp(seen + keep_ms)
        if (order, payment) != (before[0], before[2]):
            yield pd.DataFrame({"order_id": [key[0]], "order": [order], "payment": [payment], "reject": [None]})

    return track


def _paid_late(stored: DataFrame, payments: DataFrame) -> DataFrame:
    """Stored orders without a payment, with the payment that has come for them."""
    paid = payments.select(
        "order_id", F.col("status").alias("_status"), F.col("amount").alias("_amount"), F.col("method").alias("_method")
    )
    gap = F.abs(F.col("_amount") - F.col("total")) > F.lit("0.01").cast("decimal(3,2)")
    rows = stored.where(F.col("payment_status").isNull()).join(paid, "order_id")
    new = {
        "payment_status": F.col("_status"),
        "payment_amount": F.col("_amount"),
        "payment_method": F.col("_method"),
        "has_payment_amount_mismatch": F.coalesce(gap, F.lit(True)),
    }
    return rows.withColumns(new).select(*stored.columns)


def ingest_orders_and_payments(
    spark: SparkSession,
    orders_inbox: str,
    payments_inbox: str,
    raw: Callable[[str], DataFrame],
    target: str,
    checkpoint: str,
    params: Params | None = None,
    keep: timedelta = timedelta(days=120),
) -> StreamingQuery:
    """Load new order files and new payment files into the order fact at ``target``, in whatever order they come, then stop.

    Each order is remembered with its payment for ``keep`` after the last news of it, so a payment in a later file changes the stored
    order, brings back one that was left out as cancelled without payment, and may come before its order. The newest row
    of an order counts, by file time, and of its payments the one with the smallest id. Of an order no longer
    remembered a payment still fills in the stored row if that has none. What says nothing new changes nothing, replays included.
    Malformed lines and rows without order id go to ``<target>_rejects``. ``raw`` serves the other raw tables.
    """
    ship(spark)
    params = replace(params or Params(), lookback_days=None)
    arrivals = {"orders": _arrivals(spark, orders_inbox, "orders"), "payments": _arrivals(spark, payments_inbox, "payments")}
    events = _events(arrivals["orders"], "order", "order_id").unionByName(_events(arrivals["payments"], "payment", "payment_id"))
    # Timers by processing time would keep a stream that is to stop when all is read running for ever.
    known = events.withWatermark("seen", "0 seconds").groupBy("order_id").applyInPandasWithState(
        _tracker(int(keep.total_seconds() * 1000)), _KNOWN, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        news = settle(batch, "news")
        if news.isEmpty():
            return
        rejects = news.where(F.col("reject").isNotNull()).select(F.col("reject").alias("line"))
        rejects.write.mode("overwrite").parquet(f"{target}_rejects/batch={batch_id}")
        rows = {
            n: news.where(F.col(c).isNotNull()).select(F.from_json(c, raw_schema(n)).alias("r")).select("r.*")
            for n, c in (("orders", "order"), ("payments", "payment"))
        }
        _load(session, lambda name: rows[name] if name in rows else raw(name), params, target)
        alone = news.where(F.col("order").isNull() & F.col("payment").isNotNull()).select("order_id")
        plans = Warehouse(session, lambda name: rows[name] if name in rows else raw(name), params, stored=False)
        late = _paid_late(read_target(session, target), plans["stg_payments"].join(alone, "order_id", "left_semi"))
        upsert(session, target, late.withColumn("_loaded_at", params.load_time()), "order_id")

    return (
        known.writeStream.foreachBatch(load)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
