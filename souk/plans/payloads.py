"""Documents handed to the narrative writer, and the same facts as long tables.

A document is one JSON object per section: totals as numbers, records nested in records and lists, keys sorted and NULLs kept.
``signature`` gives its cache key. A fact sheet is the long form: section, fact, position within the fact, field name, and the
value as a number or as text. Either has a few dozen values whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.columns import money_sum
from souk.operators.marts import NO_PROMOTION
from souk.operators.staging import Tables
from souk.plans import kpis, shaping


def _long(df: DataFrame, fact: str, position: Column | None = None) -> DataFrame:
    """Melt the columns of a small frame into fact rows."""
    cells = []
    for name, kind in df.dtypes:
        if name == "_pos":
            continue
        is_text = kind in ("string", "date", "boolean")
        number = F.lit(None).cast("double") if is_text else F.col(name).cast("double")
        text = F.col(name).cast("string") if is_text else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(name).alias("field"), number.alias("number"), text.alias("text")))
    at = position if position is not None else F.lit(1)
    return df.select(F.lit(fact).alias("fact"), at.cast("bigint").alias("position"), F.inline(F.array(*cells)))


def _ranked(df: DataFrame, fact: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, with their position."""
    top = df.orderBy(*order).limit(limit)
    top = top.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
    return _long(top, fact, F.col("_pos"))


def _sheet(section: str, *parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.lit(section).alias("section"), "fact", "position", "field", "number", "text")


def overview_facts(t: Tables) -> DataFrame:
    """Headline numbers, the last three months and the month with the highest sales."""
    months = kpis.gmv_by_month(t)
    recent = months.orderBy(F.desc("month")).limit(3)
    recent = recent.withColumn("_pos", F.row_number().over(Window.orderBy("month")))
    peak = months.orderBy(F.desc("gmv"), "month").limit(1)
    return _sheet(
        "overview",
        _long(kpis.kpi_overview(t), "kpis"),
        _long(recent, "last_3_months", F.col("_pos")),
        _long(peak, "peak_month"),
    )


def returns_facts(t: Tables) -> DataFrame:
    mart = t["category_region_return_rate"]
    pair = [F.col("category").asc(), F.col("region").asc()]
    totals = mart.agg(
        F.avg("return_rate").alias("global_avg_return_rate"), money_sum("refund_total").alias("global_total_refunds")
    )
    worst = mart.select(
        "category", "region", "orders_total", "returns_total", "return_rate", "gmv_loss_rate", "refund_total"
    )
    best = mart.select("category", "region", "return_rate")
    far = F.desc(F.abs("delta_vs_baseline"))
    return _sheet(
        "returns",
        _long(totals, "totals"),
        _ranked(worst, "top_5_offenders", [F.desc("return_rate"), *pair], 5),
        _ranked(best, "bottom_3_safe_zones", [F.asc("return_rate"), *pair], 3),
        _ranked(kpis.anomalies_summary(t), "anomalies_vs_baseline", [far, *pair], 5),
    )


def _promotion_totals(promos: DataFrame) -> DataFrame:
    flag = F.col("is_aggressive")

    def rate(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, F.col("chargeback_rate"))), F.lit(0.0))

    return promos.agg(
        F.count("*").alias("campaigns_count"),
        F.coalesce(money_sum("gmv"), F.lit(0)).alias("total_promo_gmv"),
        rate(flag).alias("aggressive_campaigns_chargeback_rate"),
        rate(~flag).alias("non_aggressive_chargeback_rate"),
    )


def promotion_facts(t: Tables) -> DataFrame:
    promos = t["gmv_by_promotion"].where(F.col("promotion_id") != NO_PROMOTION)
    totals = _promotion_totals(promos)
    top = promos.orderBy(F.desc("gmv"), "promotion_id").limit(3)
    top = top.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("gmv"), "promotion_id")))
    columns = ["_pos", "promotion_name", "promotion_type", "discount_value", "gmv", "chargeback_rate"]
    return _sheet(
        "promotions", _long(totals, "totals"), _long(top.select(*columns), "top_3_by_gmv", F.col("_pos"))
    )


def sla_facts(t: Tables) -> DataFrame:
    """Three worst and three best carriers; the best ones stay in worst-first order."""
    carriers = shaping.carrier_summary(t)
    order = [F.desc_nulls_last("sla_miss_rate"), F.col("carrier_name").asc()]
    tail = carriers.orderBy(F.asc_nulls_first("sla_miss_rate"), F.desc("carrier_name")).limit(3)
    return _sheet(
        "sla",
        _ranked(carriers, "worst_carriers", order, 3),
        _ranked(tail, "best_carriers", order, 3),
        _long(carriers.agg(F.avg("sla_miss_rate").alias("global_sla_miss_rate")), "totals"),
    )


# ---- documents ------------------------------------------------------------------------------------


def _number(name: str, kind: str) -> Column:
    """Fractions have six decimals, so that the text, and with it the signature, does not depend on summation order."""
    return F.col(name).cast("decimal(38,6)").alias(name) if kind == "double" or kind.startswith("decimal") else F.col(name)


def _record(df: DataFrame, *but: str) -> Column:
    """The columns of a frame as one record with sorted keys."""
    return F.struct(*[_number(n, k) for n, k in sorted(df.dtypes) if n not in but])


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.to_json(_record(df), _WITH_NULLS).alias("json"))


def _many(df: DataFrame, name: str, position: str) -> DataFrame:
    """A list of records in the order of a column that is not part of them."""
    found = df.agg(F.collect_list(F.struct(F.col(position).alias("at"), _record(df, position).alias("r"))).alias("all"))
    records = F.transform(F.array_sort("all"), lambda x: x["r"])
    return found.select(F.lit(name).alias("name"), F.to_json(records, _WITH_NULLS).alias("json"))


def _placed(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit).withColumn("_pos", F.row_number().over(Window.orderBy(*order)))


_WITH_NULLS = {"ignoreNullFields": "false"}


def _document(section: str, *parts: DataFrame) -> DataFrame:
    """(section, payload): one JSON object whose keys are the names of the parts, sorted.

    Parts are small aggregates of one row (name, json) each; a part without rows is an empty object.
    """
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    entry = F.struct("name", F.concat(F.lit('"'), "name", F.lit('":'), "json").alias("text"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"])
    payload = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    return whole.agg(payload.alias("payload")).select(F.lit(section).alias("section"), "payload")


def _scalars(df: DataFrame) -> list[DataFrame]:
    """Each column of a frame of one row as a part of its own."""
    found = []
    for name, kind in df.dtypes:
        value = F.coalesce(_number(name, kind).cast("string"), F.lit("null"))
        found.append(df.select(F.lit(name).alias("name"), value.alias("json")))
    return found


def _or_empty(part: DataFrame, name: str) -> DataFrame:
    """The part, or an empty object if it has no row."""
    return part.agg(F.coalesce(F.max("json"), F.lit("{}")).alias("json")).select(F.lit(name).alias("name"), "json")


def overview_document(t: Tables) -> DataFrame:
    months = kpis.gmv_by_month(t)
    recent = months.orderBy(F.desc("month")).limit(3)
    recent = recent.withColumn("_pos", F.row_number().over(Window.orderBy("month")))
    peak = months.orderBy(F.desc("gmv"), "month").limit(1)
    return _document(
        "overview",
        _one(kpis.kpi_overview(t), "kpis"),
        _many(recent, "last_3_months", "_pos"),
        _or_empty(_one(peak, "peak_month"), "peak_month"),
    )


def returns_document(t: Tables) -> DataFrame:
    mart = t["category_region_return_rate"]
    pair = [F.col("category").asc(), F.col("region").asc()]
    totals = mart.agg(
        F.avg("return_rate").alias("global_avg_return_rate"),
        F.coalesce(money_sum("refund_total"), F.lit(0)).alias("global_total_refunds"),
    )
    worst = mart.select(
        "category", "region", "orders_total", "returns_total", "return_rate", "gmv_loss_rate", "refund_total"
    )
    best = mart.select("category", "region", "return_rate")
    return _document(
        "returns",
        *_scalars(totals),
        _many(_placed(worst, [F.desc("return_rate"), *pair], 5), "top_5_offenders", "_pos"),
        _many(_placed(best, [F.asc("return_rate"), *pair], 3), "bottom_3_safe_zones", "_pos"),
        _many(_placed(kpis.anomalies_summary(t), [F.desc(F.abs("delta_vs_baseline")), *pair], 5), "anomalies_vs_baseline", "_pos"),
    )


def promotion_document(t: Tables) -> DataFrame:
    promos = t["gmv_by_promotion"].where(F.col("promotion_id") != NO_PROMOTION)
    top = _placed(promos, [F.desc("gmv"), F.col("promotion_id").asc()], 3)
    columns = ["_pos", "promotion_name", "promotion_type", "discount_value", "gmv", "chargeback_rate"]
    return _document("promotions", *_scalars(_promotion_totals(promos)), _many(top.select(*columns), "top_3_by_gmv", "_pos"))


def sla_document(t: Tables) -> DataFrame:
    """Three worst and three best carriers; the best ones stay in worst-first order."""
    carriers = shaping.carrier_summary(t)
    order = [F.desc_nulls_last("sla_miss_rate"), F.col("carrier_name").asc()]
    tail = carriers.orderBy(F.asc_nulls_first("sla_miss_rate"), F.desc("carrier_name")).limit(3)
    return _document(
        "sla",
        _many(_placed(carriers, order, 3), "worst_carriers", "_pos"),
        _many(_placed(tail, order, 3), "best_carriers", "_pos"),
        *_scalars(carriers.agg(F.avg("sla_miss_rate").alias("global_sla_miss_rate"))),
    )


def documents(t: Tables) -> DataFrame:
    """The document of every section."""
    found = overview_document(t)
    for build in (returns_document, promotion_document, sla_document):
        found = found.unionByName(build(t))
    return found


def signature(found: DataFrame) -> DataFrame:
    """Cache key of a document: the first sixteen hex digits of the SHA-256 of {"payload": ..., "section": ...}."""
    text = F.concat(F.lit('{"payload":'), "payload", F.lit(',"section":"'), "section", F.lit('"}'))
    return found.select("section", F.substring(F.sha2(text, 256), 1, 16).alias("signature"))
