"""Expected results in DuckDB SQL for every registered query that SQL can express.

Money is compared as double, and means of doubles after rounding to six places, since
their last digits depend on the order of summation. Both sides do the same.
"""

from __future__ import annotations

from oracle import checks
from oracle.tables import WHOLE_LINES, average, build, rate, tally

REGION_NAMES = checks.TEST_REGIONS
MAP_CODES = {f"N{n:02d}": f"C{n:02d}" for n in range(15)}
WATCHED = ("N02", "N05", "N07", "N11", "N19")

# Decimal columns per table, given as double in the comparison.
DECIMALS = {
    "stg_orders": "subtotal shipping_cost total",
    "stg_order_items": "unit_price line_total",
    "stg_payments": "amount",
    "stg_returns": "refund_amount",
    "stg_products": "unit_price",
    "stg_carriers": "reliability_score",
    "stg_payment_methods": "processor_fee_pct",
    "int_orders_clean": "subtotal shipping_cost total",
    "int_returns_classified": "refund_amount",
    "dim_mkt_customer": "lifetime_gmv",
    "dim_seller": "gmv",
    "dim_product": "unit_price revenue",
    "dim_category": "gross_sales",
    "dim_carrier": "reliability_score",
    "dim_payment_method": "processor_fee_pct total_processed",
    "dim_promotion": "gmv",
    "fct_orders": "subtotal shipping_cost total payment_amount",
    "fct_order_items": "unit_price line_total",
    "fct_payments": "amount order_total",
    "fct_returns": "refund_amount order_total",
    "fct_reviews": "order_total",
    "category_region_return_rate": "gmv refund_total",
    "gmv_by_promotion": "gmv",
    "sla_by_carrier": "reliability_score",
    "pareto_sellers": "gmv",
    "growth_metrics_monthly": "gmv gmv_prev_month gmv_prev_year annualized_run_rate",
    "customer_ltv_by_segment": "total_net_ltv",
}


def doubled(source: str, columns: str) -> str:
    if not columns:
        return f"select * from {source}"
    casts = ", ".join(f'cast("{c}" as double) as "{c}"' for c in columns.split())
    return f"select * replace ({casts}) from {source}"


def table(name: str) -> str:
    return doubled(name, DECIMALS.get(name, ""))


def money(expr: str) -> str:
    return f"cast({expr} as double)"


def settled(expr: str) -> str:
    return f"round({expr}, 6)"


SQL: dict[str, str] = {}

# ---- models: every model is compared as a whole -----------------------------

MODEL_KEYS: dict[str, str] = {}
_groups = {
    "stg": "orders order_items payments returns reviews shipping_events mkt_customers sellers products categories "
    "geography dates carriers payment_methods return_reasons promotions",
    "int": "orders_clean returns_classified",
    "dim": "mkt_customer seller product category geography date carrier payment_method return_reason promotion",
}
for _layer, _names in _groups.items():
    for _at, _name in enumerate(_names.split(), 1):
        MODEL_KEYS[f"{_layer}-{_at:02d}"] = f"{_layer}_{_name}"
MODEL_KEYS |= {
    "fct-01": "fct_orders",
    "fct-03": "fct_order_items",
    "fct-04": "fct_payments",
    "fct-05": "fct_returns",
    "fct-06": "fct_reviews",
    "fct-07": "fct_shipping_events",
    "mrt-01": "category_region_return_rate",
    "mrt-02": "gmv_by_promotion",
    "mrt-03": "sla_by_carrier",
    "mrt-04": "customer_cohort_retention",
    "mrt-05": "pareto_sellers",
    "mrt-06": "growth_metrics_monthly",
    "mrt-07": "customer_ltv_by_segment",
    "mrt-08": "pipeline_health",
}
for _key, _name in MODEL_KEYS.items():
    SQL[_key] = table(_name)
SQL["fct-02"] = table("fct_orders")
SQL["fct-02b"] = table("fct_orders")

# ---- sources and sinks ------------------------------------------------------

_blank = "ship_date delivered_date carrier_id carrier promotion_id".split()
SQL["src-01"] = f"""
select * replace ({", ".join(f"nullif({c}, '') as {c}" for c in _blank)}) from raw_orders"""
SQL["src-02"] = "select * from lineitem"
SQL["snk-01"] = table("fct_orders")
SQL["snk-02"] = table("int_returns_classified")
SQL["snk-03"] = "select * from pipeline_health"
SQL["snk-04"] = "select * from audit_runs"

# ---- dashboard queries ------------------------------------------------------

RECENT = "order_date > (select max(order_date) from fct_orders) -"
OVERVIEW = f"""
select count(*) as orders_total, {money("sum(total)")} as gmv, cast(sum(items_count) as bigint) as units_sold,
       {tally("order_status = 'returned'")} as returns_total, {tally("payment_status = 'chargeback'")} as chargebacks_total,
       {average("total")} as avg_order_value, {average("items_count")} as avg_units_per_order,
       {rate(tally("order_status = 'returned'"), "count(*)")} as return_rate,
       {rate(tally("payment_status = 'chargeback'"), "count(*)")} as chargeback_rate
from fct_orders"""
SQL["qry-01"] = OVERVIEW
SQL["qry-02"] = f"""
select {money("sum(total)")} as sales, cast(sum(items_count) as bigint) as units_sold,
       {tally("order_status = 'returned'")} as returns_count, {average("total")} as aov, {average("items_count")} as auo
from fct_orders where {RECENT} 30"""
SQL["qry-03"] = f"""
select {money("a")} as gmv_this_week, {money("b")} as gmv_last_week,
       case when b > 0 then {rate("a - b", "b")} else 0 end as gmv_delta_pct
from (select sum(total) filter (where {RECENT} 7) as a, sum(total) filter (where not {RECENT} 7) as b
      from fct_orders where {RECENT} 14)"""
SQL["qry-04"] = f"""
select order_date as order_day, {money("sum(total)")} as gmv, count(*) as orders
from fct_orders where {RECENT} 14 group by 1"""
MONTHS = f"""select "month", {money("gmv")} as gmv, orders, peak as promo_peak_orders from month_totals"""
SQL["qry-05"] = MONTHS
SQL["qry-06"] = f"""
select strftime(order_date, '%a %b %d') as day_label, order_date,
       case when not {RECENT} 7 then {average("total")} end as last_week,
       case when {RECENT} 7 then {average("total")} end as this_week
from fct_orders where {RECENT} 14 group by order_date"""
SQL["qry-07"] = f"""
select ship_country, 'C' || right(ship_country, 2) as country_iso3, {money("sum(total)")} as gmv, count(*) as orders
from fct_orders where ship_country in {tuple(MAP_CODES)} group by ship_country"""
SQL["qry-08"] = f"""
select region, {money("sum(total)")} as gmv, count(*) as orders
from fct_orders left join stg_geography on country_code = ship_country group by region"""
SQL["qry-09"] = f"""
select country_name as country, {money("sum(total)")} as gmv, count(*) as orders
from fct_orders join stg_geography on country_code = ship_country group by 1 order by 2 desc, 1 limit 10"""
SQL["qry-10"] = f"""
select seller_id, seller_name, country_code, region, {money("gmv")} as gmv, orders_count, products_count
from dim_seller order by dim_seller.gmv desc, seller_id limit 10"""
SQL["qry-11"] = f"""
select product_id, product_name, category, units_sold, {money("revenue")} as revenue
from dim_product order by dim_product.revenue desc, product_id limit 10"""
SQL["qry-12"] = f"""
select category_name as category, units_sold, {money("gross_sales")} as gross_sales
from dim_category order by dim_category.gross_sales desc, 1 limit 10"""
SQL["qry-13"] = f"""
select case when transit_days <= 2 then 'Express' when transit_days <= 4 then 'Expedited'
            when transit_days <= 7 then 'Standard' else 'Slow' end as level,
       count(*) as orders, {money("sum(total)")} as gmv
from fct_orders where transit_days is not null group by 1"""
for _key, _name in {
    "qry-14": "sla_by_carrier",
    "qry-15": "category_region_return_rate",
    "qry-16": "gmv_by_promotion",
    "qry-22": "customer_cohort_retention",
    "qry-23": "pareto_sellers",
    "qry-24": "growth_metrics_monthly",
    "qry-25": "customer_ltv_by_segment",
}.items():
    SQL[_key] = table(_name)
SQL["qry-17"] = f"""
select coalesce(promotion_type, 'unknown') as promotion_type, count(*) as campaigns,
       cast(sum(orders_count) as bigint) as orders, {money("sum(gmv)")} as gmv,
       {settled("avg(chargeback_rate)")} as avg_chargeback_rate, {settled("avg(return_rate)")} as avg_return_rate
from gmv_by_promotion where promotion_id <> 'NO_PROMOTION' group by 1"""
BUCKETS = f"""
select case when promotion_id = 'NO_PROMOTION' then 'baseline (no promo)'
            when is_aggressive then 'aggressive (>=30% / BOGO)' else 'regular promo' end as bucket,
       count(*) as campaigns, cast(sum(orders_count) as bigint) as orders, {money("sum(gmv)")} as gmv,
       {settled("avg(avg_order_value)")} as aov,
       {settled("sum(cast(gmv as double) * chargeback_rate) / cast(sum(gmv) as double)")} as weighted_chargeback_rate,
       {settled("sum(cast(gmv as double) * return_rate) / cast(sum(gmv) as double)")} as weighted_return_rate
from gmv_by_promotion group by 1"""
SQL["qry-18"] = BUCKETS
SQL["qry-19"] = f"""
select method_code, method_name, transactions, {money("total_processed")} as total_processed, chargeback_rate,
       chargeback_risk
from dim_payment_method"""
SQL["qry-20"] = f"""
select rating, count(*) as reviews_count, {tally("order_status = 'returned'")} as returned_count
from fct_reviews group by rating"""
ANOMALIES = """
select category, region, return_rate, gmv_loss_rate, cast(refund_total as double) as refund_total,
       return_rate - avg_rate as delta_vs_baseline
from category_region_return_rate, (select avg(return_rate) as avg_rate from category_region_return_rate)
order by abs(return_rate - avg_rate) desc, category, region limit 5"""
SQL["qry-21"] = f"select * replace ({settled('delta_vs_baseline')} as delta_vs_baseline) from ({ANOMALIES})"
SQL["qry-26"] = "select * from pipeline_health order by invocation_at desc, run_id limit 25"
SQL["qry-27"] = "select * from pipeline_health order by invocation_at desc, run_id limit 1"
SQL["qry-28"] = """
select node_name, resource_type, status, duration_ms, rows_affected, message
from audit_runs where invocation_at = (select max(invocation_at) from audit_runs)"""
SQL["qry-29"] = f"""
select node_name, resource_type, {average("duration_ms")} as avg_duration_ms, count(*) as runs
from audit_runs where resource_type in ('model', 'test') group by 1, 2 order by 3 desc, 1, 2 limit 10"""
SQL["qry-30"] = f"""
select invocation_at, {tally("status = 'pass'")} as tests_pass, {tally("status = 'warn'")} as tests_warn,
       {tally("status in ('fail', 'error')")} as tests_fail
from audit_runs where resource_type = 'test' group by 1"""
SQL["qry-31"] = f"""
select "month", {money("gmv")} as amazon_sales, {money("gmv * 0.12")} as google_ads,
       {money("gmv * 0.08")} as facebook_ads, {money("gmv * 0.05")} as tiktok_ads
from month_totals"""

# ---- executive summaries ----------------------------------------------------

SQL["anl-01"] = f"""
select category, region, orders_total, returns_total, round(return_rate * 100, 1) as return_rate_pct,
       round({money("gmv")}, 0) as gmv, round({money("refund_total")}, 0) as refund_total,
       round(gmv_loss_rate * 100, 1) as gmv_loss_pct, returns_product_issue, returns_fit_issue,
       returns_customer_driven, returns_outside_policy
from category_region_return_rate"""
SQL["anl-02"] = f"""
select promotion_id, promotion_name, promotion_type, discount_value, is_aggressive, orders_count,
       round({money("gmv")}, 0) as gmv, round(avg_order_value, 2) as aov,
       round(chargeback_rate * 100, 2) as chargeback_rate_pct, round(refund_rate * 100, 2) as refund_rate_pct,
       round(return_rate * 100, 2) as return_rate_pct, black_friday_orders, cyber_monday_orders
from gmv_by_promotion"""
SQL["anl-03"] = f"""
select carrier_id, carrier_name, ship_country, sla_promised_days, {money("reliability_score")} as reliability_score,
       orders_total, orders_delivered, avg_transit_days, round(sla_miss_rate * 100, 1) as sla_miss_pct, late_returns,
       round(late_return_rate * 100, 2) as late_return_pct
from sla_by_carrier"""

# ---- chart data -------------------------------------------------------------


def _matrix(row: str, column: str, values: dict[str, str], cell: str, source: str) -> str:
    cells = ", ".join(f"""{settled(f"avg({cell}) filter (where {column} = {v})")} as "{n}" """ for n, v in values.items())
    return f"select {row}, {cells} from {source} group by {row}"


SQL["shp-01"] = _matrix(
    "category", "region", {r: f"'{r}'" for r in REGION_NAMES}, "return_rate", "category_region_return_rate"
)
# The orders of the test tables lie between January 1992 and August 1998: ages of 0 to 79 months.
_ages = ", ".join(
    f"""{settled(f"avg(retention_pct * 100) filter (where months_since_acquisition = {age})")} as "M{age}" """ for age in range(80)
)
SQL["shp-02"] = f"""
select cohort_month, {_ages} from customer_cohort_retention
where cohort_month in (select distinct cohort_month from customer_cohort_retention order by cohort_month desc limit 12)
group by cohort_month"""
_tenures = ["< 3mo", "3-12mo", "1-2y", "2y+"]
SQL["shp-03"] = "select region, " + ", ".join(
    f"""{settled(f"coalesce(avg(avg_net_ltv) filter (where tenure_bucket = '{b}'), 0)")} as "{b}" """ for b in _tenures
) + " from customer_ltv_by_segment group by region"
CARRIERS = """
select carrier_name, avg(sla_miss_rate) as sla_miss_rate, avg(late_return_rate) as late_return_rate,
       cast(sum(orders_total) as bigint) as orders_total
from sla_by_carrier group by carrier_name"""
SQL["shp-04"] = f"""
select * replace ({settled("sla_miss_rate")} as sla_miss_rate, {settled("late_return_rate")} as late_return_rate)
from ({CARRIERS})"""
SQL["shp-05"] = f"""
select rating, count(*) - {tally("order_status = 'returned'")} as kept, {tally("order_status = 'returned'")} as returned
from fct_reviews group by rating"""
SQL["shp-06"] = f"""
select rank, seller_id, {money("gmv")} as gmv, cumulative_gmv_pct * 100 as cumulative_pct, pareto_bucket,
       (select count(*) from pareto_sellers where pareto_bucket = 'A') as a_sellers,
       (select {rate("sum(gmv) filter (where pareto_bucket = 'A')", "sum(gmv)")} from pareto_sellers) as a_share,
       (select count(*) from pareto_sellers where pareto_bucket = 'B') as b_sellers
from pareto_sellers where rank <= 200"""
SQL["shp-07"] = f"""
select campaigns, promo_gmv, share_of_orders, {settled("base")} as baseline_chargeback,
       {settled("aggr")} as aggressive_chargeback, {settled("aggr - base")} as chargeback_premium,
       {settled("(aggr - base) / greatest(base, 1e-9)")} as relative_premium
from (select {tally("not none")} as campaigns, {money("sum(gmv) filter (where not none)")} as promo_gmv,
             {rate("sum(orders_count) filter (where not none)", "sum(orders_count)")} as share_of_orders,
             coalesce(sum(cast(gmv as double) * chargeback_rate) filter (where none)
               / cast(sum(gmv) filter (where none) as double), 0) as base,
             coalesce(sum(cast(gmv as double) * chargeback_rate) filter (where not none and is_aggressive)
               / cast(sum(gmv) filter (where not none and is_aggressive) as double), 0) as aggr
      from (select *, promotion_id = 'NO_PROMOTION' as none from gmv_by_promotion))"""
SQL["shp-08"] = f"""
select category, region, orders_total, returns_total, round(return_rate * 100, 1) as return_rate_pct,
       {money("refund_total")} as refund_total, round(gmv_loss_rate * 100, 1) as gmv_loss_pct
from category_region_return_rate order by category_region_return_rate.refund_total desc, category, region limit 8"""
SQL["shp-08b"] = f"""
select promotion_name, promotion_type, discount_value, is_aggressive, orders_count, {money("gmv")} as gmv,
       round(chargeback_rate * 100, 2) as chargeback_rate_pct, round(return_rate * 100, 1) as return_rate_pct
from gmv_by_promotion where promotion_id <> 'NO_PROMOTION'
order by gmv_by_promotion.gmv desc, promotion_id limit 5"""

# ---- fact sheets ------------------------------------------------------------


def _facts(section: str, fact: str, source: str, numbers: str, texts: str = "", position: str = "1") -> str:
    """Melt columns of a query into fact rows."""
    cells = [(f, money(f'"{f}"'), "cast(null as varchar)") for f in numbers.split()]
    cells += [(f, "cast(null as double)", f'cast("{f}" as varchar)') for f in texts.split()]
    rows = [
        f"select '{section}' as section, '{fact}' as fact, cast({position} as bigint) as position, '{f}' as field, "
        f'{n} as "number", {x} as "text" from ({source})'
        for f, n, x in cells
    ]
    return "\nunion all ".join(rows)


def _top(source: str, order: str, limit: int) -> str:
    return f"select *, row_number() over (order by {order}) as pos from {source} qualify pos <= {limit}"


MART = "category_region_return_rate"
PROMOS = "(select * from gmv_by_promotion where promotion_id <> 'NO_PROMOTION')"
SHEETS = {
    "pay-01": [
        _facts(
            "overview",
            "kpis",
            OVERVIEW,
            "orders_total gmv units_sold returns_total chargebacks_total avg_order_value avg_units_per_order "
            "return_rate chargeback_rate",
        ),
        _facts(
            "overview",
            "last_3_months",
            f"""select *, 4 - row_number() over (order by "month" desc) as pos from ({MONTHS}) qualify pos >= 1""",
            "gmv orders promo_peak_orders",
            "month",
            "pos",
        ),
        _facts(
            "overview",
            "peak_month",
            f"""{MONTHS} order by month_totals.gmv desc, "month" limit 1""",
            "gmv orders promo_peak_orders",
            "month",
        ),
    ],
    "pay-02": [
        _facts(
            "returns",
            "totals",
            f"select avg(return_rate) as global_avg_return_rate, sum(refund_total) as global_total_refunds from {MART}",
            "global_avg_return_rate global_total_refunds",
        ),
        _facts(
            "returns",
            "top_5_offenders",
            _top(MART, "return_rate desc, category, region", 5),
            "orders_total returns_total return_rate gmv_loss_rate refund_total",
            "category region",
            "pos",
        ),
        _facts(
            "returns",
            "bottom_3_safe_zones",
            _top(MART, "return_rate, category, region", 3),
            "return_rate",
            "category region",
            "pos",
        ),
        _facts(
            "returns",
            "anomalies_vs_baseline",
            _top(f"({ANOMALIES})", "abs(delta_vs_baseline) desc, category, region", 5),
            "return_rate gmv_loss_rate refund_total delta_vs_baseline",
            "category region",
            "pos",
        ),
    ],
    "pay-03": [
        _facts(
            "promotions",
            "totals",
            f"""select count(*) as campaigns_count, coalesce(sum(gmv), 0) as total_promo_gmv,
                coalesce(avg(chargeback_rate) filter (where is_aggressive), 0) as aggressive_campaigns_chargeback_rate,
                coalesce(avg(chargeback_rate) filter (where not is_aggressive), 0) as non_aggressive_chargeback_rate
                from {PROMOS}""",
            "campaigns_count total_promo_gmv aggressive_campaigns_chargeback_rate non_aggressive_chargeback_rate",
        ),
        _facts(
            "promotions",
            "top_3_by_gmv",
            _top(PROMOS, "gmv desc, promotion_id", 3),
            "discount_value gmv chargeback_rate",
            "promotion_name promotion_type",
            "pos",
        ),
    ],
    "pay-04": [
        _facts(
            "sla",
            "worst_carriers",
            _top(f"({CARRIERS})", "sla_miss_rate desc nulls last, carrier_name", 3),
            "sla_miss_rate late_return_rate orders_total",
            "carrier_name",
            "pos",
        ),
        _facts(
            "sla",
            "best_carriers",
            f"""select *, 4 - row_number() over (order by sla_miss_rate nulls first, carrier_name desc) as pos
                from ({CARRIERS}) qualify pos >= 1""",
            "sla_miss_rate late_return_rate orders_total",
            "carrier_name",
            "pos",
        ),
        _facts(
            "sla",
            "totals",
            f"select avg(sla_miss_rate) as global_sla_miss_rate from ({CARRIERS})",
            "global_sla_miss_rate",
        ),
    ],
}
for _key, _parts in SHEETS.items():
    _all = "\nunion all ".join(_parts)
    SQL[f"{_key}b"] = f"""select * replace ({settled('"number"')} as "number") from ({_all})"""

# The same as documents: JSON text put together by hand, keys in order.


def _whole(c: str) -> str:
    return f"coalesce(cast(cast({c} as bigint) as varchar), 'null')"


def _fraction(c: str) -> str:
    return f"coalesce(cast(cast({c} as decimal(38,6)) as varchar), 'null')"


def _words(c: str) -> str:
    return f"""coalesce('"' || cast({c} as varchar) || '"', 'null')"""


def _object(whole: str = "", fraction: str = "", words: str = "") -> str:
    cells = [(c, _whole(f'"{c}"')) for c in whole.split()] + [(c, _fraction(f'"{c}"')) for c in fraction.split()]
    cells += [(c, _words(f'"{c}"')) for c in words.split()]
    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || {x}""" for c, x in sorted(cells)) + " || '}'"


def _listed(source: str, record: str, order: str = "pos") -> str:
    return f"(select '[' || coalesce(string_agg({record}, ',' order by {order}), '') || ']' from ({source}))"


def _json(section: str, parts: dict[str, str]) -> str:
    body = " || ',' || ".join(f"""'"{name}":' || {text}""" for name, text in sorted(parts.items()))
    return f"select '{section}' as section, '{{' || {body} || '}}' as payload"


_kpi = _object(
    "chargebacks_total orders_total returns_total units_sold", "avg_order_value avg_units_per_order chargeback_rate gmv return_rate"
)
_month = _object("orders promo_peak_orders", "gmv", "month")
_month_rows = f"""(select * replace (cast("month" as date) as "month") from ({MONTHS}))"""
_offender = _object("orders_total returns_total", "gmv_loss_rate refund_total return_rate", "category region")
_anomaly = _object("", "delta_vs_baseline gmv_loss_rate refund_total return_rate", "category region")
_campaign = _object("discount_value", "chargeback_rate gmv", "promotion_name promotion_type")
_carrier = _object("orders_total", "late_return_rate sla_miss_rate", "carrier_name")
_flagged = "avg(chargeback_rate) filter (where {})"
DOCUMENTS = {
    "pay-01": _json(
        "overview",
        {
            "kpis": f"(select {_kpi} from ({OVERVIEW}))",
            "last_3_months": _listed(f"""select * from {_month_rows} order by "month" desc limit 3""", _month, '"month"'),
            "peak_month": f"""(select {_month} from {_month_rows} order by gmv desc, "month" limit 1)""",
        },
    ),
    "pay-02": _json(
        "returns",
        {
            "global_avg_return_rate": f"(select {_fraction('avg(return_rate)')} from {MART})",
            "global_total_refunds": f"(select {_fraction('coalesce(sum(refund_total), 0)')} from {MART})",
            "top_5_offenders": _listed(_top(MART, "return_rate desc, category, region", 5), _offender),
            "bottom_3_safe_zones": _listed(
                _top(MART, "return_rate, category, region", 3), _object("", "return_rate", "category region")
            ),
            "anomalies_vs_baseline": _listed(
                _top(f"({ANOMALIES})", "abs(delta_vs_baseline) desc, category, region", 5), _anomaly
            ),
        },
    ),
    "pay-03": _json(
        "promotions",
        {
            "campaigns_count": f"(select {_whole('count(*)')} from {PROMOS})",
            "total_promo_gmv": f"(select {_fraction('coalesce(sum(gmv), 0)')} from {PROMOS})",
            "aggressive_campaigns_chargeback_rate": f"(select {_fraction('coalesce(' + _flagged.format('is_aggressive') + ', 0)')} from {PROMOS})",
            "non_aggressive_chargeback_rate": f"(select {_fraction('coalesce(' + _flagged.format('not is_aggressive') + ', 0)')} from {PROMOS})",
            "top_3_by_gmv": _listed(_top(PROMOS, "gmv desc, promotion_id", 3), _campaign),
        },
    ),
    "pay-04": _json(
        "sla",
        {
            "worst_carriers": _listed(_top(f"({CARRIERS})", "sla_miss_rate desc nulls last, carrier_name", 3), _carrier),
            "best_carriers": _listed(
                _top(f"({CARRIERS})", "sla_miss_rate nulls first, carrier_name desc", 3), _carrier, "pos desc"
            ),
            "global_sla_miss_rate": f"(select {_fraction('avg(sla_miss_rate)')} from ({CARRIERS}))",
        },
    ),
}
SQL |= DOCUMENTS
_every = "\nunion all ".join(DOCUMENTS.values())
SQL["pay-05"] = f"""
select section, left(sha256('{{"payload":' || payload || ',"section":"' || section || '"}}'), 16) as signature from ({_every})"""

# ---- data checks ------------------------------------------------------------

FAILING = {
    "positive_price": f"""
select product_id, sku, {money("unit_price")} as unit_price from dim_product where unit_price <= 0""",
    "payment_matches_order": f"""
select order_id, {money("total")} as order_total, {money("amount")} as payment_amount, status as payment_status,
       {money("abs(amount - total)")} as delta
from fct_orders join stg_payments using (order_id)
where status in ('captured', 'refunded') and abs(amount - total) > 0.01""",
    "returned_within_policy": """
select return_id, order_id, delivered_date, return_date, days_to_return from fct_returns where days_to_return > 30""",
}


def _check(kind: str, table: str, column: str, found: str, severity: str = "error") -> str:
    return f"""select '{kind}_{table}_{column}' as "check", '{kind}' as kind, '{table}' as "table", '{column}' as "column",
        '{severity}' as severity, ({found}) as failures"""


def not_null() -> list[str]:
    return [_check("not_null", t, c, f'select count(*) from {t} where "{c}" is null') for t, c in checks.NOT_NULL]


def unique() -> list[str]:
    repeated = 'select count(*) from (select "{c}" from {t} where "{c}" is not null group by "{c}" having count(*) > 1)'
    return [_check("unique", t, c, repeated.format(t=t, c=c)) for t, c in checks.UNIQUE]


def accepted_values(*lists: tuple[str, ...]) -> list[str]:
    return [
        _check("accepted_values", t, c, f"""select count(distinct "{c}") from {t} where cast("{c}" as varchar) not in {values}""")
        for t, c, values in checks.accepted(*lists)
    ]


def relationships() -> list[str]:
    return [
        _check("relationships", t, c, f'select count(*) from {t} where "{c}" is not null and "{c}" not in (select "{c}" from {parent})', severity)
        for t, c, parent, severity in checks.RELATIONSHIPS
    ]


def rules() -> list[str]:
    return [_check(kind, t, c, f"select count(*) from ({FAILING[kind]})", "warn") for kind, t, c in checks.RULES]


def summary(parts: list[str]) -> str:
    rows = "\nunion all ".join(parts)
    return f"""
select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn' else 'fail' end as status
from ({rows})"""


#: The whole suite with the codes of the test tables.
SUITE = summary(
    [
        *not_null(),
        *unique(),
        *accepted_values(checks.TEST_STATUSES, checks.TEST_EVENT_TYPES, checks.TEST_REGIONS, checks.TEST_CATEGORIES),
        *relationships(),
        *rules(),
    ]
)
SQL["dq-01"] = summary(not_null())
SQL["dq-02"] = summary(unique())
# With the marketplace's own codes, so that some find something.
SQL["dq-03"] = summary(accepted_values(checks.STATUSES, checks.EVENT_TYPES, checks.TEST_REGIONS, checks.CATEGORIES))
SQL["dq-04"] = summary(relationships())
SQL["dq-05"] = FAILING["positive_price"]
SQL["dq-06"] = FAILING["payment_matches_order"]
SQL["dq-07"] = FAILING["returned_within_policy"]
SQL["dq-08"] = SUITE
SQL["dq-09"] = """
select max(paid_at) as newest, date_diff('second', max(paid_at), timestamp '2001-08-02 12:00:00') / 3600.0 as age_hours,
       case when max(paid_at) < timestamp '2001-07-31 12:00:00' then 'fail'
            when max(paid_at) < timestamp '2001-08-01 10:00:00' then 'warn' else 'pass' end as status
from stg_payments"""
_built = "\nunion all ".join(
    f"select 'model' as resource_type, '{m}' as node_name, 'success' as status, {n} as rows_affected"
    for m, n in [(m, f"(select count(*) from {m})") for m in checks.STORED] + [(m, "0") for m in checks.COMPUTED]
)
SQL["aud-01"] = f"""
{_built}
union all select 'test', "check", status, failures from ({SUITE})"""
SQL["ded-01"] = doubled(
    "(select * from stg_orders qualify row_number() over (partition by customer_id order by order_date, order_id) = 1)",
    DECIMALS["stg_orders"],
)

# ---- data jobs --------------------------------------------------------------

SQL["job-01"] = "select * from stg_dates"
SQL["job-02"] = """
select o.order_id, o.order_date, o.promotion_id, count(p.promotion_id) as active_campaigns,
       first(p.promotion_id order by p.starts_at, p.promotion_id) as credited_promotion_id,
       case when o.promotion_id is not null then bool_or(p.promotion_id = o.promotion_id) is true end as recorded_in_window
from stg_orders o left join stg_promotions p on p.starts_at <= o.order_date and o.order_date <= p.ends_at
group by o.order_id, o.order_date, o.promotion_id"""
SQL["job-03"] = """
select order_id || '-' || seq as event_id, order_id, carrier_id, ev as event_type,
       case when seq < 4 then cast(order_date as timestamp) + to_hours(hh) else cast(delivered_date as timestamp) end
         as event_at
from stg_orders, (values (0, 'order_created', 0), (1, 'label_printed', 2), (2, 'handed_to_carrier', 8),
                         (3, 'in_transit', 24), (4, 'delivered', 0)) e(seq, ev, hh)
where ship_date is not null and (seq < 4 or delivered_date is not null)"""
SQL["job-04"] = """
select promotion_id, promotion_type, discount_value, is_aggressive, hit as expected_aggressive,
       hit = is_aggressive as agrees
from (select *, case promotion_type when 'bogo' then true when 'percentage' then discount_value >= 30 else false end
             as hit from stg_promotions)"""
SQL["job-05"] = f"""
select 'q4_share' as signal, 'all' as period,
       {rate(tally("strftime(order_date, '%m%d') between '1120' and '1231'"), "count(*)")} as value from fct_orders
union all select 'cyber_week_share', 'all',
       {rate(tally("strftime(order_date, '%m%d') between '1124' and '1202'"), "count(*)")} from fct_orders
union all select 'july_vs_average_month', 'all',
       (cast(sum(orders) filter (where month("month") = 7) as double) / {tally('month("month") = 7')})
         / (cast(sum(orders) as double) / count(*)) from month_totals
union all select 'yoy_order_growth', cast(y as varchar),
       {rate("n - lag(n) over (order by y)", "lag(n) over (order by y)")}
from (select year(order_date) as y, count(*) as n from fct_orders group by 1)"""
SQL["job-06"] = f"""
select case when payment_method = 'crypto' and customer_country_code in {WATCHED} then 'crypto_watched' else 'rest' end
         as segment,
       count(*) as payments, {tally("payment_status = 'chargeback'")} as chargebacks,
       {rate(tally("payment_status = 'chargeback'"), "count(*)")} as chargeback_rate
from fct_orders where payment_status is not null group by 1"""
SQL["job-07"] = f"""
select coalesce(order_status = 'returned', false) as returned, rating, count(*) as reviews,
       {rate("count(*)", "sum(count(*)) over (partition by coalesce(order_status = 'returned', false))")} as "share"
from fct_reviews group by 1, 2"""
SQL["job-08"] = f"""
select *, round(corr(reliability_score, sla_miss_rate) over (), 6) as corr_reliability_miss,
       round(corr(reliability_score, late_return_rate) over (), 6) as corr_reliability_late
from (select carrier_id, {money("reliability_score")} as reliability_score,
             cast(sum(orders_total) as bigint) as orders_total, cast(sum(orders_delivered) as bigint) as orders_delivered,
             {rate("sum(round(sla_miss_rate * orders_delivered))", "sum(orders_delivered)")} as sla_miss_rate,
             {rate("sum(late_returns)", "sum(orders_total)")} as late_return_rate
      from sla_by_carrier group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {key: build(sql, WHOLE_LINES if key == "mrt-01" else {}) for key, sql in SQL.items()}
