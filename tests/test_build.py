import pytest

from souk.__main__ import main
from souk.operators import quality
from souk.params import Params
from souk.plans import kpis
from souk.plans.audit import AuditLog
from souk.plans.build import WAVES, run_pipeline
from souk.plans.warehouse import CATALOG, StoredTables, UpstreamMissing, Warehouse
from souk.sources.raw import RAW_COLUMNS, csv_source
from tests.helpers import values

CELLS = {
    "orders": ["o1,c1,2024-01-05,delivered,2024-01-06,2024-01-09,US,K1,Kay,,1,9,1,10", "o2,c1,06/02/2024,cancelled,,,us,,,,1,9,1,10"],
    "order_items": ["o1,1,p1,seller_1,1,9,9"],
    "payments": ["y1,o1,pix,captured,10,usd,2024-01-05 01:00:00"],
    "returns": ["r1,o1,2024-01-20,defective,10,Books,Europe,true"],
    "reviews": ["v1,o1,c1,5,t,b,2024-01-21,true"],
    "shipping_events": ["e1,o1,K1,order_created,2024-01-05 00:00:00"],
    "customers": ["c1,Ann,a@b.c,US,2023-01-01,true"],
    "sellers": ["SELLER-1,Sam,us,true,2022-01-01,"],
    "products": ["p1,sku,Novel,Books,C1,SELLER-1,9,5,2022-01-01"],
    "categories": ["C1,Books,Media,30,false"],
    "geography": ["US,United States,North America,Americas,USD,en,false"],
    "dates": ["2024-01-05,2024,1,5,Friday,Q1,false,false,false,false,false"],
    "carriers": ["K1,Kay,US,3,0.9"],
    "payment_methods": ["pix,PIX,0.005,0,very_low"],
    "return_reasons": ["defective,Broken,product_issue,true"],
    "promotions": ["P1,One,bogo,100,2024-01-01,2024-01-31,true"],
}


def folder(tmp_path, **changes):
    for name, rows in (CELLS | changes).items():
        (tmp_path / f"{name}.csv").write_text("\n".join([RAW_COLUMNS[name].replace(" ", ","), *rows]) + "\n")
    return str(tmp_path)


def build(spark, tmp_path, **changes):
    log = AuditLog(spark, str(tmp_path / "audit")).ensure()
    tables = Warehouse(
        spark, csv_source(spark, folder(tmp_path, **changes)), Params(), root=str(tmp_path / "db"), extra={"audit_runs": log.read}
    )
    run = run_pipeline(tables, quality.declared_checks(), log, run_id="run-0001-abc")
    return tables, log, run


def test_waves_cover_the_catalogue():
    assert sorted(n for wave in WAVES for n in wave) == sorted(CATALOG)
    assert len(CATALOG) == 43 - 1


def test_csv_to_marts(spark, tmp_path):
    tables, log, run = build(spark, tmp_path)
    counts = {(r["resource_type"], r["status"]): r["count"] for r in run.groupBy("resource_type", "status").count().collect()}
    assert counts == {("model", "success"): 42, ("test", "pass"): 89}
    assert values(tables["category_region_return_rate"], "category", "region", "orders_total", "returns_total") == [
        ("Books", "North America", 1, 1)
    ]
    assert values(tables["dim_seller"], "seller_id", "orders_count") == [("SELLER-1", 1)]
    # The cancelled, unpaid order is not in the fact, yet counts for the customer.
    assert values(tables["fct_orders"], "order_id") == [("o1",)]
    assert values(tables["dim_mkt_customer"], "orders_count") == [(2,)]
    health = tables["pipeline_health"].first()
    assert (health["run_short"], health["nodes_total"], health["overall_status"]) == ("run-0001", 131, "green")
    assert kpis.latest_run(tables).first()["run_id"] == "run-0001-abc"
    assert kpis.latest_run_node_breakdown(tables).count() == 131
    rows = {r["node_name"]: r["rows_affected"] for r in log.read().where("resource_type = 'model'").collect()}
    assert rows["stg_orders"] == 2 and rows["fct_orders"] == 1


def test_failed_check_withholds_dependants(spark, tmp_path):
    tables, log, run = build(spark, tmp_path, payments=CELLS["payments"] * 2)
    status = {r["node_name"]: r["status"] for r in run.collect()}
    assert status["unique_raw_payments_payment_id"] == "fail"
    assert status["stg_payments"] == status["fct_orders"] == status["sla_by_carrier"] == "skipped"
    assert status["unique_fct_orders_order_id"] == "skipped"
    assert status["stg_orders"] == status["dim_seller"] == status["pareto_sellers"] == "success"
    with pytest.raises(UpstreamMissing):
        tables["fct_orders"]
    assert tables["pipeline_health"].first()["overall_status"] == "failed"


def test_broken_model_is_an_error(spark, tmp_path):
    bad = ["2024-01-05,2024,1,5,Friday,Q1,perhaps,false,false,false,false"]
    _, _, run = build(spark, tmp_path, dates=bad)
    status = {r["node_name"]: (r["status"], r["message"]) for r in run.collect()}
    assert status["stg_dates"][0] == "error" and "not a boolean" in status["stg_dates"][1]
    assert status["dim_date"][0] == status["fct_orders"][0] == "skipped"


def test_warning_keeps_going(spark, tmp_path):
    _, _, run = build(spark, tmp_path, products=["p1,sku,Novel,Books,C1,SELLER-1,-9,5,2022-01-01"])
    status = {r["node_name"]: r["status"] for r in run.collect()}
    assert status["positive_price_dim_product_unit_price"] == "warn"
    assert "skipped" not in status.values()


def test_command_line_builds_twice(spark, tmp_path):
    raw_dir, out = folder(tmp_path), str(tmp_path / "out")
    assert main([raw_dir, out, "--as-of", "2024-12-31"]) == 0
    more = [*CELLS["orders"], "o3,c1,2024-03-01,shipped,2024-03-02,,US,K1,Kay,,1,9,1,10", "o4,c1,2024-01-01,shipped,,,US,,,,1,9,1,10"]
    dates = [*CELLS["dates"], "2024-03-01,2024,3,1,Friday,Q1,false,false,false,false,false"]
    folder(tmp_path, orders=more, dates=dates)
    assert main([raw_dir, out]) == 0
    tables = StoredTables(spark, out, {"audit_runs": AuditLog(spark, f"{out}/audit/runs").read})
    # The second run adds the newer order and the one that arrived late.
    assert values(tables["fct_orders"], "order_id") == [("o1",), ("o3",), ("o4",)]
    assert values(kpis.pipeline_runs(tables), "overall_status", "nodes_total") == [("green", 131)] * 2
    assert kpis.kpi_overview(tables).first()["orders_total"] == 3
    assert main([raw_dir, out, "--full-refresh", "--return-window", "5"]) == 0
    tables.refresh()
    assert values(tables["fct_orders"], "order_id") == [("o1",), ("o3",), ("o4",)]
    # Settings come back with the tables: returned on the 11th day, allowed until the 5th.
    assert values(tables["int_returns_classified"], "is_within_policy") == [(False,)]


def test_strict_command_line_ignores_late_orders(spark, tmp_path):
    raw_dir, out = folder(tmp_path), str(tmp_path / "out")
    assert main([raw_dir, out]) == 0
    more = [*CELLS["orders"], "o3,c1,2024-03-01,shipped,2024-03-02,,US,K1,Kay,,1,9,1,10", "o4,c1,2024-01-01,shipped,,,US,,,,1,9,1,10"]
    folder(tmp_path, orders=more, dates=[*CELLS["dates"], "2024-03-01,2024,3,1,Friday,Q1,false,false,false,false,false"])
    assert main([raw_dir, out, "--lookback", "0"]) == 0
    assert values(StoredTables(spark, out)["fct_orders"], "order_id") == [("o1",), ("o3",)]


def test_line_breaks_and_malformed_lines(spark, tmp_path):
    """A quoted line break stays in its field; a field too many or too few is reported with its line."""
    out = str(tmp_path / "out")
    raw_dir = folder(
        tmp_path,
        reviews=['v1,o1,c1,5,"a ""t""","one\ntwo, three",2024-01-21,true'],
        payments=[*CELLS["payments"], "y2,o1,pix,captured,10,usd,2024-01-05 01:00:00,surplus", "y3,o1,pix"],
    )
    assert main([raw_dir, out]) == 0
    tables = StoredTables(spark, out, {"audit_runs": AuditLog(spark, f"{out}/audit/runs").read})
    assert values(tables["stg_reviews"], "title", "body") == [('a "t"', "one\ntwo, three")]
    assert values(tables["stg_payments"], "payment_id") == [("y1",)]
    assert values(spark.read.parquet(f"{out}/rejects"), "table", "line") == [
        ("payments", "y2,o1,pix,captured,10,usd,2024-01-05 01:00:00,surplus"),
        ("payments", "y3,o1,pix"),
    ]
    warned = tables["audit_runs"].where("status = 'warn'")
    assert values(warned, "node_name", "rows_affected") == [("readable_raw_payments", 2)]


def test_stored_tables_plan_without_jobs(spark, tmp_path):
    raw_dir, out = folder(tmp_path), str(tmp_path / "out")
    assert main([raw_dir, out]) == 0
    tables = StoredTables(spark, out, {"audit_runs": AuditLog(spark, f"{out}/audit/runs").read})
    spark.sparkContext.setJobGroup("plans", "plans")
    for plan in (kpis.kpi_overview, kpis.kpi_30day_summary, kpis.gmv_by_day, kpis.gmv_by_month, kpis.top_sellers):
        plan(tables)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) == []
