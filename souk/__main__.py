"""Build the warehouse from a folder of raw CSV files.

    spark-submit souk/__main__.py RAW_DIR WAREHOUSE_DIR [--as-of 2024-12-31] [--full-refresh]
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import SparkSession

from souk.operators.quality import declared_checks
from souk.params import Params
from souk.plans.audit import AuditLog
from souk.plans.build import run_pipeline
from souk.plans.warehouse import Warehouse
from souk.session import size_shuffles
from souk.sources.raw import MULTI_LINE, csv_source


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="souk")
    parser.add_argument("raw_dir")
    parser.add_argument("warehouse_dir")
    parser.add_argument("--as-of", type=date.fromisoformat, help="stands in for today")
    parser.add_argument("--return-window", type=int, default=30, help="days")
    parser.add_argument("--lookback", type=int, help="load only orders after the newest one loaded, less so many days")
    parser.add_argument(
        "--multi-line", nargs="*", default=MULTI_LINE, metavar="TABLE", help="raw tables whose quoted fields may hold line breaks"
    )
    parser.add_argument("--full-refresh", action="store_true", help="rebuild the incremental order fact")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("souk").getOrCreate()
    size_shuffles(spark, args.raw_dir)
    params = Params(as_of_date=args.as_of, return_window_days=args.return_window, lookback_days=args.lookback)
    log = AuditLog(spark, f"{args.warehouse_dir}/audit/runs")
    source = csv_source(spark, args.raw_dir, args.multi_line)
    tables = Warehouse(
        spark,
        source,
        params,
        root=args.warehouse_dir,
        extra={"audit_runs": log.read},
        full_refresh=args.full_refresh,
    )
    run = run_pipeline(tables, declared_checks(), log, rejects=source.rejects())
    told = run.where("status in ('error', 'fail', 'skipped', 'warn')").select("node_name", "status", "message").collect()
    for row in told:
        print(f"{row['status']:8} {row['node_name']} {row['message']}", file=sys.stderr)
    return 1 if any(row["status"] != "warn" for row in told) else 0


if __name__ == "__main__":
    raise SystemExit(main())
