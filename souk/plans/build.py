"""A full build: every model in order, its checks after it, and the run log at the end."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from souk.operators.quality import Check, summarize
from souk.plans.audit import AuditLog
from souk.plans.warehouse import CATALOG, UpstreamMissing, Warehouse

PACKAGE = "souk"


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Run:
    """Collects the log rows of one build."""

    def __init__(self, run_id: str, git_sha: str):
        self.id, self.git_sha, self.started = run_id, git_sha, _now()
        self.rows: list[tuple] = []

    def record(
        self,
        kind: str,
        name: str,
        began: datetime,
        status: str,
        message: str = "",
        rows: int = 0,
        ended: datetime | None = None,
    ) -> None:
        ended = ended or _now()
        millis = int((ended - began).total_seconds() * 1000)
        node = f"{kind}.{PACKAGE}.{name}"
        self.rows.append(
            (self.id, self.git_sha, self.started, began, ended, millis, node, name, kind, PACKAGE, status, message, rows)
        )


def _layer(layer: str, but: str = "") -> list[str]:
    return [n for n, m in CATALOG.items() if m.layer == layer and n != but]


# Models of one wave do not read each other. The checks of a wave run before the next one.
# The core layer starts with the facts, which take longest.
WAVES: list[list[str]] = [
    _layer("staging"),
    ["int_orders_clean"],
    ["int_returns_classified", *sorted(_layer("core", but="fct_returns"), key=lambda n: n.startswith("dim_"))],
    ["fct_returns"],
    _layer("analytics"),
]


def _run_checks(warehouse: Warehouse, run: Run, checks: Sequence[Check]) -> None:
    """Record the checks and withhold tables that fail an error-level one.

    They run as one job, whose time is shared out evenly. Checks on tables that could not
    be built are recorded as skipped.
    """
    began = _now()
    runnable = [c for c in checks if not warehouse.is_withheld(c.table, c.parent)]
    for c in checks:
        if c not in runnable:
            run.record("test", c.name, began, "skipped")
    if not runnable:
        return
    results = summarize(warehouse, runnable, warehouse.params).collect()
    share = (_now() - began) / len(results)
    for at, r in enumerate(results):
        found = f"{r['failures']} failures" if r["failures"] else ""
        start = began + at * share
        run.record("test", r["check"], start, r["status"], found, r["failures"], start + share)
        if r["status"] == "fail":
            warehouse.withhold(r["table"])


def _build_model(warehouse: Warehouse, run: Run, name: str) -> None:
    began = _now()
    try:
        _ = warehouse[name]
    except UpstreamMissing as e:
        run.record("model", name, began, "skipped", str(e))
        warehouse.withhold(name)
    except Exception as e:  # a failing model must not stop unrelated ones
        run.record("model", name, began, "error", str(e))
        warehouse.withhold(name)
    else:
        run.record("model", name, began, "success", rows=warehouse.rows.get(name, 0))


def run_pipeline(
    warehouse: Warehouse,
    checks: Sequence[Check],
    log: AuditLog,
    run_id: str | None = None,
    threads: int = 8,
    rejects: DataFrame | None = None,
) -> DataFrame:
    """Build all models and return this run's log rows.

    A model that fails, or whose error-level checks fail, is withheld: models that need it
    are skipped and everything else is still built. Models of a wave are submitted side by
    side, so that small tables fill the gaps large ones leave on the cluster. ``rejects`` are
    malformed lines (table, line): they are written to ``rejects`` below the warehouse and logged
    as warnings.
    """
    log.ensure()
    run = Run(run_id or str(uuid.uuid4()), os.environ.get("GIT_SHA", "unknown"))
    if rejects is not None:
        began = _now()
        rejects.write.mode("overwrite").parquet(f"{warehouse.root}/rejects")
        for r in warehouse.spark.read.schema(rejects.schema).parquet(f"{warehouse.root}/rejects").groupBy("table").count().collect():
            run.record("test", f"readable_raw_{r['table']}", began, "warn", f"{r['count']} malformed lines", r["count"])
    _run_checks(warehouse, run, [c for c in checks if c.table.startswith("raw_")])
    with ThreadPoolExecutor(threads) as pool:
        for wave in WAVES:
            list(pool.map(lambda name: _build_model(warehouse, run, name), wave))
            _run_checks(warehouse, run, [c for c in checks if c.table in wave])
    warehouse.describe()
    log.append(run.rows)
    return log.read().where(f"run_id = '{run.id}'")
