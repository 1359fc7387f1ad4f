"""The model catalogue and the lazily built warehouse."""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from souk.functions.columns import month_of
from souk.operators import dimensions, facts, intermediate, marts, staging
from souk.operators.rollups import STATES, refresh, rollup_table
from souk.operators.upsert import ZONES, load_orders, order_table, visible
from souk.params import Params
from souk.session import settle, workspace
from souk.sources import files
from souk.sources.sinks import register_view, table_path
from souk.sources.versions import Manifest, VersionedTable

#: File below a warehouse that names the version of every table of the last build, and its settings.
ABOUT = "about.json"


@dataclass(frozen=True)
class Model:
    """A named table: its layer, its builder and how it is kept.

    ``kept`` is table, incremental, inline or view. ``month_from`` names a date column whose
    month becomes the partition ``order_month``. ``zones`` are columns whose greatest value is known without a scan.
    """

    name: str
    layer: str
    build: Callable[[Mapping[str, DataFrame], Params], DataFrame]
    kept: str = "table"
    month_from: str | None = None
    zones: tuple[str, ...] = ()

    @property
    def stored(self) -> bool:
        return self.kept in ("table", "incremental")


#: The column that tells how fresh a staging table is.
LOADED_AT = {"stg_payments": ("paid_at",)}


def _models(module, layer: str, names: str, kept: str = "table") -> list[Model]:
    return [Model(n, layer, getattr(module, n), kept, zones=LOADED_AT.get(n, ())) for n in names.split()]


def stored_table(spark: SparkSession, root: str, model: Model) -> VersionedTable:
    path = table_path(root, model.layer, model.name)
    if model.kept == "incremental":
        return order_table(spark, path)
    return VersionedTable(spark, path, "order_month" if model.month_from else None, model.zones)


# In build order: every model only reads models above it.
CATALOG: dict[str, Model] = {
    m.name: m
    for m in [
        *_models(
            staging,
            "staging",
            "stg_orders stg_order_items stg_payments stg_returns stg_reviews stg_shipping_events "
            "stg_mkt_customers stg_sellers stg_products stg_categories stg_geography stg_dates "
            "stg_carriers stg_payment_methods stg_return_reasons stg_promotions",
        ),
        # Five facts read the cleaned orders, so they are written once instead of inlined.
        *_models(intermediate, "intermediate", "int_orders_clean"),
        *_models(intermediate, "intermediate", "int_returns_classified", "inline"),
        *_models(
            dimensions,
            "core",
            "dim_mkt_customer dim_seller dim_product dim_category dim_geography dim_date "
            "dim_carrier dim_payment_method dim_return_reason dim_promotion",
        ),
        Model("fct_orders", "core", facts.fct_orders, "incremental", "order_date", ZONES),
        Model("fct_order_items", "core", facts.fct_order_items, month_from="order_date"),
        *_models(facts, "core", "fct_payments fct_returns fct_reviews fct_shipping_events"),
        *_models(
            marts,
            "analytics",
            "category_region_return_rate gmv_by_promotion sla_by_carrier customer_cohort_retention "
            "pareto_sellers growth_metrics_monthly customer_ltv_by_segment",
        ),
        *_models(marts, "analytics", "pipeline_health", "view"),
    ]
}


class UpstreamMissing(Exception):
    """A model needs a table that was withheld."""


class Warehouse(Mapping):
    """Tables by name. A model is built when first asked for and written once.

    ``raw`` maps a raw table name to its frame; ``extra`` adds tables that are not models,
    such as the audit log. With ``stored`` off every model stays a plan. An incremental
    model adds to the table an earlier build left at ``root``, unless ``full_refresh``.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: Callable[[str], DataFrame],
        params: Params | None = None,
        root: str | None = None,
        extra: Mapping[str, Callable[[], DataFrame]] | None = None,
        stored: bool = True,
        full_refresh: bool = False,
    ):
        self.spark = spark
        self.params = params or Params()
        self.root = root or f"{workspace(spark)}/warehouse"
        self.stored, self.full_refresh = stored, full_refresh
        self._raw = raw
        self._extra = dict(extra or {})
        self._tables: dict[str, DataFrame] = {}
        self._manifests: dict[str, Manifest] = {}
        self._rollups: dict[str, Manifest] = {}
        self._steps: dict[str, DataFrame] = {}
        self.rows: dict[str, int] = {}
        self._withheld: set[str] = set()
        self._locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)

    def withhold(self, name: str) -> None:
        """Stop serving a table, because it failed or failed its checks."""
        self._withheld.add(name)

    def is_withheld(self, *names: str) -> bool:
        return any(name in self._withheld for name in names)

    def build(self, name: str) -> DataFrame:
        """The model's own plan over its stored inputs, not stored itself."""
        return CATALOG[name].build(self, self.params)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._withheld:
            raise UpstreamMissing(f"{name} is not available")
        if name in self._extra or (name in CATALOG and CATALOG[name].kept == "view"):
            # Read anew each time, so that rows appended meanwhile are seen.
            return self._resolve(name)
        if name not in self._tables:
            with self._locks[name]:
                if name not in self._tables:
                    self._tables[name] = self._resolve(name)
        return self._tables[name]

    def _resolve(self, name: str) -> DataFrame:
        if name.startswith("raw_"):
            return self._raw(name.removeprefix("raw_"))
        if name in self._extra:
            return self._extra[name]()
        model = CATALOG[name]
        if model.kept == "inline" or not (self.stored and model.stored):
            df = self.build(name)
            return register_view(df, name) if model.kept == "view" else df
        table = stored_table(self.spark, self.root, model)
        if model.kept == "incremental" and not self.full_refresh:
            df = load_orders(self, self.params, self.spark, table.path, lambda n: self.rows.update({name: n}))
            self._manifests[name] = table.manifest()
            return df
        df = self.build(name)
        if model.month_from:
            df = df.withColumn("order_month", month_of(model.month_from))
        now = self._manifests[name] = table.commit(df)
        self.rows[name] = now.rows()
        return visible(table.read(now))

    def span(self, name: str, column: str) -> tuple | None:
        """Least and greatest value of a column of a stored table, None if they are not known without a scan."""
        _ = self[name]
        return self._manifests[name].span(column) if name in self._manifests else None

    def rollup(self, name: str) -> DataFrame | None:
        """Maintained partial sums of the order fact, brought up to date; None where tables are not stored."""
        if not self.stored:
            return None
        _ = self["fct_orders"]
        orders = stored_table(self.spark, self.root, CATALOG["fct_orders"])
        with self._locks[f"rollup {name}"]:
            if name not in self._rollups:
                self._rollups[name] = refresh(orders, self._manifests["fct_orders"], name)
        return rollup_table(orders, name).read(self._rollups[name])

    def once(self, name: str, df: DataFrame) -> DataFrame:
        """A step that several models read, written when the first of them asks for it; a plan where tables are not stored."""
        if not self.stored:
            return df
        with self._locks[f"step {name}"]:
            if name not in self._steps:
                self._steps[name] = settle(df, name)
        return self._steps[name]

    def describe(self) -> None:
        """Write down which versions make up this build, and its settings, for ``StoredTables``.

        The file is replaced in one step, so readers see all tables of one build.
        """
        settings = {k: v for k, v in asdict(self.params).items() if isinstance(v, (int, bool))}
        about = {"settings": settings, "versions": {name: m.version for name, m in self._manifests.items()}}
        if "fct_orders" in self._manifests and not self.is_withheld("fct_orders"):
            for name in STATES:
                self.rollup(name)
        about["rollups"] = {name: m.version for name, m in self._rollups.items()}
        files.switch_text(self.spark, f"{self.root}/{ABOUT}", json.dumps(about))

    def __iter__(self) -> Iterator[str]:
        return iter(CATALOG)

    def __len__(self) -> int:
        return len(CATALOG)


class StoredTables(Mapping):
    """The tables an earlier build left at ``root``, read only. Views are computed on reading.

    Versions and settings come from what the build wrote down, in one read at the start, and frames are kept, so asking
    for a table starts no job. A build under way does not change what is read, the next one but one does: ``refresh``.
    """

    def __init__(
        self, spark: SparkSession, root: str, extra: Mapping[str, Callable[[], DataFrame]] | None = None
    ):
        self.spark, self.root, self._extra = spark, root, dict(extra or {})
        self._tables: dict[str, DataFrame] = {}
        self._manifests: dict[str, Manifest] = {}
        self.refresh()

    def refresh(self) -> None:
        """Read again what the last build wrote down."""
        written = files.read_text(self.spark, f"{self.root}/{ABOUT}")
        if written is None:
            raise FileNotFoundError(f"no finished build at {self.root}")
        about = json.loads(written)
        self.params = Params(**about["settings"])
        self._versions: dict[str, int] = about["versions"]
        self._rollups: dict[str, int] = about["rollups"]
        self._tables.clear()
        self._manifests.clear()

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._extra:
            return self._extra[name]()
        model = CATALOG[name]
        if not model.stored:
            return model.build(self, self.params)
        if name not in self._tables:
            table = stored_table(self.spark, self.root, model)
            self._manifests[name] = table.manifest(self._versions[name])
            self._tables[name] = visible(table.read(self._manifests[name]))
        return self._tables[name]

    def span(self, name: str, column: str) -> tuple | None:
        """Least and greatest value of a column of a stored table, None if they are not known without a scan."""
        _ = self[name]
        return self._manifests[name].span(column) if name in self._manifests else None

    def rollup(self, name: str) -> DataFrame | None:
        """Partial sums of the order fact as of the last build, None if it kept none."""
        if name not in self._rollups:
            return None
        table = rollup_table(stored_table(self.spark, self.root, CATALOG["fct_orders"]), name)
        if f"rollup {name}" not in self._tables:
            self._tables[f"rollup {name}"] = table.read(table.manifest(self._rollups[name]))
        return self._tables[f"rollup {name}"]

    def __iter__(self) -> Iterator[str]:
        return iter(CATALOG)

    def __len__(self) -> int:
        return len(CATALOG)
