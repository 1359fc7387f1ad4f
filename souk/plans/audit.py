"""The run log: one row per model or check and run, appended to a Parquet table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from souk.sources.sinks import append_rows

AUDIT_SCHEMA = (
    "run_id string, git_sha string, invocation_at timestamp_ntz, started_at timestamp_ntz, "
    "completed_at timestamp_ntz, duration_ms bigint, node_id string, node_name string, "
    "resource_type string, package_name string, status string, message string, rows_affected bigint"
)


class AuditLog:
    """Append-only log at ``path``; created empty so that readers find it before the first run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ensure(self) -> AuditLog:
        try:
            self.read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            append_rows(self.spark.createDataFrame([], AUDIT_SCHEMA), self.path)
        return self

    def append(self, rows: DataFrame | Iterable[tuple]) -> None:
        if not isinstance(rows, DataFrame):
            # A run has as many rows as there are models and checks.
            rows = self.spark.createDataFrame(list(rows), AUDIT_SCHEMA).coalesce(1)
        append_rows(rows, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(AUDIT_SCHEMA).parquet(self.path)
