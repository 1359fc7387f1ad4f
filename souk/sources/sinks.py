"""Where finished models go: Parquet tables, temporary views and the append-only log."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from souk.sources.versions import VersionedTable


def table_path(root: str, layer: str, name: str) -> str:
    return f"{root}/{layer}/{name}"


def write_table(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    partition_by: str | None = None,
    zones: Collection[str] = (),
) -> DataFrame:
    """Replace a layer table by a new version and return a frame that reads it."""
    table = VersionedTable(df.sparkSession, table_path(root, layer, name), partition_by, zones)
    return table.read(table.commit(df))


def register_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
