"""Small frames and plan text for the tests."""

from __future__ import annotations

import contextlib
import io

from souk.sources.raw import RAW_COLUMNS


def frame(spark, schema: str, *rows):
    return spark.createDataFrame(list(rows), schema)


def raw(spark, name: str, *rows: dict):
    """A raw text table; columns not given are NULL."""
    columns = RAW_COLUMNS[name].split()
    return spark.createDataFrame(
        [tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)
    )


def values(df, *columns):
    """Sorted rows as tuples, NULL first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def column(spark, expression, value, kind="string"):
    """Evaluate a column expression over one value named x."""
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]
