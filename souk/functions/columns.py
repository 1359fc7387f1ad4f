"""Column expressions shared by the models. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
MONEY = "decimal(38,2)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- cleaning ---------------------------------------------------------------


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def upper_trim(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


def seller_key(c: str | Column) -> Column:
    """Seller ids arrive with either separator and any case: ``seller_0001`` -> ``SELLER-0001``."""
    return F.upper(F.replace(F.trim(col(c)), F.lit("_"), F.lit("-")))


def to_int(c: str | Column) -> Column:
    """Text to int; fractions round half up and anything else unreadable is NULL. Only what is no plain integer is read as a decimal."""
    return F.coalesce(col(c).try_cast("int"), F.round(col(c).try_cast("decimal(38,10)"), 0).try_cast("int"))


def to_decimal(c: str | Column, precision: int = 12, scale: int = 2) -> Column:
    return col(c).try_cast(f"decimal({precision},{scale})")


def to_flag(c: str | Column) -> Column:
    return col(c).try_cast("boolean")


def to_flag_strict(c: str | Column) -> Column:
    """Boolean that fails the build on unreadable text, with or without ANSI mode."""
    text = col(c)
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean")
    return F.coalesce(to_flag(text), F.when(text.isNotNull(), bad))


def to_day(c: str | Column) -> Column:
    """ISO date or NULL. Guards against Spark reading ``2024`` or ``2024-05`` as a date."""
    return F.when(col(c).rlike(ISO_DAY), col(c).try_cast("date"))


def to_mixed_day(c: str | Column) -> Column:
    """ISO first, then the legacy day/month/year form, padded or not; else NULL."""
    return F.coalesce(to_day(c), F.try_to_date(F.trim(col(c)), "d/M/yyyy"))


def to_instant(c: str | Column) -> Column:
    return F.when(col(c).rlike(ISO_DAY), col(c).try_cast("timestamp_ntz"))


def reshuffled(key: str) -> Column:
    """The same text key, no longer recognised as the column a table is partitioned by.

    Adaptive execution splits a hot join partition only if both sides come straight from a
    shuffle of their own. An aggregate on the join key would be joined where it was
    computed; selecting its key through this gives it a shuffle, of one row per key.
    """
    return F.concat(F.col(key), F.lit("")).alias(key)


# ---- calendar arithmetic ----------------------------------------------------


def month_of(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start)).cast("bigint")


def hours_crossed(start: str | Column, end: str | Column) -> Column:
    """Hour boundaries crossed: 10:59 to 11:01 counts as one."""
    a, b = col(start), col(end)
    return (F.datediff(b, a) * 24 + F.hour(b) - F.hour(a)).cast("bigint")


def months_crossed(start: str | Column, end: str | Column) -> Column:
    a, b = col(start), col(end)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")


# ---- measures ---------------------------------------------------------------


def flag_sum(condition: Column) -> Column:
    """Rows where the condition holds; NULL conditions count as no."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def money_sum(c: str | Column) -> Column:
    return F.sum(col(c)).cast(MONEY)


def long_sum(c: str | Column) -> Column:
    return F.sum(col(c)).cast("bigint")


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Double quotient; NULL when the denominator is zero."""
    below = col(denominator).cast("double")
    return col(numerator).cast("double") / F.nullif(below, F.lit(0.0))


def mean(c: str | Column) -> Column:
    """Average as a double from an exact sum, so the result does not depend on row order."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def zero_if_null(c: str | Column, kind: str = "bigint") -> Column:
    return F.coalesce(col(c), F.lit(0)).cast(kind)
