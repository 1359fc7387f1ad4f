"""Ordered computations that never bring a whole group into one task.

A window over an entire table, or over one very large group, runs in a single task.
Here the rows are range-partitioned by the sort order into slices of similar size, each
slice is totalled, the totals are accumulated (one row per slice and group, so the table
has at most slices + groups rows), and a window inside each slice adds the remainder.
Sums are integers or decimals, so the result equals that of one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.session import settle

SLICE = "_slice"


def running_totals(
    df: DataFrame,
    order: list[Column],
    sums: dict[str, Column],
    by: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``<name>`` (sum up to and including the row) and ``<name>_total`` (whole group).

    ``order`` has to be a total order within a group; ``by`` names the group columns.
    """
    by = list(by or [])
    measures = {name: f"_m_{name}" for name in sums}
    staged = df.select("*", *[expr.alias(measures[name]) for name, expr in sums.items()])
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    ranged = staged.repartitionByRange(slices, *keys) if slices else staged.repartitionByRange(*keys)
    # The slice number is written out, so a recomputed task cannot renumber the rows.
    sliced = settle(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")
    totals = sliced.groupBy(*by, SLICE).agg(*[F.sum(m).alias(m) for m in measures.values()])
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    heads = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col(SLICE).alias("_k_slice"),
        *[F.sum(m).over(before).alias(f"_before{m}") for m in measures.values()],
        *[F.sum(m).over(group).alias(f"_all{m}") for m in measures.values()],
    )
    match = F.col(SLICE) == F.col("_k_slice")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    within = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sliced.join(heads, match, "left").select(
        *df.columns,
        *[
            (F.sum(m).over(within) + F.coalesce(F.col(f"_before{m}"), F.lit(0))).alias(name)
            for name, m in measures.items()
        ],
        *[F.col(f"_all{m}").alias(f"{name}_total") for name, m in measures.items()],
    )


def running(df: DataFrame, order: list[Column], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add columns computed over a row and all before it: ``name: (kind, expression)``.

    Kinds are ``sum``, ``max`` and ``last`` (the nearest value that is not NULL). ``order`` has to be total, up to rows that
    give equal results. One slice hands on to the next no more than one value per column.
    """
    staged = df.select("*", *[expr.alias(f"_m_{name}") for name, (_, expr) in columns.items()])
    sliced = settle(staged.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), "slices")
    within = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_k_slice").rowsBetween(Window.unboundedPreceding, -1)
    folds = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    numbered = sliced.withColumn("_place", F.row_number().over(Window.partitionBy(SLICE).orderBy(*order)))

    def total(kind: str, c: str) -> Column:
        if kind == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_place")))
        return folds[kind](c)

    totals = numbered.groupBy(F.col(SLICE).alias("_k_slice")).agg(*[total(kind, f"_m_{name}").alias(f"_t_{name}") for name, (kind, _) in columns.items()])
    heads = totals.select("_k_slice", *[folds[kind](f"_t_{name}").over(before).alias(f"_b_{name}") for name, (kind, _) in columns.items()])

    def joined(name: str, kind: str) -> Column:
        here, carried = folds[kind](f"_m_{name}").over(within), F.col(f"_b_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(here, carried) if kind == "max" else F.coalesce(here, carried)

    return sliced.join(heads, F.col(SLICE) == F.col("_k_slice"), "left").select(
        *df.columns, *[joined(name, kind).alias(name) for name, (kind, _) in columns.items()]
    )


#: Rows of a group that one task may number.
SMALL_GROUP = 100_000


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str, sizes: DataFrame | None = None) -> DataFrame:
    """Add a 1-based position within each group, however large a group is.

    Groups of up to ``SMALL_GROUP`` rows take one shuffle and a window; only larger ones are cut into slices. ``sizes`` has the
    number of rows of every group as ``n``, if they are known already.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")) if sizes is None else sizes
    large = settle(sizes.where(F.col("n") > SMALL_GROUP).select(*by), "large")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    if large.isEmpty():
        return df.withColumn(name, place)
    alike = F.lit(True)
    for c in by:
        alike = alike & F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}"))
    small = df.alias("d").join(large.alias("g"), alike, "left_anti").withColumn(name, place)
    sliced = df.alias("d").join(large.alias("g"), alike, "left_semi")
    return small.unionByName(running_totals(sliced, order, {name: F.lit(1).cast("bigint")}, by).drop(f"{name}_total"))


def exact_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Median of a decimal column per group as a double, without collecting any group.

    Equal values are counted first; the one or two middle values are then found from the
    running count. NULL values are ignored, as an aggregate would.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, [F.col(value).asc()], {"_upto": F.col("_n")}, by)
    total, upto = F.col("_upto_total"), F.col("_upto")
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1

    def holds(rank: Column) -> Column:
        return (upto - F.col("_n") < rank) & (rank <= upto)

    # Both ranks can fall on one value, so each row carries the weight it contributes.
    weight = holds(low).cast("int") + holds(high).cast("int")
    return (
        ranked.withColumn("_w", weight)
        .where(F.col("_w") > 0)
        .groupBy(*by)
        .agg((F.sum(F.col(value) * F.col("_w")).cast("double") / 2).alias(out))
    )


#: Share of the ranks on either side of the middle that a bracket takes in, and the size of the sketch. At this size a
#: sketch misses the rank it is asked for by more than a quarter of that share once in many thousand groups.
BRACKET, SKETCH = 0.005, 2048


def median_bracket(value: str) -> list[Column]:
    """Aggregates that say how many values a group has and between which two of them the middle lies, in all likelihood."""
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH)
    some = F.count(value) > 0
    edges = {"_low": 0.5 - BRACKET, "_high": 0.5 + BRACKET}
    found = [F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(rank))).alias(c) for c, rank in edges.items()]
    return [F.count(value).alias("_values"), *found]


def bracketed_median(df: DataFrame, brackets: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``exact_median`` in two passes: of each group only the values inside its bracket are sorted, the others are counted.

    ``brackets`` has the columns of ``median_bracket`` for every group, from a first pass over ``df``. A group whose middle lies
    outside its bracket is sorted whole, so results are exact whatever a sketch said.
    """
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
    number = F.col(f"d.{value}").cast("double")
    side = F.when(number < F.col("_low"), -1).when(number > F.col("_high"), 1).otherwise(0).alias("_side")
    cells = df.where(F.col(value).isNotNull()).alias("d").join(brackets.alias("b"), same)
    cells = cells.select(*[F.col(f"d.{c}").alias(c) for c in by], "_values", side, F.col(f"d.{value}").alias("_v"))
    inside = F.when(F.col("_side") == 0, F.col("_v")).alias("_v")
    counted = cells.groupBy(*by, "_values", "_side", inside).agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, [F.col("_side").asc(), F.col("_v").asc()], {"_upto": F.col("_n")}, by)
    weight = F.lit(0)
    for rank in (F.floor((F.col("_values") + 1) / 2), F.floor(F.col("_values") / 2) + 1):
        weight = weight + ((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))).cast("int")
    hit = F.sum(F.when(F.col("_side") == 0, F.col("_w"))).alias("_hit")
    middle = (F.sum(F.col("_v") * F.col("_w")).cast("double") / 2).alias(out)
    found = settle(ranked.withColumn("_w", weight).groupBy(*by).agg(hit, middle), "medians")
    missed = found.where(F.coalesce("_hit", F.lit(0)) < 2).select(*by)
    found = found.where("_hit = 2").drop("_hit")
    if missed.isEmpty():
        return found
    alike = F.lit(True)
    for c in by:
        alike = alike & F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}"))
    whole = df.alias("d").join(missed.alias("m"), alike, "left_semi")
    return found.unionByName(exact_median(whole, by, value, out))


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in the given order.

    Spark turns the rank filter into a per-task limit ahead of the shuffle, so a hot
    group sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
