"""Points against closed intervals, without pairs: how many intervals hold a point, and which of them began first.

Starts, ends and points are put in one order of time. Running along it, the number of open intervals is a running sum. The
first one that is still open needs no set of open ones either: in the order of their beginnings, an interval is ever the first only if it ends
later than all before it, and then from the end of those on. These intervals follow one another, so the last that took
over before a point is the one to credit. Both are carried from slice to slice of the order, one value each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.ordered import running

# What happens at one time, in this order: intervals begin, points are looked at, intervals end.
BEGIN, POINT, END = 0, 1, 2


def first_open(points: DataFrame, at: str, intervals: DataFrame, begin: str, end: str, key: str) -> DataFrame:
    """(at, n_open, first_open) for every distinct value of ``at``.

    ``n_open`` counts the intervals that hold the point, both ends included; ``first_open`` is the key of the one that began first, of equal
    ones the smallest key. Intervals without begin or end, or with the end before the begin, hold nothing. Values are of any type
    with an order, and of one type.
    """
    times = points.select(F.col(at).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    valid = intervals.where(F.col(begin) <= F.col(end)).select(F.col(key).alias("_key"), F.col(begin).alias("_begin"), F.col(end).alias("_end"))
    # Each interval is looked at just before its end counts, so it sees how far the intervals before it reach.
    asked = valid.withColumn("_phase", F.lit(0)).unionByName(valid.withColumn("_phase", F.lit(1)))
    counts = F.when(F.col("_phase") == 1, F.col("_end"))
    reach = running(asked, [F.col("_begin"), F.col("_key"), F.col("_phase")], {"_before": ("max", counts)})
    heads = reach.where("_phase = 0").where(F.col("_before").isNull() | (F.col("_end") > F.col("_before")))
    late = F.col("_before") >= F.col("_begin")
    kinds = dict(valid.dtypes)
    nothing = F.lit(None).cast(f"struct<end: {kinds['_end']}, key: {kinds['_key']}>")
    no_key = F.lit(None).cast(kinds["_key"])

    def event(df: DataFrame, time: Column, kind: Column, step: int, head: Column, tie: Column) -> DataFrame:
        return df.select(
            time.alias("_at"), kind.alias("_kind"), F.lit(step).cast("bigint").alias("_step"), head.alias("_head"), tie.alias("_tie")
        )

    takes = F.struct(F.col("_end").alias("end"), F.col("_key").alias("key"))
    events = (
        event(times, F.col("_at"), F.lit(POINT), 0, nothing, no_key)
        .unionByName(event(valid, F.col("_begin"), F.lit(BEGIN), 1, nothing, F.col("_key")))
        .unionByName(event(valid, F.col("_end"), F.lit(END), -1, nothing, F.col("_key")))
        .unionByName(event(heads, F.when(late, F.col("_before")).otherwise(F.col("_begin")), F.when(late, END).otherwise(BEGIN), 0, takes, F.col("_key")))
    )
    # Within one time and kind the order does not matter; the key spreads what happens at one moment over slices.
    swept = running(events, [F.col("_at"), F.col("_kind"), F.col("_tie")], {"n_open": ("sum", F.col("_step")), "_last": ("last", F.col("_head"))})
    first = F.when(F.col("_last.end") >= F.col("_at"), F.col("_last.key")).alias("first_open")
    return swept.where(F.col("_kind") == POINT).select(F.col("_at").alias(at), "n_open", first)
