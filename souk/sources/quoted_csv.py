"""CSV whose quoted fields hold line breaks, read by many tasks.

A byte range of such a file cannot tell by itself whether it begins inside quotes. But a line is a function of two
states: it says whether its end lies inside quotes if its beginning lies outside, and if it lies inside. Most lines
change nothing; the others set the state whatever it was, or turn it round. Such functions compose, so each split of
a file is reduced to one of them, the splits of a file are composed in order (one row per split), and every split then knows
its first state. From there on the lines at which a record with line breaks opens and closes are known in every
split, and only the lines of such records are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from souk.session import release, settle

# Of a line: at the start of a field, in an unquoted one, in a quoted one, after a quote there, after a closed one.
START, PLAIN, QUOTED, QUOTE, AFTER = range(5)
# The state after a quote, a comma, or other text; a quote that neither ends a field nor is doubled makes it a plain one.
STEPS = [
    *(QUOTED, START, PLAIN),
    *(PLAIN, START, PLAIN),
    *(QUOTE, QUOTED, QUOTED),
    *(QUOTED, START, AFTER),
    *(AFTER, START, AFTER),
]


def _ends_inside(line: Column, begin: int) -> Column:
    """Whether the end of a line lies inside quotes, if its beginning is in that state."""
    pieces = F.regexp_extract_all(line, F.lit(r'"|,|[^",]+'), F.lit(0))
    steps = F.array(*[F.lit(s) for s in STEPS])
    kind = lambda piece: F.when(piece == '"', 1).when(piece == ",", 2).otherwise(3)
    return F.aggregate(pieces, F.lit(begin), lambda state, piece: F.element_at(steps, state * 3 + kind(piece))) == QUOTED


def _odd(n: Column) -> Column:
    return n % 2 == 1


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, id, value): all lines as they are, a carriage return included.

    Ids rise by one from line to line of a split. They are written out, so a recomputed task cannot change them.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return settle(lines.select(*place, F.monotonically_increasing_id().alias("id"), "value"), "lines")


def _split_states(lines: DataFrame, quoted: DataFrame) -> DataFrame:
    """(file, split, low, high, inside): the ids of each split, and whether it begins inside quotes."""
    effect = quoted.groupBy("file", "split").agg(F.max_by(F.struct("fixed", "turns"), "id").alias("e"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    splits = splits.join(effect, ["file", "split"], "left").select(
        "file",
        "split",
        "low",
        "high",
        F.col("e.fixed.state").alias("state"),
        F.coalesce(F.col("e.turns") - F.coalesce("e.fixed.turns", F.lit(0)), F.lit(0)).alias("turned"),
    )
    in_file = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("upto", F.sum("turned").over(in_file))
    known = F.when(F.col("state").isNotNull(), F.struct("state", (F.col("upto") - F.col("turned")).alias("at")))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(known, ignorenulls=True).over(before)
    turned = F.coalesce(F.col("upto") - F.col("turned") - F.coalesce(last["at"], F.lit(0)), F.lit(0))
    inside = F.coalesce(last["state"], F.lit(False)) != _odd(turned)
    return splits.select("file", "split", "low", "high", inside.alias("inside"))


def _members(lines: DataFrame) -> DataFrame:
    """(id, record): the lines of records that have more than one, with the id of the record's first line."""
    place = Window.partitionBy("file", "split").orderBy("id")
    effect = lines.where(F.contains("value", F.lit('"'))).select(
        "file", "split", "id", _ends_inside(F.col("value"), START).alias("from_out"), _ends_inside(F.col("value"), QUOTED).alias("from_in")
    )
    # A line that ends alike from both states fixes the state; one that ends in the other state from either turns it.
    effect = effect.withColumn("turns", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(place))
    fixes = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), "turns"))
    quoted = effect.withColumn("fixed", F.last(fixes, ignorenulls=True).over(place)).drop("from_out", "from_in")
    splits = _split_states(lines, quoted)
    after = F.coalesce(F.col("fixed.state"), F.col("inside")) != _odd(F.col("turns") - F.coalesce("fixed.turns", F.lit(0)))
    states = quoted.join(splits, ["file", "split"]).withColumn("after", after)
    states = states.withColumn("before", F.coalesce(F.lag("after").over(place), F.col("inside")))
    events = states.where(F.col("before") != F.col("after")).select("file", "split", "id", "high", F.col("after").alias("opens"))
    own = events.withColumn("end", F.coalesce(F.lead("id").over(place), F.col("high"))).where("opens")
    own = own.select(F.col("id").alias("record"), F.col("id").alias("begin"), "end")
    # A record that came in from an earlier split goes on to the first event, or through the whole split.
    edges = events.groupBy("file", "split").agg(F.min("id").alias("first"), F.max(F.when(F.col("opens"), F.col("id"))).alias("open"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    came = splits.join(edges, ["file", "split"], "left").withColumn("record", F.last("open", ignorenulls=True).over(earlier))
    came = came.where("inside").select("record", F.col("low").alias("begin"), F.coalesce("first", "high").alias("end"))
    return own.unionByName(came).select(F.explode(F.sequence("begin", "end")).alias("id"), "record")


def quoted_records(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(file, split, id, value): one row per record with its whole text; place and id are those of its first line."""
    single = lines.join(members, "id", "left_anti")
    many = lines.join(members, "id").groupBy("record", "file")
    parts = F.array_sort(F.collect_list(F.struct("split", "id", "value")))
    whole = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    many = many.agg(F.min("split").alias("split"), whole.alias("value")).withColumnRenamed("record", "id")
    return single.unionByName(many.select(*single.columns))


def read_quoted_csv(spark: SparkSession, path: str, schema: StructType, corrupt: str) -> DataFrame:
    """The rows of CSV files with a header that names the columns of ``schema`` in order.

    Equal to Spark's reading of whole files with ``multiLine``: quotes inside quoted fields are doubled, empty lines are left out,
    and a record with another number of fields stands whole in the column ``corrupt``. The rows are written out once, as
    several readers follow.
    """
    lines = text_lines(spark, path)
    names = [f.name for f in schema.fields if f.name != corrupt]
    heads = lines.where("split = 0").groupBy("file").agg(F.min("id").alias("id"))
    heads = heads.select("id", F.lit(True).alias("head"))
    record = F.regexp_replace("value", "\r$", "")
    found = lambda line: F.lower(F.regexp_replace(line, '[﻿"\r]', ""))
    wrong = F.raise_error(F.concat(F.lit(f"header of {path} does not name the columns {names}: "), F.col("value")))
    is_row = F.when(F.col("head").isNull(), True).when(found(F.col("value")) == ",".join(names).lower(), False).otherwise(wrong.cast("boolean"))
    # A file begins outside quotes, so if no line that begins outside ends inside, every line is a record.
    opening = lines.where(F.contains("value", F.lit('"')) & _ends_inside(F.col("value"), START))
    members = None if opening.isEmpty() else settle(_members(lines), "members")
    records = lines if members is None else quoted_records(lines, members)
    rows = records.join(heads, "id", "left").where(is_row)
    rows = rows.where(F.col("value").rlike(r"[^\r]")).select(record.alias("value"))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": corrupt}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    found = settle(rows.select(F.from_csv("value", ddl, options).alias("r")).select("r.*"), "records")
    release(lines)
    if members is not None:
        release(members)
    return found
