"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size. Sorting the blocks gives every distinct block an
integer name; then adjacent names are paired and the pairs are sorted and named, until one name
is left per document (Karp, Miller and Rosenberg 1972). Names are positions in a sort order, so
two texts share their last name only if they are equal: no hash is compared.

Sorting is a range partitioning by block *and* row, so one block that fills a third of the table
is spread over many tasks. Equal blocks that meet a slice border are recognised by comparing the
first block of a slice with the last one before it, in a table of two rows per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import SPACES, whole_text
from souk.session import settle

BLOCK = 1024
_HEAD = "doc_id bigint, sha string"


def _runs(keys: list[str]):
    """Number the runs of equal keys in one sorted slice; mark its first row, add one row for its last key."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, run, slice_no = None, -1, 0
        for rows in batches:
            if rows.empty:
                continue
            new = np.zeros(len(rows), bool)
            for k in keys:
                column = rows[k].to_numpy()
                new[1:] |= column[1:] != column[:-1]
            new[0] = last is None or tuple(rows[k].iloc[0] for k in keys) != last
            numbers = run + np.cumsum(new)
            edge = np.zeros(len(rows), np.int8)
            edge[0] = last is None
            # Only the first block of a slice is looked at again, so no other text is written out.
            marks = {k: rows[k].where(edge == 1, None) if k == "block" else rows[k] for k in keys}
            slice_no, run = int(rows["slice"].iloc[0]), int(numbers[-1])
            last = tuple(rows[k].iloc[-1] for k in keys)
            yield rows.drop(columns=keys).assign(**marks, run=numbers, edge=edge)
        if last is not None:
            final = {k: [v] for k, v in zip(keys, last)}
            yield pd.DataFrame({"row": [-1], "pos": [-1], "n": [0], "head": [None], "slice": [slice_no], **final, "run": [run], "edge": [2]})

    return number


def _hash(key: Column | str) -> Column:
    return F.xxhash64(key)


def _bases(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(slice, base, clash): the name of each slice's first run, from the two edge rows of every slice.

    A clash is a border inside one hash at which two different blocks meet: there equal blocks may lie apart.
    """
    edge = runs.where("edge > 0").select("slice", "edge", "run", F.struct(*keys).alias("key"))
    first = edge.where("edge = 1").select("slice", F.col("key").alias("first"))
    slices = edge.where("edge = 2").select("slice", "run", F.col("key").alias("last")).join(first, "slice")
    # One small row per slice, so one task takes them all.
    line = Window.orderBy("slice")
    before = F.lag("last").over(line)
    slices = slices.withColumn("fresh", (before.isNotNull() & (before != F.col("first"))).cast("int"))
    slices = slices.withColumn("clash", F.coalesce((F.col("fresh") == 1) & (_hash(before) == _hash(F.col("first"))), F.lit(False)))
    base = F.sum(F.col("run") + F.col("fresh")).over(line) - F.col("run")
    return slices.select("slice", base.alias("base"), "clash")


def _named(rows: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Replace the key columns by one integer name per distinct key, in one order of the keys.

    Blocks are ordered by a hash first, so the sample that finds the slices holds no text. Where two blocks of one hash
    meet at the border of a slice, the order is that of the blocks themselves.
    """
    blocks = keys == ["block"]
    sampled = [_hash("block")] if blocks and not exact else [F.col(c) for c in keys]
    place = [F.col("row"), F.col("pos")]
    kinds = "string" if blocks else "bigint"
    rows = rows.select("row", "pos", "n", F.to_json("head").alias("head"), *keys)
    sliced = rows.repartitionByRange(*sampled, *place).sortWithinPartitions(*sampled, *keys, *place).withColumn("slice", F.spark_partition_id())
    schema = f"row bigint, pos bigint, n bigint, head string, slice int, {', '.join(f'{k} {kinds}' for k in keys)}, run bigint, edge tinyint"
    runs = settle(sliced.mapInPandas(_runs(keys), schema), "names")
    at = settle(_bases(runs, keys), "bases")
    if blocks and not exact and not at.where("clash").isEmpty():
        return _named(rows.withColumn("head", F.from_json("head", _HEAD)), keys, exact=True)
    return runs.where("edge < 2").join(at, "slice").select(
        "row",
        "pos",
        "n",
        F.from_json("head", _HEAD).alias("head"),
        (F.col("base") + F.col("run")).alias("name"),
    )


def block_identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, text_sha256, level, name): rows share (level, name) exactly if their texts are equal.

    Texts are equal after each run of white space has become one space; NULL counts as empty.
    ``row`` numbers the rows of this result and is not stable between calls.
    """
    text = F.regexp_replace(whole_text(), SPACES, " ")
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t"))
    blocks = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(blocks)
    cut = cut.select("row", F.struct("doc_id", F.sha2("t", 256).alias("sha")).alias("head"), blocks.alias("blocks"))
    cut = cut.select("row", "head", F.size("blocks").cast("bigint").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    # The head travels with the first block only.
    head = F.when(F.col("pos") == 0, F.col("head")).alias("head")
    named = _named(cut.select("row", F.col("pos").cast("bigint").alias("pos"), "n", head, "block"), ["block"])
    level, done = 0, None
    while True:
        ready = named.where("n = 1").select(
            "row", "head.doc_id", F.col("head.sha").alias("text_sha256"), F.lit(level).alias("level"), "name"
        )
        done = ready if done is None else done.unionByName(ready)
        longer = named.where("n > 1")
        if longer.isEmpty():
            return done
        # Names are at least 0, so -1 stands for the missing right half of an odd last block.
        pairs = longer.groupBy("row", F.floor(F.col("pos") / 2).alias("at")).agg(
            F.max("n").alias("n"),
            F.max(F.when(F.col("pos") == 0, F.col("head"))).alias("head"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        half = F.ceil(F.col("n") / 2).alias("n")
        named = _named(pairs.select("row", F.col("at").alias("pos"), half, "head", "left", "right"), ["left", "right"])
        level += 1


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; a NULL doc_id comes after all others,
    and of rows with equal doc_id and equal text one stays. Empty and NULL texts form one group.
    Other columns are not read. No rows give no rows.
    """
    ids = settle(block_identities(docs, block), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    groups = settle(ids.groupBy("level", "name").agg(F.count("*").alias("group_size"), first), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Kept rows are found again by doc_id and text. Only a row repeated with the same doc_id needs
    more: its repeats are reduced to one by an aggregate that combines within each task.
    """
    groups = exact_groups(docs, block)
    stays = groups.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("_llm_kept"), F.count("*").alias("_llm_n"))
    stays = settle(stays.where("_llm_kept").drop("_llm_kept"), "stays").select(
        F.col("doc_id").alias("_llm_id"), F.col("text_sha256").alias("_llm_sha"), "_llm_n"
    )
    sha = F.sha2(F.regexp_replace(whole_text(), SPACES, " "), 256)
    match = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (sha == F.col("_llm_sha"))
    kept = docs.join(stays, match)
    repeated = kept.where("_llm_n > 1").groupBy("_llm_id", "_llm_sha")
    one = repeated.agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_llm_row")).select("_llm_row.*")
    return kept.where("_llm_n = 1").select(*docs.columns).unionByName(one)
