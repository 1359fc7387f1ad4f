"""Mixing sources to target weights by hash-random order and exact word budgets.

Rows of a source are put in the order of a hash of their id and sorted by range, so a source that
holds a third of the table is spread over many slices. Distributed prefix sums of the word counts
say where in the order each row stands, and a row is taken as far as the budget of its source
reaches: whole epochs first, then the beginning of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import word_count
from souk.operators.ordered import running_totals
from souk.session import settle

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (1, 2, 3)
#: A source is repeated at most so often.
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): words each source is to give.

    Sources share the sum of all sizes by weight. A target stops at ``most`` times its source and
    the excess is shared anew among the rest, until no target is above; two sums per round come
    to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_totals(sizes, order, {"place": F.lit(1).cast("bigint")})
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    place = ((F.col("place") - 1) % len(weights)).cast("int")
    ranked = ranked.select("source", "source_size", F.get(cycle, place).alias("weight"))
    ranked = settle(ranked.withColumn("most", F.col("source_size") * most), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, before = 0.0, None
    while share != before:
        above = F.col("weight") * F.lit(share) > F.col("most")
        stopped, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        before, share = share, (total - stopped) / open_weight if open_weight else share
    wanted = F.col("weight") * F.lit(share)
    target = F.when(wanted > F.col("most"), F.col("most").cast("double")).otherwise(wanted)
    return ranked.select("source", "source_size", target.alias("target"))


def _key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")))


def _order(doc_id: Column, size: Column, seed: int) -> Column:
    """Where a row stands among those of its source, as one value without NULLs; the key and ``known`` name the id."""
    return F.struct(_key(doc_id, seed).alias("key"), doc_id.isNotNull().alias("known"), size.alias("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of a row, repeats included; the row at the cut is
    taken in part, so a source gives the whole part of its target exactly. NULL is a source of its
    own. Rows without words take nothing, as do all rows if no text has words. Rows of equal id
    are ordered by size; of two alike it does not matter which comes first. Only doc_id, source
    and text are read.
    """
    key = _key(F.col("doc_id"), seed)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"))
    # Only ids, counts and keys go on from here.
    sized = settle(sized.withColumn("key", key), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(settle(sizes, "sources"), weights, most), "targets")
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    placed = running_totals(sized, order, {"upto": F.col("size")}, ["source"])
    targets = targets.withColumnRenamed("source", "_source")
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor("target").cast("bigint")
    whole = F.expr("if(source_size > 0, cast(floor(target) as bigint) div source_size, 0)")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("upto") - F.col("size"))))
    taken = (whole * F.col("size") + part).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with all their columns and ``taken``, the words the mix takes of each.

    Rows that repeat doc_id, source and size share what is taken of them evenly, in whole words.

    Every row of a source is taken in whole epochs, those up to the cut once more. So a text needs only what is known of
    its source and where the cut lies: one row per source meets the texts, which are not shuffled for it.
    """
    found = mixed(docs, weights, most, seed)
    source_size = F.col("source_size")
    whole = F.when(source_size > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0).cast("bigint")
    takes = found.groupBy("source", "doc_id", "size").agg(F.expr("sum(taken) div count(*)").alias("taken"), F.first(whole).alias("whole"))
    place = _order(F.col("doc_id"), F.col("size"), seed)
    takes = takes.select("source", "whole", F.struct(place.alias("place"), "taken").alias("cut"))
    short = F.col("cut.taken") < (F.col("whole") + 1) * F.col("cut.place.size")
    cuts = takes.groupBy("source").agg(F.max("whole").alias("whole"), F.min(F.when(short, F.col("cut"))).alias("cut"))
    cuts = settle(cuts.select(F.struct("source", "whole", "cut").alias("_llm_mix")), "cuts")
    # Words are counted ahead of the join, so once.
    placed = docs.drop("taken").withColumn("_llm_place", _order(F.col("doc_id"), word_count(), seed))
    own = placed.join(cuts, F.col("source").cast("string").eqNullSafe(F.col("_llm_mix.source")))
    place, cut, whole = F.col("_llm_place"), F.col("_llm_mix.cut"), F.col("_llm_mix.whole")
    taken = (
        F.when(cut.isNull() | (place < cut["place"]), (whole + 1) * place["size"])
        .when(place == cut["place"], cut["taken"])
        .otherwise(whole * place["size"])
    )
    return own.withColumn("taken", taken).drop("_llm_mix", "_llm_place")


ORACLE_SQL = r"""
    with recursive sized as (
        select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
            md5(coalesce(cast(doc_id as varchar), '') || '|0') as key
        from documents
    ), sources as (
        select source, cast(sum(size) as bigint) as source_size,
            1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
        from sized group by source
    ), rounds as (
        select 0 as n, cast(0 as double) as share, cast(-1 as double) as before
        union all
        select n + 1,
            (select (sum(source_size) - coalesce(sum(3 * source_size) filter (where weight * share > 3 * source_size), 0))
                / cast(sum(weight) filter (where weight * share <= 3 * source_size) as double) from sources),
            share
        from rounds where share <> before
    ), targets as (
        select s.*, case when weight * share > 3 * source_size then cast(3 * source_size as double) else weight * share end as target
        from sources s, (select share from rounds order by n desc limit 1)
    ), placed as (
        select d.doc_id, d.source, size, source_size, target,
            cast(floor(target) as bigint) as budget,
            cast(sum(size) over (partition by d.source order by key, doc_id nulls first, size rows unbounded preceding) as bigint) - size as before
        from sized d join targets t on d.source is not distinct from t.source
    ), cut as (
        select *, case when source_size > 0 then budget // source_size else 0 end as whole from placed
    )
    select doc_id, size, source_size, target,
        cast(whole * size + greatest(0, least(size, budget - whole * source_size - before)) as bigint) as taken
    from cut
"""
