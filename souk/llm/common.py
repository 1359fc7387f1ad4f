"""Pieces several text operators share: white space, words, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.session import settle

#: One run of the six ASCII white space characters, and one word between such runs.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text: str = "text") -> Column:
    """The text of a row; NULL counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def id_text(name: str = "doc_id") -> Column:
    """An id for the way through pandas, where a NULL would turn integers into floats."""
    return F.col(name).cast("bigint").cast("string").alias(name)


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def _fingerprint(links: DataFrame) -> tuple:
    """Equal for equal sets of links, so that a round without change is noticed."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable over the links, for every id that has one.

    Alternates the large-star and small-star rounds of Kiveris et al. (2014) until nothing
    changes, so the number of rounds grows with the logarithm of the longest chain. Each round
    is written to the shared workspace; the smallest neighbours are written apart, so that the
    join that meets a hot id reads both sides straight from a shuffle and can be split.
    """
    ends = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = settle(links.select(*ends).where("u <> v").distinct(), "links")
    seen = None
    while (is_now := _fingerprint(now)) != seen:
        seen = is_now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.distinct(), "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
