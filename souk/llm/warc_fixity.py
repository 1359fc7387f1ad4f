"""Fixity audit of WARC replicas through Merkle trees over ordered offset ranges.

A replica is a table of records, each at an offset of a file. The leaves of a file's tree hash the
records of one offset range in order; each node above hashes its children in order, up to the
root. Replicas are compared at the roots, and only children of nodes that differ are looked at
further down, so what is read of two equal replicas is one row per file, and a corruption is
located by as many rows as its path is long.

Every node has at most a fixed number of children, and a leaf range holds only as many records as
fit into its bytes, so no file, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.ordered import running_totals
from souk.session import settle

#: Bytes of a file, of the offset range of a leaf, and children of a node.
FILE_BYTES = 1 << 30
LEAF_BYTES = 64 << 10
FANOUT = 16


def warc_record(uri: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record as binary: header, empty line, payload, two line ends."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(uri.cast("string"), F.lit("")), r"[\r\n]", " "),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"),
        F.sha2(body, 256),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(header.cast("binary"), body, F.lit(b"\r\n\r\n"))


def warc_layout(pages: DataFrame, file_bytes: int = FILE_BYTES, also: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, file, offset, length, digest): where each page's record lies and its SHA-256.

    ``also`` adds columns computed over a page and its ``record``.

    Records follow each other by page_id and digest. A file takes the records that begin within
    its share of the bytes; a record longer than that stands at the end of its file. NULL pages
    are empty records.
    """
    record = warc_record(F.col("url"), F.col("html"))
    more = also or {}
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", record.alias("record"))
    rows = rows.select(
        "page_id",
        F.octet_length("record").cast("bigint").alias("length"),
        F.sha2("record", 256).alias("digest"),
        *[c.alias(name) for name, c in more.items()],
    )
    rows = settle(rows, "records")
    order = [F.col("page_id").asc_nulls_first(), F.col("digest"), F.col("length")]
    placed = running_totals(rows, order, {"upto": F.col("length")}).withColumn("begin", F.col("upto") - F.col("length"))
    placed = settle(placed.withColumn("file", F.floor(F.col("begin") / file_bytes)), "placed")
    starts = settle(placed.groupBy("file").agg(F.min("begin").alias("first")), "files")
    return placed.join(starts, "file").select("page_id", "file", (F.col("begin") - F.col("first")).alias("offset"), "length", "digest", *more)


def _levels(top: int, leaf_bytes: int, fanout: int) -> int:
    """Levels a tree needs above its leaves to come down to one node."""
    nodes, levels = top // leaf_bytes + 1, 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def merkle_levels(records: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, node, hash) per level, leaves first, from (file, offset, digest)."""
    node = F.floor(F.col("offset") / leaf_bytes).alias("node")
    entry = F.struct("offset", F.concat_ws(":", "offset", "length", "digest").alias("line"))
    out = []
    # Within one range the records lie in order, each named by its place, length and digest.
    rows = records.select("file", node, entry.alias("entry"))
    for _ in range(levels + 1):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["line"]), "\n")
        level = settle(rows.groupBy("file", "node").agg(F.sha2(lines, 256).alias("hash")), "level")
        out.append(level)
        up = F.floor(F.col("node") / fanout).alias("up")
        entry = F.struct(F.col("node").alias("offset"), F.concat_ws(":", "node", "hash").alias("line"))
        rows = level.select("file", up, entry.alias("entry")).withColumnRenamed("up", "node")
    return out


def audit(one: DataFrame, two: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, state, length_one, length_two): the records in which two replicas differ.

    Replicas are tables (file, offset, length, digest); offsets are those of the index both share.
    ``state`` is ``changed``, ``missing`` (in the second replica) or ``extra``. Records of equal
    file and offset are compared as a whole; a file that only one replica has differs throughout.
    Equal replicas, and empty ones, give no rows.
    """
    ends = [r.agg(F.max("offset")).first()[0] or 0 for r in (one, two)]
    levels = _levels(max(ends), leaf_bytes, fanout)
    trees = [merkle_levels(r, levels, leaf_bytes, fanout) for r in (one, two)]
    differing = None
    for a, b in zip(reversed(trees[0]), reversed(trees[1])):
        if differing is not None:
            parents = differing.select(F.col("file").alias("f"), F.col("node").alias("p"))
            below = (F.col("file") == F.col("f")) & (F.floor(F.col("node") / fanout) == F.col("p"))
            a, b = (x.join(parents, below, "left_semi") for x in (a, b))
        b = b.withColumnRenamed("hash", "other")
        pairs = a.join(b, ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        differing = settle(pairs.select("file", "node"), "differing")
    parents = differing.select(F.col("file").alias("f"), F.col("node").alias("p"))
    below = (F.col("file") == F.col("f")) & (F.floor(F.col("offset") / leaf_bytes) == F.col("p"))
    state = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "length", "digest"))), "\n")
    ends = [
        r.join(parents, below, "left_semi").groupBy("file", "offset").agg(F.max("length").alias(f"length_{n}"), state.alias(f"state_{n}"))
        for r, n in ((one, "one"), (two, "two"))
    ]
    met = ends[0].join(ends[1], ["file", "offset"], "full").where(~F.col("state_one").eqNullSafe(F.col("state_two")))
    kind = F.when(F.col("state_two").isNull(), "missing").when(F.col("state_one").isNull(), "extra").otherwise("changed")
    return met.select("file", "offset", kind.alias("state"), "length_one", "length_two")
