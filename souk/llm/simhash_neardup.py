"""SimHash near-duplicates through vantage-point trees.

Every document gets a 64-bit SimHash of its word shingles. Distinct fingerprints are routed down
a vantage-point tree: a node holds one fingerprint and a distance, and sends a fingerprint inside
or outside by its Hamming distance to it. By the triangle inequality, fingerprints within the
radius of each other can be parted by a node only if the outer one lies within the radius of the
border, so those also visit the inner side. Every pair within the radius meets in some shard.

The upper levels are learned from a bounded sample of fingerprints and route to shards; below,
each shard goes on splitting its own fingerprints and compares what is left. A shard returns a
star of links per cluster, never all its pairs; the stars are joined by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import components, id_text, whole_text
from souk.session import settle

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints a shard is meant to hold, and sampled fingerprints per shard for the upper levels.
SHARD_SIZE = 32768
SAMPLE_PER_SHARD = 64
#: The upper levels are collected from at most this many shards' samples.
MOST_SHARDS = 1024
#: Fingerprints that are compared with one another at the bottom of a tree.
LEAF = 256
#: Shingles hashed at a time, so a very long text needs no more memory than this.
STEP = 65536

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    many = max(1, len(words) - shingle + 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, np.int64)
    for at in range(0, many, STEP):
        upto = min(many, at + STEP)
        first = starts[at:upto].tolist()
        last = ends[np.minimum(np.arange(at, upto) + shingle, len(words)) - 1].tolist()
        hashes = np.array([digest(view[s:e], SEED) for s, e in zip(first, last)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > many, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a bigint."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["doc_id"]].assign(fp=[fingerprint(t, shingle) for t in rows["text"]])

    slim = docs.select(id_text(), whole_text().alias("text"))
    return slim.mapInPandas(score, "doc_id string, fp bigint").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _distance(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def _split(points: np.ndarray, radius: int) -> tuple[int, int] | None:
    """A vantage point and the distance up to which points lie inside; None if nothing is parted."""
    vantage = int(points[len(points) // 2])
    d = np.sort(_distance(points, vantage))
    # Inside also holds visitors, so the border is set where both sides come out alike.
    inside = np.searchsorted(d, np.arange(65) + radius, "right")
    outside = len(d) - np.searchsorted(d, np.arange(65), "right")
    border = int(np.argmin(np.maximum(inside, outside)))
    return (vantage, border) if max(inside[border], outside[border]) < 0.95 * len(d) else None


def routes(sample: np.ndarray, depth: int, radius: int) -> list:
    """The upper levels of the tree as nested [vantage, border, inside, outside]; [] is a shard."""
    node = _split(sample, radius) if depth and len(sample) > 2 * SAMPLE_PER_SHARD else None
    if node is None:
        return []
    d = _distance(sample, node[0])
    return [*node, routes(sample[d <= node[1]], depth - 1, radius), routes(sample[d > node[1]], depth - 1, radius)]


def route(tree: list, points: np.ndarray, radius: int, path: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points that live in it or visit it)."""
    if not tree:
        yield path, points
        return
    d = _distance(points, tree[0])
    yield from route(tree[2], points[d <= tree[1] + radius], radius, 2 * path)
    yield from route(tree[3], points[d > tree[1]], radius, 2 * path + 1)


def _stars(points: np.ndarray, neighbours: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """Links (point, root) that connect what the neighbour pairs connect; pairs come in bounded blocks."""
    label = np.arange(len(points))
    blocks = range(0, len(points), LEAF)
    changed = True
    while changed:
        changed = False
        for at in blocks:
            a, b = neighbours(at, min(len(points), at + LEAF))
            low = np.minimum(label[a], label[b])
            if (label[a] != label[b]).any():
                changed = True
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
    linked = label != np.arange(len(points))
    if linked.any():
        yield points[linked], points[label[linked]]


def _compared(points: np.ndarray, radius: int) -> Iterator[tuple]:
    """Links among points, each block compared with all."""

    def near(at: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(np.bitwise_count(points[at:upto, None] ^ points[None, :]) <= radius)
        return a + at, b

    yield from _stars(points, near)


def _enumerated(points: np.ndarray, radius: int) -> Iterator[tuple]:
    """Links among many points too close to part: look up every neighbour within the radius.

    Its cost is in proportion to the points (2,081 look-ups each for radius 2).
    """
    points = np.sort(points)
    masks = np.zeros(1, np.uint64)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(radius):
        masks = np.unique(np.concatenate((masks, (masks[:, None] ^ bits[None, :]).ravel())))

    def near(at: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        wanted = (points[at:upto, None] ^ masks[None, :]).ravel()
        found = np.minimum(np.searchsorted(points, wanted), len(points) - 1)
        hit = points[found] == wanted
        return np.repeat(np.arange(at, upto), len(masks))[hit], found[hit]

    yield from _stars(points, near)


def shard_links(points: np.ndarray, radius: int) -> Iterator[tuple]:
    """Stars of links that connect all pairs of distinct points within the radius."""
    if len(points) <= LEAF:
        yield from _compared(points, radius)
        return
    node = _split(points, radius)
    if node is None:
        yield from (_enumerated if radius <= 2 and len(points) > 64 * LEAF else _compared)(points, radius)
        return
    d = _distance(points, node[0])
    inside, outside = points[d <= node[1] + radius], points[d > node[1]]
    del points, d
    yield from shard_links(inside, radius)
    yield from shard_links(outside, radius)


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): links that connect all distinct fingerprints within ``radius`` bits, through VP trees."""
    many = prints.count()
    shards = min(MOST_SHARDS, -(-many // SHARD_SIZE))
    tree: list = []
    if shards > 1:
        # A hash picks the sample, so every run takes the same; sorted, it does not depend on the order of rows.
        part = int(2**32 * min(1.0, 4 * shards * SAMPLE_PER_SHARD / many))
        sample = prints.where((F.xxhash64("fp") % 2**32 + 2**32) % 2**32 < part).select("fp").toPandas()
        tree = routes(np.sort(sample["fp"].to_numpy().view(np.uint64)), (shards - 1).bit_length(), radius)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for shard, points in route(tree, rows["fp"].to_numpy().view(np.uint64), radius):
                yield pd.DataFrame({"shard": np.full(len(points), shard), "fp": points.view(np.int64)})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(shard_links(np.sort(rows["fp"].to_numpy().view(np.uint64)), radius))
        if not found:
            return pd.DataFrame({"fp": np.array([], np.int64), "root": np.array([], np.int64)})
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pd.DataFrame({"fp": a, "root": b})

    dealt = prints.select("fp").mapInPandas(deal, "shard bigint, fp bigint")
    return dealt.groupBy("shard").applyInPandas(link, "fp bigint, root bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (bigint), component_id, root (a fingerprint that names the component).

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits, the
    row's own included; NULL ids count only if no other is reachable. Rows without words share
    fingerprint 0 and are linked like any others. Repeated rows come out repeated. Only doc_id
    and text are read; no rows give no rows.
    """
    marked = settle(with_fingerprints(docs, shingle), "fingerprints")
    prints = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    classes = components(fingerprint_links(prints, radius), "fp", "root").select(F.col("id").alias("fp"), "component")
    rooted = prints.join(classes, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = settle(rooted.select("fp", "root").join(firsts, "root"), "classes")
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id", "root")


def hex_fingerprint() -> Column:
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with all their columns.

    It is the row with the smallest doc_id, NULL after all others. A doc_id that stands in one row
    says all that is needed to find the row again; rows without an id and rows that repeat one are
    found by id and fingerprint, and of those alike in both one stays. Texts meet the ids of the rows
    that go, which are few where copies are, and are not shuffled as long as Spark can broadcast those.
    """
    found = settle(near_duplicates(docs, shingle, radius), "near")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("own"))
    vague = (F.col("n") > 1) | F.col("doc_id").isNull()
    ids = settle(ids.select(F.col("doc_id").alias("_llm_id"), "own", vague.alias("vague")), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id"))
    goes = settle(ids.where("vague or own is null or not own").select("_llm_id"), "goes")
    kept = docs.join(goes, same, "left_anti")
    unsure = settle(ids.where("vague").select("_llm_id"), "vague")
    if unsure.isEmpty():
        return kept
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp")).alias("first")
    firsts = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_llm_id"), F.col("first.fp").alias("_llm_fp"))
    firsts = settle(firsts, "firsts")

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    again = docs.join(unsure, same, "left_semi").withColumn("_llm_print", fp(whole_text()))
    again = again.join(firsts, same & (F.col("_llm_print") == F.col("_llm_fp")), "left_semi")
    rows = again.groupBy("doc_id", "_llm_print").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("_llm_row"))
    return kept.unionByName(rows.select("_llm_row.*"))
