"""Benchmark decontamination by SimHash windows and a multi-index Hamming search.

An item that stands in a document with a weighted-shingle similarity of at least 0.8 loses at most
a ninth of its shingles, so a run of its words stays intact. Windows are sized by item: long
enough to tell items apart, short enough that one of them, at the stride of its size, lies inside
that run. Every window of an item and every strided window of a document gets a SimHash over its
five-word shingles.

Fingerprints are cut into radius + 1 blocks. Two fingerprints within the radius agree in at least
one whole block, so looking up every block finds all of them; the Hamming distance then removes
what does not lie within the radius. Each hit aligns the item with the document, and the
item-sized window there is compared by exact weighted-shingle similarity.

Items are the query set: they go to the tasks in blocks of bounded size, one pass over the
documents per block. Nothing about the documents is collected.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import id_text, whole_text

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
#: Windows of items sent to the tasks at a time (some 40 bytes each).
INDEX_WINDOWS = 200_000
#: Words that are searched at a time, in one text or several.
STEP = 32768

#: Words of an item from which on a window size and its stride apply. An item of n words keeps a
#: run of n - (n - 4) // 9 words below 49 words, and of 24 words or more from there on.
SIZES = ((28, 16, 8), (14, 8, 6), (7, 5, 3), (5, 5, 1))

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


class WordHashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash per five-word shingle, mixed from word hashes."""
    n = len(words) - SHINGLE + 1
    h = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k in range(SHINGLE):
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def window_starts(words: int, size: int, stride: int) -> np.ndarray:
    """Where windows of ``size`` words begin in a text: every ``stride`` words, and the last one."""
    last = words - size
    return np.unique(np.append(np.arange(0, last + 1, stride), last)) if last >= 0 else np.empty(0, np.int64)


def window_prints(hashes: np.ndarray, starts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """SimHashes of windows of several sizes, given by their starts in order.

    The bits of a shingle are laid out once for all sizes. A window holds one shingle or a multiple
    of four, so sums over four shingles make them all.
    """
    found = {size: [np.empty(0, np.uint64)] for size in starts}
    most = max(starts) - SHINGLE + 1
    for seg in range(0, len(hashes), STEP):
        cut = hashes[seg : seg + STEP + most]
        bits = np.unpackbits(cut.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        twos = bits[:-1] + bits[1:]
        fours = twos[:-2] + twos[2:]
        for size, all_starts in starts.items():
            wide = size - SHINGLE + 1
            at = all_starts[slice(*np.searchsorted(all_starts, (seg, seg + STEP)))] - seg
            if len(at):
                ones = bits[at] if wide == 1 else sum(fours[at + k] for k in range(0, wide, 4))
                found[size].append(np.packbits(2 * ones > wide, axis=1, bitorder="little").view("<u8").ravel())
    return {size: np.concatenate(parts) for size, parts in found.items()}


def weighted_similarity(a: list[str], b: list[str]) -> float:
    """Jaccard similarity of two word sequences over shingles weighted by how often they occur."""
    one, two = (Counter(zip(*[w[k:] for k in range(SHINGLE)])) for w in (a, b))
    either = (one | two).total()
    return (one & two).total() / either if either else 0.0


class Index:
    """Windows of a block of items, found by the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], radius: int):
        self.radius = radius
        self.words = [words_of(text) for _, text in items]
        self.ids = [item for item, _ in items]
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        found: dict[int, list[tuple]] = defaultdict(list)
        known = WordHashes()
        self.strides: dict[int, int] = {}
        for k, words in enumerate(self.words):
            at = next(((size, stride) for least, size, stride in SIZES if len(words) >= least), None)
            if at is None:
                if words:
                    self.short[tuple(words)].append(k)
                continue
            starts = window_starts(len(words), at[0], 1)
            prints = window_prints(shingle_hashes(known.of(words)), {at[0]: starts})[at[0]]
            self.strides[at[0]] = min(at[1], self.strides.get(at[0], at[1]))
            found[at[0]].append((prints, np.full(len(prints), k), starts))
        edges = [64 * b // (radius + 1) for b in range(radius + 2)]
        self.sizes = {}
        for size, parts in found.items():
            prints, owner, start = (np.concatenate(x) for x in zip(*parts))
            tables = []
            for low, high in zip(edges, edges[1:]):
                key = (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
                order = np.argsort(key, kind="stable")
                # Where the prints of each block value begin; the blocks of radius 3 have 16 bits.
                begin = np.searchsorted(key[order], np.arange((1 << (high - low)) + 1, dtype=np.uint64))
                tables.append((np.uint64(low), np.uint64((1 << (high - low)) - 1), begin, order))
            self.sizes[size] = (prints, owner, start, tables)

    def hits(self, texts: list[list[str]], known: WordHashes) -> dict[int, dict[int, set[int]]]:
        """Text to item to the word positions where it may begin; the texts are searched as one."""
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        lengths = np.array([len(t) for t in texts])
        offsets = np.cumsum(lengths) - lengths
        if not self.sizes or lengths.sum() < SHINGLE:
            return found
        hashes = shingle_hashes(known.of([w for t in texts for w in t]))
        # Windows lie within a text, so the shingles across two texts are in none.
        starts = {
            size: np.concatenate([o + window_starts(n, size, stride) for o, n in zip(offsets, lengths)])
            for size, stride in self.strides.items()
        }
        windows = window_prints(hashes, starts)
        for size, (prints, owner, start, tables) in self.sizes.items():
            mine = windows[size]
            for low, mask, begin, order in tables:
                key = ((mine >> low) & mask).astype(np.int64)
                first = begin[key]
                many = begin[key + 1] - first
                hit = np.nonzero(many)[0]
                # Every (window, print) that agree in this block, then those within the radius.
                many = many[hit]
                window = np.repeat(hit, many)
                place = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
                near = order[np.repeat(first[hit], many) + place]
                close = np.bitwise_count(prints[near] ^ mine[window]) <= self.radius
                at = starts[size][window[close]]
                text = np.searchsorted(offsets, at, "right") - 1
                for t, j, place in zip(text.tolist(), near[close].tolist(), (at - offsets[text]).tolist()):
                    found[t][int(owner[j])].add(place - int(start[j]))
        return found

    def search(self, texts: Iterable[str | None], known: WordHashes) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item id, first word, words, similarity): the best window of each item that is similar enough."""
        batch: list[list[str]] = []
        done = words = 0
        for text in texts:
            batch.append(words_of(text))
            words += len(batch[-1])
            if words >= STEP:
                yield from self._judged(batch, done, known)
                done, batch, words = done + len(batch), [], 0
        yield from self._judged(batch, done, known)

    def _judged(self, texts: list[list[str]], done: int, known: WordHashes) -> Iterator[tuple]:
        hits = self.hits(texts, known)
        for t, words in enumerate(texts):
            for k in self.short.get(tuple(words), ()) if len(words) < SHINGLE else ():
                yield done + t, self.ids[k], 0, len(words), 1.0
            for k, places in hits.get(t, {}).items():
                item, best = self.words[k], (0.0, 0, 0)
                # Words added or left out move the end of the window by as many places.
                slack = len(item) // 9
                for begin in sorted(places):
                    for b in {max(0, begin), max(0, begin + slack // 2), max(0, begin - slack // 2)}:
                        for size in {len(item), len(item) + slack // 2, len(item) - slack // 2}:
                            score = weighted_similarity(words[b : b + size], item)
                            best = max(best, (score, -b, min(size, len(words) - b)))
                    if best[0] == 1.0:
                        break
                if best[0] >= SIMILARITY:
                    yield done + t, self.ids[k], -best[1], best[2], best[0]


def item_blocks(benchmark: DataFrame, most: int = INDEX_WINDOWS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most about ``most`` windows, in the order of their ids."""
    slim = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text")).distinct()
    block, windows = [], 0
    for row in slim.orderBy("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        windows += len(row["text"].split())
        if windows >= most:
            yield block
            block, windows = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, words, similarity): the best place of each item in each document.

    An item counts if a window of its size reaches 0.8. Items of under five words are too short
    for a shingle and match only a document of the same words; items and documents without words
    match nothing. Rows are judged by their text alone; repeated rows come out repeated, a NULL id
    stays NULL. Only doc_id and text, item_id and text are read.
    """
    spark: SparkSession = docs.sparkSession
    slim = docs.select(id_text(), whole_text().alias("text"))
    schema = "doc_id string, item_id bigint, first_word bigint, words bigint, similarity double"
    found = None
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(Index(block, radius))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            for rows in batches:
                ids = rows["doc_id"].tolist()
                hits = [(ids[m[0]], *m[1:]) for m in index.value.search(rows["text"], known)]
                if len(known) > 1_000_000:
                    known.clear()
                names = ["doc_id", "item_id", "first_word", "words", "similarity"]
                yield pd.DataFrame(hits, columns=names).astype({"item_id": "Int64"})

        part = slim.mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns; no row is moved."""

    def clean(index):
        def judge(texts: pd.Series) -> pd.Series:
            known = WordHashes()
            hit = {m[0] for m in index.value.search(texts, known)}
            return pd.Series([k not in hit for k in range(len(texts))], dtype=bool)

        return F.pandas_udf(judge, "boolean")

    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, radius))
        docs = docs.where(clean(index)(whole_text()))
    return docs
