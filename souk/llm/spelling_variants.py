"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is a vector: its length, then how many of its letters fall into each letter group. Words are
arranged by the successive numbers of their vectors in a trie. One inserted letter adds one to one count, one deleted
letter takes one away, a replaced one does both or neither, so a depth-first search that may spend a surplus of one and a
deficit of one comes past every word one edit away. The words of the leaves it reaches are verified letter by
letter. Each pair is looked for from one side only: from the word whose vector comes first.

The trie is cut into shards: a subtree of no more than ``shard`` words lies in one. The subtrees that are larger are
few, at most one per level and ``shard`` words; they are counted by Spark, and each word walks
them to find the shards its search comes to. Inside a shard the search takes all words together:
it visits each node once, with the words that still have budget there. Words with equal vectors share a leaf; one
edit leaves one half of a word as it was, so large leaves compare only words that share a half, and a leaf that
is larger than a shard is split by these halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import whole_text
from souk.session import settle

#: Groups of letters of similar weight in European languages, in the order of the trie; all other letters form the last one.
GROUPS = ("e", "n", "i", "t", "a", "r", "s", "o", "l", "uq", "dk", "hj", "cv", "mg", "pbf")

#: Members of a shard. A shard of s members is visited by some multiple of s words, set by how alike words are.
SHARD = 20_000
#: Nodes of no more members are leaves. Leaves of more comparisons compare by halves.
LEAF, MANY = 6, 4096
#: Letters of words that are laid out at a time.
AT_ONCE = 1 << 22

LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GROUP_OF = np.full(256, len(GROUPS), np.uint8)
for _at, _group in enumerate(GROUPS):
    _GROUP_OF[list(_group.encode())] = _at

_FOUND = "word string, n_near bigint, best_n bigint, best string"
_ROUTED = "shard string, word string, n bigint, own boolean"


def runs_of_letters(text: str = "text", least: int = 1) -> Column:
    """Runs of letters of at least that length, with A-Z in lower case; NULL counts as empty."""
    runs = F.regexp_extract_all(whole_text(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return F.transform(runs, lambda run: F.translate(run, _UPPER, _LOWER))


def _vectors(words: np.ndarray) -> np.ndarray:
    """Length and group counts of words given as padded bytes."""
    letters = words.view(np.uint8).reshape(len(words), -1)
    vectors = np.zeros((len(words), len(GROUPS) + 2), np.int32)
    vectors[:, 0] = (letters != 0).sum(axis=1)
    groups = _GROUP_OF[letters]
    for g in range(len(GROUPS)):
        vectors[:, g + 1] = (groups == g).sum(axis=1)
    vectors[:, -1] = vectors[:, 0] - vectors[:, 1:-1].sum(axis=1)
    return vectors


def _padded(words: list[str]) -> np.ndarray:
    return np.array([w.encode("latin-1") for w in words], np.bytes_)


# --- the search inside a shard -------------------------------------------------------------------

#: What a search has spent: the words are of equal length (nothing, the surplus, both) or the other one is longer
#: (nothing yet, the surplus). A deficit before the surplus would meet a word whose vector comes first.
EQUAL, SURPLUS, BOTH, LONGER, LONGER_SPENT = range(5)
_ON = {1: np.array([SURPLUS, -1, -1, LONGER_SPENT, -1]), 0: np.arange(5), -1: np.array([-1, BOTH, -1, -1, -1])}


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of padded words, b as long as a or one letter longer, are exactly one edit apart."""
    width = a.dtype.itemsize
    x, y = a.view(np.uint8).reshape(len(a), width), b.view(np.uint8).reshape(len(b), width)
    length = (y != 0).sum(axis=1)
    longer = length - (x != 0).sum(axis=1)
    same = x == y
    head = np.where(same.all(axis=1), width, same.argmin(axis=1))
    shifted = np.zeros_like(same)
    shifted[:, 1:] = x[:, :-1] == y[:, 1:]
    shifted = np.where((longer == 1)[:, None], shifted, same)
    # Past the end of the longer word nothing differs, so equal ends are counted from the right.
    shifted |= np.arange(width) >= length[:, None]
    tail = np.where(shifted.all(axis=1), length, length - (width - shifted[:, ::-1].argmin(axis=1)))
    head = np.minimum(head, length)
    return (head + tail >= length - 1) & ((longer == 1) | ((longer == 0) & (head < length)))


class _Shard:
    def __init__(self, words: list[str], n: np.ndarray, own: np.ndarray):
        self.text, self.n = np.array(words, object), n
        self.words = _padded(words)
        self.vectors = _vectors(self.words)
        members = np.flatnonzero(own)
        order = np.lexsort(self.vectors[members].T[::-1])
        self.members = members[order]
        self.sorted = self.vectors[self.members]
        self.at_once = max(1, AT_ONCE // self.words.dtype.itemsize)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def compare(self, queries: np.ndarray, members: np.ndarray) -> None:
        """Verify pairs, many at a time."""
        self.waiting.append((queries, members))
        self.held += len(queries)
        if self.held >= self.at_once:
            self.verify()

    def verify(self) -> None:
        if not self.waiting:
            return
        q, w = (np.concatenate(side) for side in zip(*self.waiting))
        self.waiting, self.held = [], 0
        for at in range(0, len(q), self.at_once):
            a, b = q[at : at + self.at_once], w[at : at + self.at_once]
            change = self.vectors[b] - self.vectors[a]
            differs = change != 0
            first = np.take_along_axis(change, differs.argmax(axis=1)[:, None], axis=1)[:, 0]
            few = (np.abs(change[:, 1:]).sum(axis=1) <= 2) & (change[:, 0] <= 1)
            a, b, first = a[few & (first >= 0)], b[few & (first >= 0)], first[few & (first >= 0)]
            ahead = (first > 0) | (self.words[a] < self.words[b])
            a, b = a[ahead], b[ahead]
            near = _one_edit(self.words[a], self.words[b])
            self.pairs.append((a[near], b[near]))

    def by_halves(self, queries: np.ndarray, members: np.ndarray, kinds: str = "FS") -> None:
        """Compare words of one leaf that share their first or last half, as the shorter word is cut."""
        size = self.vectors[members[0], 0]
        for length in (size, size - 1):
            some = queries[self.vectors[queries, 0] == length]
            half = int(length) // 2
            if not len(some):
                continue
            q, m = self.words[some], self.words[members]
            heads = _cut(q, 0, half), _cut(m, 0, half)
            tails = _cut(q, half, length), _cut(m, size - (length - half), size)
            for kind, (ours, theirs) in (("F", heads), ("S", tails)):
                if kind not in kinds:
                    continue
                order = np.argsort(theirs, kind="stable")
                low = np.searchsorted(theirs[order], ours, "left")
                high = np.searchsorted(theirs[order], ours, "right")
                # Blocks of queries, so that a half shared by many words takes bounded memory.
                begin, upto = 0, np.cumsum(high - low)
                while begin < len(some):
                    base = upto[begin - 1] if begin else 0
                    end = max(begin + 1, int(np.searchsorted(upto, base + self.at_once, "right")))
                    times = (high - low)[begin:end]
                    one = np.repeat(np.arange(begin, end), times)
                    shift = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
                    other = order[np.repeat(low[begin:end], times) + shift]
                    if kind == "S":  # a pair that shares both halves is found by its first
                        apart = heads[0][one] != heads[1][other]
                        one, other = one[apart], other[apart]
                    self.compare(some[one], members[other])
                    begin = end

    def search(self, depth: int, low: int, high: int, alive: np.ndarray, spent: np.ndarray) -> None:
        """The part of the trie with the sorted members [low, high), by the words still alive there."""
        whole = depth == self.vectors.shape[1]
        if whole or high - low <= LEAF:
            members = self.members[low:high]
            if whole and len(alive) * len(members) > MANY:
                self.by_halves(alive, members)
            else:
                self.compare(np.repeat(alive, len(members)), np.tile(members, len(alive)))
            return
        column = self.sorted[low:high, depth]
        cuts = np.flatnonzero(column[1:] != column[:-1]) + 1
        edges = [0, *cuts.tolist(), high - low]
        values = self.vectors[alive, depth]
        for begin, end in zip(edges, edges[1:]):
            change = int(column[begin]) - values
            if depth == 0:
                state = np.where(change == 0, EQUAL, np.where(change == 1, LONGER, -1))
            else:
                state = np.full(len(alive), -1)
                for step, to in _ON.items():
                    at = change == step
                    state[at] = to[spent[at]]
            on = state >= 0
            if on.any():
                self.search(depth + 1, low + begin, low + end, alive[on], state[on])


def _cut(words: np.ndarray, begin: int, end: int) -> np.ndarray:
    if begin == end:
        return np.zeros(len(words), "S1")
    letters = words.view(np.uint8).reshape(len(words), -1)
    return np.ascontiguousarray(letters[:, begin:end]).view(f"S{end - begin}").ravel()


def _near_words(shard: pa.Table) -> pa.Table:
    """For each word of a shard that has near ones there: how many, and the most frequent of them."""
    name = shard.column("shard")[0].as_py()
    own = shard.column("own").to_numpy(zero_copy_only=False)
    here = _Shard(shard.column("word").to_pylist(), shard.column("n").to_numpy(), own)
    everyone = np.arange(len(own))
    if not len(here.members):
        pass
    elif "|" in name:  # a part of a large leaf: words that share one kind of half
        here.by_halves(np.flatnonzero(~own), here.members, name.split("|")[1])
    else:
        here.search(0, 0, len(here.members), everyone, np.zeros(len(own), np.int64))
    here.verify()
    one, other = (np.concatenate(side) if here.pairs else np.zeros(0, np.int64) for side in (list(zip(*here.pairs)) or ([], [])))
    links = pd.DataFrame({"a": np.r_[one, other], "b": np.r_[other, one]})
    links["n"], links["word"] = here.n[links["b"]], here.words[links["b"]]
    links = links.sort_values(["a", "n", "word"], ascending=[True, False, True])
    best = links.drop_duplicates("a")
    counts = links.groupby("a", sort=True).size()
    columns = here.text[best["a"]], counts.to_numpy(), best["n"].to_numpy(), here.text[best["b"]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])


# --- the way to the shards -----------------------------------------------------------------------


def _large_nodes(words: DataFrame, shard: int) -> dict[tuple, int]:
    """Nodes of more than ``shard`` words, and how many they have; at most one per level and ``shard`` words."""
    levels = [F.length("word").alias("c0")]
    others = F.length("word")
    for at, group in enumerate(GROUPS, 1):
        count = F.length("word") - F.length(F.translate("word", group, ""))
        levels.append(count.alias(f"c{at}"))
        others = others - count
    levels.append(others.alias(f"c{len(levels)}"))
    names = [f"c{at}" for at in range(len(levels))]
    vectors = settle(words.select(*levels).groupBy(*names).agg(F.count("*").alias("n")), "vectors")
    large: dict[tuple, int] = {}
    for depth in range(1, len(names) + 1):
        found = vectors.groupBy(*names[:depth]).agg(F.sum("n").alias("n")).where(F.col("n") > shard).collect()
        if not found:
            break
        large |= {tuple(r)[:-1]: r["n"] for r in found}
    return large


class _Walk:
    """The ways of some words through the large nodes: rows (word, shard, whether it belongs there)."""

    def __init__(self, words: np.ndarray, large: dict[tuple, int], shard: int):
        self.words, self.vectors = words, _vectors(words)
        self.large, self.shard = large, shard
        self.sent: list[tuple[str, np.ndarray, np.ndarray]] = []
        everyone = np.arange(len(words))
        self.visit((), everyone, np.zeros(len(words), np.int64), np.ones(len(words), bool))

    def visit(self, node: tuple, alive: np.ndarray, spent: np.ndarray, own: np.ndarray) -> None:
        depth = len(node)
        if depth and node not in self.large:
            self.sent.append((_name(node), alive, own))
            return
        if depth == self.vectors.shape[1]:
            self.split(node, alive, own)
            return
        values = self.vectors[alive, depth]
        ways = []
        for step in (-1, 0, 1):
            state = np.full(len(alive), (EQUAL, LONGER, -1)[step]) if depth == 0 else _ON[step][spent]
            on = (state >= 0) & (values + step >= 0)
            ways.append((values[on] + step, alive[on], state[on], own[on] & (step == 0)))
        value, at, state, mine = (np.concatenate(side) for side in zip(*ways))
        for v in np.unique(value).tolist():
            here = value == v
            self.visit((*node, v), at[here], state[here], mine[here])

    def split(self, node: tuple, alive: np.ndarray, own: np.ndarray) -> None:
        """A leaf larger than a shard: members and searching words meet by either half of the shorter one."""
        size, parts = node[0], -(-self.large[node] // self.shard)
        for length in (size, size - 1):
            half = length // 2
            for at, mine in ((alive[self.vectors[alive, 0] == length], False), (alive[own], True)):
                tail = size - (length - half) if mine else half
                for kind in "FS":
                    halves = [w[:half] if kind == "F" else w[tail:] for w in self.words[at].tolist()]
                    part = np.array([crc32(h) % parts for h in halves], np.int64)
                    for k in np.unique(part).tolist():
                        some = at[part == k]
                        self.sent.append((f"{_name(node)}|{kind}|{length}|{k}", some, np.full(len(some), mine)))


def _route(large: dict[tuple, int], shard: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Send each word to the shard it belongs to and to those its search comes to."""
    for batch in batches:
        lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        while len(order):
            # Words of similar length are laid out together, so one very long word costs no more than itself.
            fits = np.arange(1, len(order) + 1) * lengths[order] <= AT_ONCE
            count = max(1, int(fits.sum()))
            some, order = batch.take(pa.array(order[:count])), order[count:]
            sent = _Walk(_padded(some.column(0).to_pylist()), large, shard).sent
            names = np.repeat(np.array([s[0] for s in sent], object), [len(s[1]) for s in sent])
            at = pa.array(np.concatenate([s[1] for s in sent]))
            columns = [pa.array(names, pa.string()), some.column(0).take(at), some.column(1).take(at)]
            own = pa.array(np.concatenate([s[2] for s in sent]))
            yield pa.RecordBatch.from_arrays([*columns, own], names=["shard", "word", "n", "own"])


def _name(node: tuple) -> str:
    return ".".join(map(str, node))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): each word's near words, and the most frequent of them, ties by code points.

    ``words`` has distinct words of letters up to U+00FF and their counts n. Words without near words are left out.
    """
    words = words.select("word", F.col("n").cast("bigint").alias("n"))
    routed = words.mapInArrow(partial(_route, _large_nodes(words, shard), shard), _ROUTED)
    found = routed.groupBy("shard").applyInArrow(_near_words, _FOUND)
    # A word is searched for in several shards, and each pair is found in one of them.
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def spelling_forms(words: DataFrame, ratio: int = 10, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): groups of spelling variants, one row per word.

    ``words`` (word, n) has distinct words; a word of NULL is left out, other columns are not read. Two words are near
    if one inserted, deleted or replaced letter turns one into the other. A word's form is its near word of the largest
    n, of equal ones the smallest by code points, if that has at least ``ratio`` (2 or more) times the word's n, else NULL. ``root`` is the
    end of the chain of forms. No rows give no rows.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 lets words be forms of one another")
    words = settle(words.select("word", F.col("n").cast("bigint").alias("n")).where(F.col("word").isNotNull()), "words")
    near = near_words(words, shard)
    joined = words.join(near, "word", "left")
    given = F.col("best_n") >= ratio * F.col("n")
    forms = joined.select(
        "word",
        F.when(given, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(given, F.col("best_n")).alias("form_n"),
    )
    forms = settle(forms, "forms")
    # Counts grow along a chain, so it ends, and after each round twice as many of its steps are done.
    way = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = settle(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        way = joined.drop("next")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            break
    out = forms.join(way, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
