"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended into runs.

A run is a stretch of words with smallest period q that is at least 4 periods and 6 words long and
that no neighbouring word extends. By the runs theorem (Bannai et al. 2017) one of its periods is the longest
Lyndon word at its place, under the order of the words or under the reverse order. The first
phase of Baier's suffix sorter (2016) groups suffixes by exactly these words, so both Lyndon arrays
come out of it without sorting any suffixes further. Every root is then extended to both sides by
longest common extensions (LCE): binary search over prefix hashes, with the result compared word by word.

Texts are independent, so there is no shuffle. Most of a text can hold no run: inside a run of period q
every five words but those in the first q stood q words before. Stretches of five-word windows that came
before, at no more than a third of the stretch's length, are found for many texts at a time by sorting
hashes; only they, with the words before them, go through the grouping. The stretches are a superset:
no run is lost, and extension always looks at the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, whole_text

#: A run has at least so many periods and so many words. Windows of GRAM words fit into every run twice.
PERIODS, LEAST, GRAM = 4, 6, 5

#: Words that are searched for repeated windows at a time.
AT_ONCE = 400_000

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.string()), ("runs", _RUNS), ("collapsed", pa.string())])
_SCHEMA = "doc_id string, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by phase one of Baier's suffix sorter.

    Suffixes are grouped by their first symbol; groups are intervals of one array and named by their first
    index, so names are ordered as the groups are. From the highest group down, each member points to the
    nearest place before it that lies in a lower group. A place with l pointers out of the group
    continues with l copies of the group's word, so it moves to a new group right above its own.
    """
    n = len(ranks)
    slots = np.argsort(ranks, kind="stable")
    ordered = ranks[slots]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[begins, n])
    names = np.empty(n, np.int64)
    names[slots] = np.repeat(begins, sizes)
    at = np.empty(n, np.int64)
    at[slots] = np.arange(n)
    ends = dict(zip(begins.tolist(), (begins + sizes).tolist()))
    words = dict.fromkeys(ends, 1)
    slots, names, at = slots.tolist(), names.tolist(), at.tolist()
    before = [-1] * n
    high = n
    while high:
        group = names[slots[high - 1]]
        pointers: dict[int, int] = {}
        for s in sorted(slots[group:high]):
            p = s - 1
            while p >= 0 and names[p] >= group:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        high = group
        by_count: dict[int, list[int]] = {}
        for p, count in pointers.items():
            by_count.setdefault(count, []).append(p)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[count]:
                old = names[p]
                moved.setdefault(old, ends[old])
                ends[old] -= 1
                last, mine = ends[old], at[p]
                other = slots[last]
                slots[mine], at[other] = other, mine
                slots[last], at[p] = p, last
            for old, end in moved.items():
                new, length = ends[old], words[old] + count * words[group]
                ends[new], words[new] = end, length
                for slot in range(new, end):
                    names[slots[slot]] = new
    return np.array([words[g] for g in names], np.int64)


class _Extension:
    """Longest common extensions of places of one text, for many pairs of places at a time."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        power = np.full(self.n + 1, 0x9E3779B97F4A7C15 | 1, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mixed * self.power[: self.n], out=self.sums[1:])

    def _equal(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        one = (self.sums[i + length] - self.sums[i]) * self.power[p]
        return one == self.sums[i + p + length] - self.sums[i + p]

    def _longest(self, most: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(most), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = fits(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def around(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the longest stretch of period p around [i, i + p)."""
        right = self._longest(self.n - i - p, lambda m: self._equal(i, p, m))
        left = self._longest(i, lambda m: self._equal(i - m, p, m))
        return i - left, i + p + right

    def holds(self, start: int, end: int, p: int) -> bool:
        """Whether the stretch has period p, word by word: equal hashes could be a coincidence."""
        return np.array_equal(self.ids[start : end - p], self.ids[start + p : end])


def _stepwise(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    start, end = i, i + p
    while end < len(ids) and ids[end] == ids[end - p]:
        end += 1
    while start and ids[start - 1] == ids[start - 1 + p]:
        start -= 1
    return start, end


def runs_of(ids: np.ndarray, stretches: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of one text, by start, then period.

    ``ids`` has one number per word, equal for equal words. ``stretches`` are parts of the text of which some one
    contains each run whole; the text itself by default.
    """
    found: set[tuple[int, int, int]] = set()
    extension = _Extension(ids)
    for low, high in stretches or [(0, len(ids))]:
        part = np.unique(ids[low:high], return_inverse=True)[1]
        for ranks in (part, part.max(initial=0) - part):
            p = lyndon_array(ranks)
            i = np.arange(low, high)
            # A root of a run is followed or preceded by its copy.
            ahead, behind = np.minimum(i + p, len(ids) - 1), np.maximum(i - p, 0)
            likely = ((i + p < len(ids)) & (ids[i] == ids[ahead])) | ((i >= p) & (ids[behind] == ids[i]))
            i, p = i[likely], p[likely]
            start, end = extension.around(i, p)
            long = end - start >= np.maximum(LEAST, PERIODS * p)
            unique = np.unique(np.stack([start[long], end[long], p[long], i[long]]), axis=1).T.tolist()
            for start, end, p, i in unique:
                if (start, end - start, p) in found:
                    continue
                if not extension.holds(start, end, p):
                    start, end = _stepwise(ids, i, p)
                    if end - start < max(LEAST, PERIODS * p):
                        continue
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(ids: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Per text the parts that may hold runs. ``bounds`` are the places where texts begin, and the end."""
    n = len(ids) - GRAM + 1
    if n < 1:
        return {}
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    with np.errstate(over="ignore"):
        gram = text[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for k in range(GRAM):
            gram = (gram ^ (ids[k : n + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xE7037ED1A0B428DB)
            gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    again = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    back = np.zeros(n, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    # A window belongs to the text of its first word, and ends there.
    back[text[:n] != text[GRAM - 1 :]] = 0
    while True:
        edge = np.diff(np.r_[0, (back > 0).astype(np.int8), 0])
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        widest = (ends - begins + GRAM - 1) // (PERIODS - 1)
        allowed = np.zeros(n, np.int64)
        allowed[back > 0] = np.repeat(widest, ends - begins)
        far = back > allowed
        if not far.any():
            break
        back[far] = 0
    found: dict[int, list[tuple[int, int]]] = {}
    for begin, end, most in zip(begins.tolist(), ends.tolist(), widest.tolist()):
        at = int(text[begin])
        first = int(bounds[at])
        low, high = max(begin - most, first) - first, end + GRAM - 1 - first
        parts = found.setdefault(at, [])
        if parts and parts[-1][1] >= low:
            low, high = min(low, parts[-1][0]), max(high, parts.pop()[1])
        parts.append((low, high))
    return found


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        drop[start + p] += 1
        drop[start + length] -= 1
    covered = np.cumsum(drop[:-1]) > 0
    return [w for w, gone in zip(words, covered.tolist()) if not gone]


def _found(texts: list[bytes]) -> tuple[list, list]:
    words = [t.split() for t in texts]
    bounds = np.cumsum([0, *map(len, words)])
    flat = np.empty(int(bounds[-1]), object)
    flat[:] = [w for ws in words for w in ws]
    ids = pd.factorize(flat)[0]
    parts = _stretches(ids, bounds)
    runs, collapsed = [], []
    for at, ws in enumerate(words):
        here = runs_of(ids[bounds[at] : bounds[at + 1]], parts[at]) if at in parts else []
        runs.append([{"start": s, "length": m, "period": p} for s, m, p in here])
        collapsed.append(b" ".join(_without_repeats(ws, here) if here else ws).decode())
    return runs, collapsed


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        begin, held = 0, 0
        for at in range(len(texts)):
            held += len(texts[at].as_buffer()) // 5
            if held >= AT_ONCE or at == len(texts) - 1:
                runs, collapsed = _found([t.as_py() for t in texts[begin : at + 1]])
                columns = [ids[begin : at + 1], pa.array(runs, _RUNS), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)
                begin, held = at + 1, 0


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text by start and period, and the text without their repeats.

    ``runs`` holds (start, length, period) in words ``[^\\x20\\x09-\\x0D]+`` numbered from 0. ``collapsed`` has the
    words joined by one space, without those that some run contains after its first period. One row per
    row of ``docs``, repeated rows, repeated ids and NULL ids included; NULL texts count as empty, and an empty text has no
    run. Other columns are not read. No rows give no rows.
    """
    read = docs.select(id_text(), whole_text(text).alias("text"))
    return read.mapInArrow(_search, _SCHEMA).withColumn("doc_id", F.col("doc_id").cast("bigint"))
