"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms of the collection whose inverse document frequency lies in a band: not so frequent that
every text has them, not so rare that a slip of the pen makes one. A text is reduced to its distinct
terms in the lexicon, and the sorted terms are hashed. One hash changes with any term, so subsets of the
lexicon are drawn at random (Kolcz, Chowdhury and Alspector 2004) and the terms in each are hashed apart: a changed term spoils
only the subsets it is in, and two texts are as alike as the share of subsets they agree on.

A subset that takes most of a long text's terms would always change, and one that takes few of a short text's
would be empty. There are STREAMS random orders of the lexicon, each with nested subsets of every 2nd, 4th, 8th, ...
term, and a fingerprint holds for each order the three subsets that keep about 1, 1/2 and 1/4 terms of the text, and says which.

The lexicon is the only thing sent to all executors. Its size has a bound that does not depend on the number of texts: a term in it
stands in ``least`` texts or more, so there are at most (distinct terms of all texts) / least, and
``least`` is at least a LEXICON_MOST-th of that sum. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from souk.llm.common import WORD, whole_text
from souk.session import settle

#: The band of inverse document frequency, in powers of two: terms in an 8th to a 4096th of all texts.
COMMON, RARE = 3, 12
#: Most terms of the lexicon, 8 bytes each. With up to 1024 distinct terms a text on average the band alone keeps below.
LEXICON_MOST = 1 << 22

#: Random orders of the lexicon, and nested subsets of each in a fingerprint.
STREAMS, LEVELS = 32, 3
#: Hexadecimal digits of a fingerprint: hash of all terms, first subset, then the subsets' hashes.
WHOLE, FIRST, ENTRY = 16, 2, 4
WIDTH = WHOLE + FIRST + STREAMS * LEVELS * ENTRY

#: Code points of text in a slice of the order, and terms hashed at a time.
SLICE_CHARS, AT_ONCE = 8_000_000, 1 << 14

_LAST_ID = (1 << 63) - 1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms: runs of letters and digits in lower case, or words if there are none."""
    lower, run = F.lower(text), r"[\p{L}\p{N}]"
    # Asked first, so that the runs are looked for once.
    found = F.when(lower.rlike(run), F.regexp_extract_all(lower, F.lit(f"{run}+"), F.lit(0)))
    found = found.otherwise(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text: str = "text", common: int = COMMON, rare: int = RARE) -> np.ndarray:
    """Sorted hashes of the terms whose inverse document frequency is from ``common`` to ``rare``, counted over all rows."""
    counts = docs.select(F.explode(terms(whole_text(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counts = settle(counts, "terms")
    rows, held = docs.count(), counts.agg(F.sum("n")).first()[0] or 0
    least = max(ceil(rows / 2**rare), ceil(held / LEXICON_MOST))
    inside = counts.where((F.col("n") >= least) & (F.col("n") * 2**common <= rows))
    found = inside.select("term").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One odd factor per order of the lexicon: terms are hashes, so the high bits of a product put them in a random order.
_FACTORS = _mixed(np.arange(1, STREAMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hashes(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with at least one term each: hash of all terms, first subset, and hashes of the subsets (0: no term).

    A sum of scrambled terms does not depend on their order, so it is a hash of the sorted list.
    """
    first = np.rint(np.log2(sizes)).astype(np.uint64)
    whole = np.add.reduceat(_mixed(values), np.cumsum(sizes) - sizes)
    drawn = values[:, None] * _FACTORS
    # Of each order a text has about one term in its first subset, and fewer in the others.
    term, stream = np.nonzero(drawn <= (_ALL >> np.repeat(first, sizes))[:, None])
    text, rank = np.repeat(np.arange(len(sizes)), sizes)[term], drawn[term, stream]
    scrambled = _mixed(values[term] ^ _FACTORS[stream])
    entries = np.zeros((len(sizes), LEVELS, STREAMS), np.uint64)
    for level in range(LEVELS):
        member = rank <= _ALL >> (first[text] + np.uint64(level))
        sums, held = np.zeros((len(sizes), STREAMS), np.uint64), np.zeros((len(sizes), STREAMS), bool)
        np.add.at(sums, (text[member], stream[member]), scrambled[member])
        held[text[member], stream[member]] = True
        entries[:, level] = np.where(held, np.maximum(sums >> np.uint64(48), np.uint64(1)), np.uint64(0))
    return whole, first, entries


def fingerprints_of(values: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> list[str]:
    """Fingerprints of texts given as their term hashes one after another; ``words`` is the lexicon.

    A text none of whose terms are in the lexicon keeps all its terms; a text without terms has zeros.
    """
    out, begin, ends = [], 0, np.cumsum(sizes)
    while begin < len(sizes):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        out += _some_fingerprints(values[base : ends[end - 1]], sizes[begin:end], words)
        begin = end
    return out


def _some_fingerprints(values: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> list[str]:
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.minimum(np.searchsorted(words, values), max(len(words) - 1, 0))
    known = words[place] == values if len(words) else np.zeros(len(values), bool)
    some = np.bincount(text[known], minlength=len(sizes)) > 0
    keep = known | ~some[text]
    values, sizes = values[keep], np.bincount(text[keep], minlength=len(sizes))
    out = ["0" * WIDTH] * len(sizes)
    filled = np.flatnonzero(sizes)
    if len(filled):
        whole, first, entries = _hashes(values, sizes[filled])
        digits, width = entries.astype(">u2").tobytes().hex(), STREAMS * LEVELS * ENTRY
        for k, at in enumerate(filled.tolist()):
            out[at] = f"{int(whole[k]):0{WHOLE}x}{int(first[k]):0{FIRST}x}{digits[k * width : (k + 1) * width]}"
    return out


def likenesses(one: list[str], other: list[str]) -> np.ndarray:
    """For pairs of fingerprints the share of subsets with equal terms among those where either text has terms.

    Only subsets that both fingerprints hold are compared; if none is, the texts differ too much in size, and the
    likeness is 0. Two texts without terms are alike.
    """
    def parsed(prints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), WIDTH // 2)
        cut = (WHOLE + FIRST) // 2
        entries = np.ascontiguousarray(raw[:, cut:]).view(">u2").reshape(len(prints), LEVELS, STREAMS)
        return raw[:, : cut - 1], raw[:, cut - 1].astype(int), entries

    (whole, first, a), (whole_too, first_too, b) = parsed(one), parsed(other)
    agree, held = np.zeros(len(one)), np.zeros(len(one))
    for shift in range(1 - LEVELS, LEVELS):
        at = np.flatnonzero(first_too - first == shift)
        low, high = max(shift, 0), LEVELS + min(shift, 0)
        x, y = a[at, low:high], b[at, low - shift : high - shift]
        agree[at] = ((x == y) & (x > 0)).sum(axis=(1, 2))
        held[at] = ((x > 0) | (y > 0)).sum(axis=(1, 2))
    empty = (a == 0).all(axis=(1, 2)) & (b == 0).all(axis=(1, 2)) & (whole == whole_too).all(axis=1)
    return np.where(empty, 1.0, agree / np.maximum(held, 1))


def fingerprint(docs: DataFrame, words: np.ndarray):
    """A function of a column of text that gives its fingerprint with the lexicon ``words``; NULL counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("string")
    def hashed(found: pa.Array) -> pa.Array:
        values = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
        sizes = np.diff(found.offsets.to_numpy())
        return pa.array(fingerprints_of(values, sizes, shared.value), pa.string())

    return lambda text: hashed(terms(F.coalesce(text, F.lit(""))))


@F.arrow_udf(DoubleType())
def likeness(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array(likenesses(one.to_pylist(), other.to_pylist()) if len(one) else [], pa.float64())


def in_order(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, text, key, mark, slice, guest), and a window in which the row after each row is the next document.

    Documents are ordered by doc_id, NULL last, then by a hash of the text; after the last comes the first. The order is cut
    into slices of about ``slice_chars`` code points; the first row of each is a guest at the end of the slice
    before. Where an id repeats very often its rows are cut as well; only repeats of id and text stay together.
    """
    # Not more than two numbers per slice come to the driver.
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("key")
    rows = docs.select("doc_id", whole_text().alias("text"), key, F.xxhash64(whole_text()).alias("mark"))
    keys = settle(rows.select("key", "mark", F.length("text").alias("n")), "order")
    chars = keys.agg(F.sum("n")).first()[0] or 0
    cut = keys.repartitionByRange(max(1, ceil(chars / slice_chars)), "key", "mark")
    heads = cut.groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "mark")).alias("head")).select("head.*")
    bounds = sorted({tuple(r) for r in heads.collect()})

    @F.arrow_udf("array<int>")
    def slices(one: pa.Array, two: pa.Array) -> pa.Array:
        found = []
        for pair in zip(one.to_pylist(), two.to_pylist()):
            at = bisect_right(bounds, pair) - 1
            found.append([at, (at or len(bounds)) - 1] if bounds[at] == pair else [at])
        return pa.array(found, pa.list_(pa.int32()))

    return rows.withColumn("slices", slices("key", "mark")), Window.partitionBy("slice").orderBy("guest", "key", "mark")


def with_guests(rows: DataFrame) -> DataFrame:
    """Each row in its slice, and again in the slice it is a guest of."""
    placed = rows.select("*", F.posexplode_outer("slices").alias("guest", "slice")).drop("slices")
    return placed.withColumn("guest", F.col("guest") == 1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``, equal for equal texts; the lexicon is that of ``docs``.

    One row per row, repeated rows and NULL ids included; NULL texts count as empty. No rows give no rows.
    """
    return docs.withColumn("fingerprint", fingerprint(docs, lexicon(docs, text))(F.col(text)))


def beside_edited(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Each text beside one of which the second half is the beginning of the next document's, and both fingerprints.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``; of a text
    of n code points the last floor(n / 2) are replaced by as many of the next one, or all it has. For the order of documents
    see ``in_order``; NULL texts count as empty, other columns are not read, no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    hashed = fingerprint(docs, lexicon(docs))
    rows, window = in_order(docs, slice_chars)
    # Fingerprints are made before the shuffle, so a row meets that of the next document as well as its text.
    rows = with_guests(rows.withColumn("print", F.unhex(hashed(F.col("text")))))
    rows = rows.withColumn("next", F.lead("text").over(window)).withColumn("beyond", F.lead("print").over(window))
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - half)
    rows = rows.where(~F.col("guest")).withColumn("edited", F.concat(kept, F.substring("next", F.lit(1), half)))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        "edited",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("beyond")).alias("beyond"),
    )
    rows = rows.withColumn("edited_fingerprint", hashed(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "beyond").alias("near_next"),
    )
