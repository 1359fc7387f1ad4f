"""Quality scores from a byte-level convolutional network, trained and run in numpy.

A text is read as UTF-8 bytes in overlapping chunks that together cover all of it. Each byte is
embedded, and beside the embedding stands a flag for each of a few distances that says whether
the same pair of bytes stood that far before; learned filters slide over windows of both. Each
filter is max-pooled within a chunk; the chunk maxima are combined into their mean and their
maximum over the document, and a logistic layer turns those into one probability.

Training takes a bounded sample of labelled rows, the same rows in every run, and a bounded
number of chunks spread over each of them. Scoring reads every chunk of every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, whole_text

#: Labelled rows and chunks of each that training takes at most.
TRAIN_ROWS = 2400
TRAIN_CHUNKS = 4
THRESHOLD = 0.7

CHUNK = 512
OVERLAP = 64
WIDTH = 8
STRIDE = 4
EMBED = 8
LAGS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20])
FILTERS = 32
#: Steps of training and rows of a step; a small sample is gone through more often.
STEPS = 600
BATCH = 32
RATE = 0.01

#: Places of the windows in a chunk, as rows of byte positions.
_WINDOWS = np.arange(0, CHUNK - WIDTH + 1, STRIDE)[:, None] + np.arange(WIDTH)[None, :]


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (WIDTH * EMBED + lags) x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights]


def chunks_of(text: str | None, most: int | None = None) -> np.ndarray:
    """Overlapping chunks of the UTF-8 bytes, n x CHUNK, the last one moved back to end with the text.

    A text shorter than a chunk is padded with zero bytes, an empty one is one chunk of them.
    With ``most``, that many chunks at even distances over the whole text.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < CHUNK:
        data = np.concatenate((data, np.zeros(CHUNK - len(data), np.uint8)))
    starts = np.arange(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP)
    starts = np.minimum(starts, len(data) - CHUNK)
    if most and len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    return data[starts[:, None] + np.arange(CHUNK)[None, :]]


def _repeats(chunks: np.ndarray) -> np.ndarray:
    """For each window and distance, the share of its bytes that repeat the byte pair so far before."""
    flags = np.zeros((len(LAGS), len(chunks), CHUNK), np.uint8)
    for k, lag in enumerate(LAGS):
        same = chunks[:, lag:] == chunks[:, :-lag]
        flags[k, :, lag + 1 :] = same[:, 1:] & same[:, :-1] & (chunks[:, lag + 1 :] > 0)
    steps = flags.reshape(len(LAGS), len(chunks), CHUNK // STRIDE, STRIDE).sum(3, dtype=np.uint8)
    in_window = sum(steps[:, :, k : k + len(_WINDOWS)] for k in range(WIDTH // STRIDE))
    return np.moveaxis(in_window, 0, 2).astype(np.float32) / np.float32(WIDTH)


def _inputs(net: Network, chunks: np.ndarray) -> np.ndarray:
    """n x windows x (WIDTH * EMBED + lags)."""
    seen = net.embed[chunks]
    step = seen.strides
    windows = np.lib.stride_tricks.as_strided(
        seen, (len(chunks), len(_WINDOWS), WIDTH * EMBED), (step[0], step[1] * STRIDE, step[2]), writeable=False
    )
    inputs = np.empty((len(chunks), len(_WINDOWS), WIDTH * EMBED + len(LAGS)), np.float32)
    inputs[:, :, : WIDTH * EMBED] = windows
    inputs[:, :, WIDTH * EMBED :] = _repeats(chunks)
    return inputs


def _pooled(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter maxima per chunk, where they were found, and the inputs."""
    inputs = _inputs(net, chunks)
    out = inputs.reshape(-1, inputs.shape[2]) @ net.filters
    out = out.reshape(len(chunks), len(_WINDOWS), FILTERS) + net.bias
    at = out.argmax(1)
    return np.maximum(np.take_along_axis(out, at[:, None, :], 1)[:, 0], 0), at, inputs


def _probability(net: Network, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))


def score_text(net: Network, text: str | None, block: int = 64) -> float:
    """Probability of label 1 for one whole text; memory holds ``block`` chunks at a time."""
    chunks = chunks_of(text)
    total, most = np.zeros(FILTERS), np.zeros(FILTERS)
    for at in range(0, len(chunks), block):
        pooled = _pooled(net, chunks[at : at + block])[0]
        total += pooled.sum(0)
        most = np.maximum(most, pooled.max(0))
    return float(_probability(net, np.concatenate((total / len(chunks), most))))


def train(chunks: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit the network to documents given as their chunks; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        small(WIDTH * EMBED + len(LAGS), FILTERS),
        np.zeros(FILTERS, np.float32),
        (small(2 * FILTERS) * 0.1).astype(np.float32),
        0.0,
    )
    counts = np.bincount(labels, minlength=2)
    # Each label weighs by the root of its rarity: rare rows count, and scores stay near frequencies.
    balance = np.sqrt(len(labels) / (2 * np.maximum(counts, 1)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (*net.parameters(), np.zeros(1))]
    step = 0
    while step < STEPS:
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            owner = np.repeat(np.arange(len(rows)), [len(chunks[r]) for r in rows])
            batch = np.concatenate([chunks[r] for r in rows])
            pooled, where, inputs = _pooled(net, batch)
            n = np.bincount(owner, minlength=len(rows))[:, None]
            mean = np.zeros((len(rows), FILTERS), np.float32)
            np.add.at(mean, owner, pooled)
            mean /= n
            most = np.zeros_like(mean)
            np.maximum.at(most, owner, pooled)
            features = np.concatenate((mean, most), 1)
            y = labels[rows]
            error = (_probability(net, features) - y) * balance[y] / len(rows)
            back = (error[:, None] * net.weights[None, :]).astype(np.float32)
            grad = (back[:, :FILTERS] / n)[owner] + back[owner, FILTERS:] * (pooled == most[owner])
            grad *= pooled > 0
            rows_at = np.arange(len(batch))[:, None]
            picked = inputs[rows_at, where]  # chunk x filter x input
            d_filters = np.einsum("cfi,cf->if", picked, grad)
            d_inputs = (grad[:, :, None] * net.filters.T[None])[:, :, : WIDTH * EMBED]
            bytes_at = batch[rows_at[:, :, None], _WINDOWS[where]]  # chunk x filter x position
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, bytes_at.ravel(), d_inputs.reshape(-1, EMBED))
            grads = [d_embed, d_filters, grad.sum(0), features.T @ error + 1e-4 * net.weights, np.array([error.sum()])]
            step += 1
            rate = RATE * max(0.05, 1 - step / STEPS)
            moved = []
            for g, (m, v) in zip(grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                moved.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            for p, d in zip(net.parameters(), moved):
                p -= d.astype(np.float32)
            net.offset -= float(moved[-1][0])
    return net


def held_out() -> Column:
    """Rows whose labels are never learned: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of at most ``most`` labelled rows, half of each label as far as there are any.

    The rows are picked by a hash of their id, so that every run and every table size takes them alike.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    usable = usable.where("label = other").select("doc_id", "label")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    half = [usable.where(F.col("label") == v).orderBy(*order).limit(most // 2) for v in (0, 1)]
    picked = half[0].unionByName(half[1])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"],
                    "label": rows["label"],
                    "chunks": [chunks_of(t, TRAIN_CHUNKS).tobytes() for t in rows["text"]],
                }
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    # At most ``most`` ids: small enough to go to every task.
    sample = texts.join(F.broadcast(picked), "doc_id").mapInPandas(cut, "doc_id bigint, label int, chunks binary")
    # Repeated rows of one id count once.
    rows = sample.groupBy("doc_id", "label").agg(F.min("chunks").alias("chunks")).orderBy(*order).collect()
    return [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows], np.array(
        [r["label"] for r in rows], np.int64
    )


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Callable[[str | None], float]:
    """A function from a text to its score.

    Labels other than 0 and 1, ids with both labels and held-out ids are not learned from. If the
    learnable labels are all alike, every score is that label; if there are none, every score is 1,
    as nothing speaks against any row. An empty or NULL text is scored as zero bytes.
    """
    chunks, known = training_sample(docs, labels, most)
    if len(set(known.tolist())) < 2:
        fixed = float(known[0]) if len(known) else 1.0
        return lambda text: fixed
    net = train(chunks, known)
    return lambda text: score_text(net, text)


def scored(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; only text enters a score."""
    score = fitted(docs, labels, most)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["doc_id", "held_out"]].assign(score=[score(t) for t in rows["text"]])

    slim = docs.select(id_text(), held_out().alias("held_out"), whole_text().alias("text"))
    marked = slim.mapInPandas(mark, "doc_id string, held_out boolean, score double")
    marked = marked.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return marked.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` the classifier accepts, all columns."""
    one = fitted(docs, labels, most)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(one).astype("float64")

    return docs.where(score(whole_text()) >= THRESHOLD)
