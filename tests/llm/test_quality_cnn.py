import random
import zlib

import numpy as np
import pytest

from souk.llm import quality_cnn as q
from tests.llm.tables import AWKWARD, documents, prose, rows_of


def junk(seed):
    rng = random.Random(seed)
    kind = seed % 3
    words = prose(seed, 80).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(("%%%", "$$$", "###")) for w in words)
    return " ".join(" ".join([w] * 9) for w in words[:20])


def tables(spark, n=240):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60 + i % 200)) for i in range(100, 100 + n)]
    labels = [(i, int(i % 4 != 0), 0) for i, _ in rows]
    labels += [(7, 0, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (99_999, 1, 0), (6, 5, 0)]
    return rows, documents(spark, rows + AWKWARD), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_chunks_cover_every_byte_and_overlap():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes((i * 7 + i // 256) % 251 + 1 for i in range(n)).decode("latin-1").encode("utf-8")
        text = data.decode("utf-8")
        chunks = q.chunks_of(text)
        step = q.CHUNK - q.OVERLAP
        starts = [min(i * step, max(0, len(data) - q.CHUNK)) for i in range(len(chunks))]
        seen = np.zeros(max(len(data), q.CHUNK), bool)
        for s, c in zip(starts, chunks):
            seen[s : s + q.CHUNK] = True
            assert bytes(c).rstrip(b"\0") == data[s : s + q.CHUNK]
        assert seen[: len(data)].all()
    assert len(q.chunks_of("x" * 100_000, 4)) == 4


def test_gradients_move_the_loss_down():
    texts = [junk(i) if i % 2 else prose(i, 90) for i in range(80)]
    labels = np.array([1 - i % 2 for i in range(80)])
    net = q.train([q.chunks_of(t, q.TRAIN_CHUNKS) for t in texts], labels)
    scores = np.array([q.score_text(net, t) for t in texts])
    assert ((scores >= 0.5) == labels).mean() > 0.95


def test_a_score_does_not_depend_on_blocks():
    net = q.train([q.chunks_of(junk(1)), q.chunks_of(prose(2, 90))] * 8, np.array([0, 1] * 8))
    text = prose(3, 9000)
    assert abs(q.score_text(net, text, block=3) - q.score_text(net, text, block=1000)) < 1e-5


def test_held_out_rows_are_scored_well_and_never_learned(spark):
    rows, docs, labels = tables(spark)
    known, _ = q.training_sample(docs, labels)
    usable = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(known) == len(usable)
    found = {r["doc_id"]: r for r in q.scored(docs, labels).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    unseen = [i for i, _ in rows if found[i]["held_out"]]
    right = sum(found[i]["predicted"] == int(i % 4 != 0) for i in unseen)
    assert len(unseen) > 40 and right >= 0.95 * len(unseen)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    # The same again gives the same, and other columns of the rows don't matter.
    again = {r["doc_id"]: r["score"] for r in q.scored(docs.drop("lang", "source"), labels).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in found.items()}, abs=1e-6)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r[0] for r in rows_of(kept, "doc_id")} == {k for k, r in found.items() if r["predicted"]}


def test_the_sample_is_bounded(spark):
    _, docs, labels = tables(spark)
    chunks, known = q.training_sample(docs, labels, most=40)
    assert len(chunks) == 40 and known.sum() == 20


def test_labels_that_teach_nothing(spark):
    docs = documents(spark, AWKWARD)
    schema = "doc_id bigint, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert {r["score"] for r in q.scored(docs, none).collect()} == {1.0}
    assert q.scored(docs, none).count() == len(AWKWARD)
    one = spark.createDataFrame([(4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 0, 0)], schema)
    assert {r["score"] for r in q.scored(docs, one).collect()} == {0.0}
    assert q.scored(docs.where("false"), one).collect() == []
