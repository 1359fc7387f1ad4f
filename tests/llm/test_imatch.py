import hashlib
import random
import re

import numpy as np
import pytest

from souk.llm import entries
from souk.llm.imatch import FIRST, LEVELS, STREAMS, WHOLE, WIDTH, beside_edited, fingerprints, fingerprints_of, lexicon, likenesses
from tests.llm.tables import AWKWARD, documents, prose, rows_of


def plain_terms(text):
    low = (text or "").lower()
    return set(re.findall(r"[^\W_]+", low)) or set(low.encode().split())


def next_of(spark, rows):
    """The following document of each row: by id, NULL last, then by hash of the text."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(k, d, t or "") for k, (d, t) in enumerate(rows)], "k int, d bigint, t string")
    marks = {r["k"]: r["m"] for r in table.select("k", F.xxhash64("t").alias("m")).collect()}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, marks[k]))
    return {k: order[(at + 1) % len(order)] for at, k in enumerate(order)}


def edited_text(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


ROWS = list(AWKWARD) + [(20 + k, prose(100 + k, 30 + k)) for k in range(60)] + [(None, "zwei Zeilen ohne Nummer: ÄÖÜ 😀😀😀")]


@pytest.mark.parametrize("slice_chars", [200, 3000, 10**7])
def test_edited_texts_and_likenesses(spark, slice_chars):
    after = next_of(spark, ROWS)
    rows = beside_edited(documents(spark, ROWS, 5), slice_chars).collect()
    texts = [t or "" for _, t in ROWS]
    want = sorted((str(d), len(texts[k]), edited_text(texts[k], texts[after[k]])) for k, (d, _) in enumerate(ROWS))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in rows) == want
    prints = dict(zip(((d, t or "") for d, t in ROWS), [None] * len(ROWS)))
    for r in fingerprints(documents(spark, ROWS, 3)).collect():
        prints[r["doc_id"], r["text"] or ""] = r["fingerprint"]
    by_row = {(str(r["doc_id"]), r["edited"]): r for r in rows}
    for k, (d, _) in enumerate(ROWS):
        r = by_row[str(d), edited_text(texts[k], texts[after[k]])]
        beyond = prints[ROWS[after[k]][0], texts[after[k]]]
        assert r["fingerprint"] == prints[d, texts[k]]
        assert r["near_edited"] == likenesses([r["fingerprint"]], [r["edited_fingerprint"]])[0]
        assert r["near_next"] == likenesses([r["fingerprint"]], [beyond])[0]


def test_lexicon_holds_the_terms_of_the_band(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"all {'some' if k % 4 == 0 else 'x'} {'few' if k % 16 == 0 else ''} only{k}") for k in range(64)]
    found = set(lexicon(documents(spark, rows), common=2, rare=4).view(np.int64).tolist())
    hashed = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in ("all", "some", "x", "few", "only3")}
    assert {t for t, h in hashed.items() if h in found} == {"some", "few"}


def plain_print(values, words):
    """One text by the definition: every subset as a set, hashed over its sorted terms."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    kept = sorted(set(values) & set(words)) or sorted(set(values))
    if not kept:
        return "0" * WIDTH
    first = round(np.log2(len(kept)))
    out = f"{sum(map(mixed, kept)) & mask:016x}{first:02x}"
    for level in range(first, first + LEVELS):
        for s in range(1, STREAMS + 1):
            factor = mixed(s * 0x9E3779B97F4A7C15 & mask) | 1
            chosen = [v for v in kept if v * factor & mask <= mask >> level]
            total = (sum(mixed(v ^ factor) for v in chosen) & mask) >> 48
            out += f"{max(total, 1) if chosen else 0:04x}"
    return out


def test_fingerprints_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr("souk.llm.imatch.AT_ONCE", 50)
    rng = random.Random(2)
    words = np.array(sorted(rng.getrandbits(64) for _ in range(400)), np.uint64)
    texts = [[int(words[rng.randrange(400)]) for _ in range(n)] + [rng.getrandbits(64) for _ in range(extra)] for n, extra in ((0, 0), (0, 5), (1, 2), (7, 0), (90, 9), (300, 0))]
    texts = [sorted(set(t), key=lambda _: rng.random()) for t in texts]
    got = fingerprints_of(np.array([v for t in texts for v in t], np.uint64), np.array([len(t) for t in texts]), words)
    assert got == [plain_print(t, words.tolist()) for t in texts]


def test_likeness_falls_with_the_share_of_changed_terms():
    rng = np.random.default_rng(5)
    nothing = np.zeros(0, np.uint64)
    for m in (12, 100, 2000):
        means = []
        for share in (0.0, 0.05, 0.25, 0.5, 1.0):
            found = []
            for _ in range(30):
                one = rng.integers(1, 1 << 63, m).astype(np.uint64)
                two = one.copy()
                two[: round(share * m)] = rng.integers(1, 1 << 63, round(share * m))
                a, b = fingerprints_of(np.r_[one, two], np.array([m, m]), nothing)
                found.append(likenesses([a], [b])[0])
            means.append(np.mean(found))
        assert means[0] == 1 and means[4] < 0.01
        assert all(a > b + 0.02 for a, b in zip(means, means[1:]))


def test_texts_of_very_unlike_size_and_empty_ones():
    values = np.arange(1, 1002, dtype=np.uint64)
    long, short, empty = fingerprints_of(values, np.array([1000, 1, 0]), np.zeros(0, np.uint64))
    assert likenesses([long, empty, empty, short], [short, empty, short, short]).tolist() == [0.0, 1.0, 0.0, 1.0]
    assert (len(long), WHOLE, FIRST) == (WIDTH, 16, 2)


def test_the_query_and_equal_texts(spark, tmp_path):
    rows = ROWS + [(300, prose(101, 31)), (301, "")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = entries.QUERIES["op11_imatch"](spark, str(tmp_path)).collect()
    after = next_of(spark, rows)
    texts = [t or "" for _, t in rows]
    sha = lambda k: hashlib.sha256(edited_text(texts[k], texts[after[k]]).encode()).hexdigest()
    want = sorted((str(d), sha(k)) for k, (d, _) in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[300]["fingerprint"] == by_id[21]["fingerprint"] != by_id[22]["fingerprint"]
    assert by_id[301]["fingerprint"] == by_id[1]["fingerprint"] == by_id[2]["fingerprint"]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_halves_stay_nearer_than_the_next_document(spark):
    rows = [(k, " ".join(f"w{random.Random(k * 1000 + i).randrange(3000)}" for i in range(120))) for k in range(300)]
    got = beside_edited(documents(spark, rows)).select("near_edited", "near_next").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 285


def test_tables_of_one_row_and_none(spark):
    one = beside_edited(documents(spark, [(7, "alone here")])).collect()
    assert [(r["edited"], r["near_next"]) for r in one] == [("alonealone", 1.0)]
    assert beside_edited(documents(spark, AWKWARD).where("false")).collect() == []
    assert fingerprints(documents(spark, AWKWARD)).columns[:2] == ["doc_id", "text"]
    assert rows_of(fingerprints(documents(spark, AWKWARD)), "doc_id") == sorted([(d,) for d, _ in AWKWARD], key=str)
