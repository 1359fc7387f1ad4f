import random

from souk.llm import decontamination as d
from tests.llm.tables import AWKWARD, CLASHING, documents, prose, rows_of


def plain_best(text, item):
    """Best weighted similarity of any item-sized window, over all windows."""
    words, want = d.words_of(text), d.words_of(item)
    n = len(want)
    if n >= 5 and not set(zip(*[words[k:] for k in range(5)])) & set(zip(*[want[k:] for k in range(5)])):
        return 0.0
    if n < 5:
        return 1.0 if words == want and words else 0.0
    return max((d.weighted_similarity(words[i : i + n], want) for i in range(max(1, len(words) - n + 1))), default=0.0)


def items():
    rng = random.Random(8)
    return [(k, prose(1000 + k, rng.choice((3, 5, 6, 9, 14, 15, 22, 27, 28, 40, 48, 49, 60, 90, 120, 400)))) for k in range(60)]


def changed(rng, text):
    """A passage with one word replaced, added or left out, or in other case and punctuation."""
    words = text.split()
    at = rng.randrange(len(words))
    kind = rng.randrange(4)
    if kind == 0:
        words[at] = "other"
    elif kind == 1:
        words.insert(at, "more")
    elif kind == 2:
        del words[at]
    else:
        return ", ".join(text.upper().split())
    return " ".join(words)


def test_every_similar_passage_is_found():
    """Against all windows: what reaches 0.8 is found, and nothing else."""
    rng = random.Random(9)
    known = items()
    index = d.Index(known, d.RADIUS)
    known_words, near = d.WordHashes(), 0
    for k, text in known:
        for turn in range(8):
            passage = text if turn == 0 else changed(rng, text)
            whole = f"{prose(turn, 30)} {passage} {prose(k + 77, 25)}" if len(text.split()) >= 5 else passage
            found = {m[1]: m[4] for m in index.search([prose(1, 9), whole], known_words) if m[0] == 1}
            for j, other in known:
                best = plain_best(whole, other)
                if best >= d.SIMILARITY:
                    near += 1
                    assert j in found, (j, best)
                else:
                    assert j not in found or len(d.words_of(other)) != len(d.words_of(whole))
    assert near > 200


def test_the_blocks_find_all_fingerprints_within_the_radius():
    import numpy as np

    index = d.Index(items(), d.RADIUS)
    rng = np.random.default_rng(1)
    for prints, _, _, tables in index.sizes.values():
        for _ in range(300):
            p = int(prints[rng.integers(len(prints))])
            for b in rng.choice(64, d.RADIUS, replace=False):
                p ^= 1 << int(b)
            reached = set()
            for low, mask, begin, order in tables:
                key = int((np.uint64(p) >> low) & mask)
                reached.update(order[begin[key] : begin[key + 1]].tolist())
            near = np.nonzero(np.bitwise_count(prints ^ np.uint64(p)) <= d.RADIUS)[0]
            assert set(near.tolist()) <= reached


def test_windows_do_not_depend_on_steps(monkeypatch):
    import numpy as np

    hashes = d.shingle_hashes(d.WordHashes().of(d.words_of(prose(3, 700))))
    starts = {size: d.window_starts(700, size, stride) for size, stride in ((16, 8), (8, 6), (5, 3))}
    whole = d.window_prints(hashes, starts)
    monkeypatch.setattr(d, "STEP", 37)
    for size, prints in d.window_prints(hashes, starts).items():
        assert np.array_equal(prints, whole[size])
        wide = size - d.SHINGLE + 1
        for at, p in zip(starts[size], prints):
            bits = [sum(int(h) >> b & 1 for h in hashes[at : at + wide]) for b in range(64)]
            assert int(p) == sum(1 << b for b in range(64) if 2 * bits[b] > wide)


def test_documents(spark):
    known = items()
    rows = [*AWKWARD, (30, f"{prose(1, 200)} {known[3][1]} {prose(2, 9000)}"), (31, known[20][1]), (31, known[20][1])]
    rows += [(None, f"x {known[30][1]} y"), (33, prose(44, 3000))]
    bench = spark.createDataFrame(known + [(900, None), (901, ""), (None, known[20][1]), (20, known[20][1])], "item_id bigint, text string")
    bench = bench.selectExpr("*", *[f"1 as `{c}`" for c in CLASHING])
    table = documents(spark, rows)
    want = {(doc, k) for doc, text in rows for k, item in known if plain_best(text, item) >= d.SIMILARITY}
    found = d.contaminations(table, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect() if r["item_id"] is not None} == want
    clean = d.without_benchmark(table, bench)
    assert clean.columns == table.columns
    leaks = {(doc, text) for doc, text in rows for _, item in known if plain_best(text, item) >= d.SIMILARITY}
    assert rows_of(clean, "doc_id", "text") == sorted((r for r in rows if r not in leaks), key=str)


def test_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(d.item_blocks, "__defaults__", (50,))
    known = [(k, t) for k, t in items() if len(t.split()) >= 5][:12]
    bench = spark.createDataFrame(known, "item_id bigint, text string")
    assert len(list(d.item_blocks(bench))) > 3
    table = documents(spark, [(k, f"a b {t} c d") for k, t in known])
    assert {(k, k) for k, _ in known} <= set(rows_of(d.contaminations(table, bench), "doc_id", "item_id"))
    assert d.without_benchmark(table, bench).count() == 0


def test_empty_tables(spark):
    table = documents(spark, AWKWARD)
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    assert d.contaminations(table.where("false"), bench).collect() == []
    assert d.contaminations(table, bench.where("false")).collect() == []
    assert d.without_benchmark(table, bench.where("false")).count() == len(AWKWARD)
