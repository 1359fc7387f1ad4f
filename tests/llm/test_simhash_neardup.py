import numpy as np
import xxhash

from souk.llm import simhash_neardup as s
from tests.llm.tables import AWKWARD, documents, prose, rows_of


def plain_fingerprint(text):
    """The contract word for word, one bit at a time."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(prints, radius):
    """Smallest index reachable, over all pairs."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return [find(i) for i in range(len(prints))]


def linked_classes(points, radius, links):
    at = {int(p): i for i, p in enumerate(points)}
    label = list(range(len(points)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        for x, y in zip(a, b):
            low, high = sorted((find(at[int(x)]), find(at[int(y)])))
            label[high] = low
    return [find(i) for i in range(len(points))]


def clustered(rng, centres, around, flips):
    """Fingerprints in clusters of a few flipped bits, in sorted order."""
    out = set()
    for c in rng.integers(0, 2**63, centres, dtype=np.uint64) * 2:
        for _ in range(around):
            bits = rng.choice(64, rng.integers(0, flips + 1), replace=False)
            out.add(int(c) ^ sum(1 << int(b) for b in bits))
    return np.array(sorted(out), np.uint64)


def test_fingerprints_follow_the_contract():
    for text in [None, "", " \t", "One", "ÀB c", "a b c", "a a a a a a", "Ünï İx y z " * 3, prose(2, 500)]:
        assert s.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_steps_do_not_change_a_long_text(monkeypatch):
    whole = s.fingerprint(prose(9, 5000))
    monkeypatch.setattr(s, "STEP", 7)
    assert s.fingerprint(prose(9, 5000)) == whole


def test_a_shard_links_all_pairs_within_the_radius():
    rng = np.random.default_rng(4)
    for centres, around, flips in ((700, 2, 3), (30, 40, 4), (1, 900, 2)):
        points = clustered(rng, centres, around, flips)
        want = plain_classes([int(p) for p in points], 2)
        assert linked_classes(points, 2, s.shard_links(points, 2)) == want
        assert linked_classes(points, 2, s._enumerated(points, 2)) == want


def test_links_stay_in_proportion_to_points():
    points = clustered(np.random.default_rng(5), 1, 3000, 2)
    assert sum(len(a) for a, _ in s.shard_links(points, 2)) <= 3 * len(points)


def test_routed_shards_together_hold_every_close_pair():
    rng = np.random.default_rng(6)
    points = clustered(rng, 800, 3, 2)
    tree = s.routes(points, 4, 2)
    assert tree
    shards = dict(s.route(tree, points, 2))
    homes = {int(p): {k for k, v in shards.items() if p in v} for p in points}
    for i, a in enumerate(points):
        for b in points[:i][np.bitwise_count(points[:i] ^ a) <= 2]:
            assert homes[int(a)] & homes[int(b)]


def test_components_over_shards(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_SIZE", 256)
    points = clustered(np.random.default_rng(7), 400, 5, 3)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    found = s.fingerprint_links(table, 2).collect()
    links = [(np.array([r["fp"] for r in found]).view(np.uint64), np.array([r["root"] for r in found]).view(np.uint64))]
    assert linked_classes(points, 2, links) == plain_classes([int(p) for p in points], 2)


def test_documents(spark):
    base = prose(11, 400)
    rows = [*AWKWARD, (20, base), (21, base.upper()), (22, base + " end"), (23, prose(12, 400))]
    found = s.near_duplicates(documents(spark, rows))
    prints = [plain_fingerprint(t) for _, t in rows]
    order = lambda d: (d is None, d or 0)
    classes = plain_classes(prints, 2)
    first = [min((d for (d, _), c in zip(rows, classes) if c == k), key=order) for k in classes]
    want = sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, first)), key=str)
    assert rows_of(found, "doc_id", s.hex_fingerprint(), "component_id") == want


def test_one_of_each_group_stays(spark):
    base, other = prose(11, 400), prose(12, 300)
    rows = [(9, base), (3, base), (5, other), (None, prose(13, 300)), (None, base), (7, base), (7, prose(14, 300)), (8, other)]
    rows += [(10, prose(15, 300))] * 3
    table = documents(spark, rows)
    kept = s.without_near_copies(table)
    assert kept.columns == table.columns
    want = [(3, base), (5, other), (7, prose(14, 300)), (10, prose(15, 300)), (None, prose(13, 300))]
    assert rows_of(kept, "doc_id", "text") == sorted(want, key=str)


def test_texts_are_not_shuffled_where_few_rows_go(spark):
    table = spark.createDataFrame([(i, prose(i // 2 if i < 20 else i, 12)) for i in range(20_000)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        kept = s.without_near_copies(table)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert {r["doc_id"] for r in kept.where("doc_id < 20").collect()} == set(range(0, 20, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_an_empty_table(spark):
    table = documents(spark, AWKWARD).where("false")
    assert s.near_duplicates(table).collect() == []
    assert s.without_near_copies(table).collect() == []
