import random

import pytest
from pyspark.sql import functions as F

from souk.llm import block_identity
from souk.llm.block_identity import block_identities, exact_groups, without_copies
from tests.llm.tables import AWKWARD, documents, prose, rows_of


def expected(rows):
    """Groups by the normalised text itself."""
    normal = []
    for _, t in rows:
        out, gap = [], False
        for c in t or "":
            if c in " \t\n\x0b\x0c\r":
                gap or out.append(" ")
                gap = True
            else:
                out.append(c)
                gap = False
        normal.append("".join(out))
    order = lambda i: (i is None, i or 0)
    found = []
    for (doc, _), text in zip(rows, normal):
        group = [d for (d, _), t in zip(rows, normal) if t == text]
        found.append((doc, min(group, key=order), len(group)))
    return sorted(found, key=str)


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_are_those_of_equal_texts(spark, block):
    rng = random.Random(3)
    rows = list(AWKWARD)
    # Texts over few blocks: equal beginnings, ends, middles and lengths that differ by one block.
    rows += [(100 + i, "".join(rng.choice(("abcd", "efgh", "ij")) for _ in range(rng.randint(1, 7)))) for i in range(120)]
    groups = exact_groups(documents(spark, rows, 5), block)
    assert rows_of(groups, "doc_id", "keep_id", "group_size") == expected(rows)
    stays = [r for r in groups.collect() if r["kept"]]
    assert len(stays) == groups.select("keep_id", "text_sha256").distinct().count()
    assert all(r["doc_id"] == r["keep_id"] for r in stays)


def test_a_hot_block_crosses_slices(spark):
    # One block is nine tenths of all rows, over more slices than it could meet in one.
    rows = [(i, "hot block") for i in range(300)] + [(1000 + i, f"cold {i}") for i in range(30)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = block_identities(documents(spark, rows))
        assert ids.select("level", "name").distinct().count() == 31
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_of_one_hash_are_told_apart(spark, monkeypatch):
    # All blocks hash alike, so they lie in the order of their rows and meet at every border.
    monkeypatch.setattr(block_identity, "_hash", lambda key: F.lit(1).cast("bigint"))
    clashes = []
    bases = block_identity._bases

    def seen(runs, keys):
        found = bases(runs, keys)
        clashes.append(keys == ["block"] and not found.where("clash").isEmpty())
        return found

    monkeypatch.setattr(block_identity, "_bases", seen)
    rows = [(i, f"text {i % 7}") for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = block_identities(documents(spark, rows)).select("doc_id", "level", "name").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({(r["level"], r["name"]) for r in ids}) == 7
    assert all(len({r["name"] for r in ids if r["doc_id"] % 7 == k}) == 1 for k in range(7))
    assert clashes[0]


def test_a_very_long_text_and_its_copy(spark):
    long = prose(5, 40_000)
    rows = [(1, long), (2, long), (3, long + "x"), (4, "x" + long)]
    assert rows_of(exact_groups(documents(spark, rows)), "doc_id", "keep_id") == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_kept_rows_have_all_their_columns(spark):
    table = documents(spark, AWKWARD)
    kept = without_copies(table)
    assert kept.columns == table.columns
    assert rows_of(kept, "doc_id") == [(1,), (3,), (4,), (5,), (6,), (7,), (None,)]


def test_an_empty_table(spark):
    table = documents(spark, AWKWARD).where("false")
    assert exact_groups(table).collect() == []
    assert without_copies(table).collect() == []
