import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from souk.llm import entries
from souk.llm.spelling_variants import GROUPS, _one_edit, _padded, spelling_forms
from tests.llm.tables import AWKWARD, documents, prose


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, ratio=10):
    """Every word against all others."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def got(spark, counts, **kw):
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, shard string").repartition(4)
    rows = spelling_forms(table, **kw).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_groups_share_no_letter():
    assert len(set("".join(GROUPS))) == len("".join(GROUPS))


def test_one_edit_of_all_pairs():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(150)})
    pairs = [(a, b) for a in words for b in words if len(b) - len(a) in (0, 1)]
    a, b = (_padded(list(side)).astype("S8") for side in zip(*pairs))
    assert _one_edit(a, b).tolist() == [one_edit(x, y) for x, y in pairs]


def vocabulary(seed, size=120):
    rng = random.Random(seed)
    words = {"".join(rng.choice("enàdzß") for _ in range(rng.randint(1, 6))) for _ in range(size)}
    # Anagrams: one leaf holds them all, and neighbours of other length come to it.
    words |= {"".join(rng.sample("zzwxkyyq", 8)) for _ in range(size * 3 // 4)} | {"".join(rng.sample("zzwxkyy", 7)) for _ in range(size // 3)}
    words |= {"b" * 300 + x for x in ("", "b", "c", "cd")}
    return {w: rng.choice((2, 3, 20, 25, 250, 300, 4000)) for w in sorted(words)}


@pytest.mark.parametrize(("shard", "size"), [(1, 30), (7, 60), (40, 120), (20_000, 120)])
def test_forms_are_those_of_all_pairs(spark, shard, size):
    counts = vocabulary(shard, size)
    assert got(spark, counts, shard=shard) == plain(counts)


@pytest.mark.parametrize("shard", [11, 20_000])
def test_large_leaves_compare_by_halves(spark, shard):
    # Single letters have an empty first half.
    counts = {w: 2 for w in vocabulary(5)} | {chr(c): c for c in range(0xC0, 0x100)} | {c: 9 for c in "wxyz"}
    assert got(spark, counts, shard=shard) == plain(counts)


def test_forms_follow_to_the_last(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 19_999, "zzzzzzz": 5}
    want = plain(counts)
    assert want["abcdefg"][1] == "abcdefghij"
    assert got(spark, counts) == want


def test_ties_go_to_the_smallest_code_point(spark):
    counts = {"aaaaaaa": 2, "aaaaaaz": 20, "aaaaaaà": 20, "aaaaaab": 20}
    assert got(spark, counts)["aaaaaaa"] == ("aaaaaab", "aaaaaab", 2, 3, 20)


def test_awkward_tables(spark):
    table = spark.createDataFrame([(None, 3), ("word", 2)], "word string, n int")
    assert [tuple(r) for r in spelling_forms(table).collect()] == [("word", None, "word", 2, 0, None)]
    assert spelling_forms(table.where("false")).collect() == []
    with pytest.raises(ValueError):
        spelling_forms(table, ratio=1)


def test_the_query_counts_words_after_deletions(spark, tmp_path):
    rng = random.Random(3)
    rows = list(AWKWARD) + [(50 + k, prose(k % 9, 60).replace("e", rng.choice("eéÊx"))) for k in range(60)]
    rows += [(200 + k, f"HOMEPAGE-address{'s' * (k % 2)} × naïveté’s Überschrift ÷×÷×÷×÷ 12345678") for k in range(40)] + [(None, "address address")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    counts, lost = Counter(), 0
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run, lost = run[:at] + run[at + 1 :], lost + 1
                counts[run] += 1
            run = ""
    want = plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert lost > 10 and any(v[0] for v in want.values())
    rows = entries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want
