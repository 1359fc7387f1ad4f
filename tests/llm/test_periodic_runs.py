import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import entries
from souk.llm.periodic_runs import LEAST, PERIODS, _stretches, lyndon_array, runs_of, with_runs
from tests.llm.tables import AWKWARD, documents, prose


def plain_lyndon(s):
    """Longest Lyndon word at each place: a word is one if it is less than all its proper suffixes."""
    return [max(m for m in range(1, len(s) - i + 1) if all(s[i : i + m] < s[k : i + m] for k in range(i + 1, i + m))) for i in range(len(s))]


def plain_runs(s):
    """Every stretch of every period, extended to both sides; of one stretch the smallest period counts."""
    found, n = {}, len(s)
    for p in range(1, n // PERIODS + 1):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and s[k] == s[k + p]:
                k += 1
            length = k + p - i
            if k > i and length >= max(LEAST, PERIODS * p) and not any(i >= a and i + length <= a + m for (a, m) in found if p % found[a, m] == 0):
                found[i, length] = p
            i = k + 1 if k > i else i + 1
    return sorted(((a, m, p) for (a, m), p in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=24))
def test_grouping_gives_the_lyndon_array(s):
    assert lyndon_array(np.array(s)).tolist() == plain_lyndon(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), min_size=1, max_size=6))
def test_runs_are_those_of_brute_force(parts):
    s = [x for root, times in parts for x in root * times]
    ids = np.array(s)
    assert runs_of(ids) == plain_runs(s)
    parts = _stretches(ids, np.array([0, len(s)])).get(0)
    assert (runs_of(ids, parts) if parts else []) == plain_runs(s)


def test_a_stretch_is_not_taken_over_the_border_of_texts():
    ids = np.array([1, 2] * 3 + [1, 2] * 3)
    assert _stretches(ids, np.array([0, 6, 12])) == {}
    assert 0 in _stretches(ids, np.array([0, 12]))


def collapsed(words, runs):
    return [w for k, w in enumerate(words) if not any(s + p <= k < s + m for s, m, p in runs)]


def test_texts_of_a_table(spark):
    rng = random.Random(8)
    rows = list(AWKWARD) + [(9, "ha " * 50_000), (10, "ha ha ha\tha\nha"), (11, "a b " * 4 + "c"), (12, "x y " * 6)]
    for k in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        root = words[-rng.randint(1, 7) :]
        rows.append((100 + k, " ".join(words + root * rng.randint(0, 7) + [rng.choice("abc") for _ in range(5)])))
    got = with_runs(documents(spark, rows, 4)).collect()
    found = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    want = []
    for doc, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 1000 else [] if len(set(words)) > 1 else [(0, len(words), 1)]
        want.append((str(doc), runs, " ".join(collapsed(words, runs))))
    assert found == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_query_changes_one_text_in_ten_and_digests_its_runs(spark, tmp_path, seed):
    import hashlib
    import zlib

    rows = [(seed * 1000 + k, prose(seed * 1000 + k, k % 47)) for k in range(150)] + [(None, "a row without id"), (seed, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in entries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    changed = 0
    for doc, text in rows:
        words = (text or "").split()
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(collapsed(words, runs)))
    assert changed > 3


def test_an_empty_table(spark):
    assert with_runs(documents(spark, AWKWARD).where("false")).collect() == []
