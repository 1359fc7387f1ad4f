import hashlib
import random
import re
import string

from souk.llm import secrets as s
from tests.llm.tables import AWKWARD, documents, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def value(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def corpus():
    rng = random.Random(2)
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    rows = [(100 + i, f"{prose(i, 40)} password = {value(rng, mixed, 32)} {prose(i + 50, 30)}") for i in range(150)]
    rows += [(300 + i, f"{prose(i, 90)} handle_incoming_connection_requests getCustomerAddressByIdentifier {prose(i, 9)}") for i in range(40)]
    rows += [
        (1000, "Ü𝒳 api_key: 'abc' token=short token=longer6 PASSWORD= \"x.y/z+1\""),
        (1001, "secret = token=abcdef password=abcde:token:abcdefgh passwd :: abcdefg"),
        (1002, f"AKIA{'B' * 16} AKIA{'B' * 15} xAKIAAKIA{'9' * 14}"),
        (1003, f"{value(rng, hexes, 24)} {value(rng, hexes, 23)} g{value(rng, hexes, 40)}g sha=deadbeef"),
        (1004, f"{prose(3, 5000)} {value(rng, mixed, 40)} {'a' * 30_000} {value(rng, hexes, 64)}"),
        (1005, f"see {value(rng, mixed, 40)} there"),
    ]
    return [*AWKWARD, *rows]


def test_known_spans_and_what_the_model_adds(spark):
    rows = corpus()
    found = s.with_secrets(documents(spark, rows)).select(
        "doc_id", s.span_text("base").alias("base"), s.span_text("found").alias("found"), "known"
    )
    got = sorted(((r["doc_id"], r["base"]) for r in found.collect()), key=str)
    assert got == sorted(((d, ",".join(plain_spans(t))) for d, t in rows), key=str)
    texts = dict(rows)
    added = {}
    for r in found.collect():
        spans = [x for x in r["found"].split(",") if x]
        assert [x for x in spans if not x.startswith("markov")] == plain_spans(texts.get(r["doc_id"]))
        assert spans == sorted(spans, key=lambda x: int(x.split(":")[1])) or len(spans) < 2 or r["doc_id"] is None
        added[r["doc_id"]] = [texts[r["doc_id"]][int(a) : int(b)] for k, a, b in (x.split(":") for x in spans) if k == "markov"]
    # The model finds bare random strings, and no ordinary identifier or repeated letter.
    assert [len(x) for x in added[1005]] == [40] and 40 in [len(x) for x in added[1004]]
    assert not any(added[300 + i] for i in range(40))
    assert all(len(x) == 40 for x in added[1004])
    digest = found.where("doc_id = 1").collect()[0]["base"]
    assert hashlib.sha256(digest.encode()).hexdigest().startswith("e3b0c442")


def test_ratios_are_those_of_plain_counts(spark):
    import math
    from collections import Counter

    strings = [(True, "x9Qz"), (True, "9Q9Q"), (False, "name"), (False, "same_name")]
    ratios = s.pair_ratios(spark.createDataFrame(strings, "secret boolean, string string"))
    counts = {label: Counter() for label in (True, False)}
    for label, text in strings:
        counts[label].update(set(zip(text, text[1:])))
    for a, b in ("9Q", "me", "zz", "na"):
        p = {}
        for label, c in counts.items():
            second = (sum(n for (_, y), n in c.items() if y == b) + 0.5) / (sum(c.values()) + 0.5 * s.SYMBOLS)
            p[label] = (c[a, b] + s.BACK * second) / (sum(n for (x, _), n in c.items() if x == a) + s.BACK)
        at = (ord(a) - s.FIRST) * s.SYMBOLS + ord(b) - s.FIRST
        assert abs(ratios[at] - math.log(p[True] / p[False])) < 1e-9


def test_no_secrets_and_no_rows(spark):
    plain = documents(spark, [(1, prose(1, 30)), (2, None)])
    assert [r["found"] for r in s.with_secrets(plain).collect()] == [[], []]
    assert s.with_secrets(plain.where("false")).collect() == []
