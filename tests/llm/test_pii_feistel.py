import pytest

from souk.llm import pii_feistel as p
from tests.llm.tables import AWKWARD, documents, rows_of

CIPHER = p.Cipher(b"a key")


@pytest.mark.parametrize("n", [1, 2, 10, 97, 1000, 4097])
def test_a_permutation_of_every_range(n):
    out = [CIPHER.permute(i, n, "kind") for i in range(n)]
    assert sorted(out) == list(range(n))
    assert [CIPHER.permute(v, n, "kind", back=True) for v in out] == list(range(n))


VALID = {
    "card": ["4817014311044529", "4111 1111 1111 1111", "3782-822463-10005"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (579) 555-6331", "579-555-6331", "+44 2079 460 0958"],
    "ip": ["43.95.227.29", "255.255.255.255"],
    "date": ["2024-02-29", "29.02.2024", "02/29/2024", "05/06/1999"],
    "mail": ["fto.32@mail8.example.com", "Ab+c_9@x-y.org"],
}
NOT_VALID = ["4817014311044528", "DE89370400440532013001", "000-12-3456", "666-45-6789", "123-555-0000 1", "43.95.227.256",
             "1.2.3.4.5", "2024-02-30", "2024-13-01", "31.02.2024", "0000000000000000", "version 3.14", "x@y", "12345"]


@pytest.mark.parametrize("kind, text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid_values_keep_their_form(kind, text):
    new, counts = p.pseudonymised(f"Ü {text}, then", CIPHER)
    assert dict(+counts) == {kind: 1}
    inner = new[2 : -len(", then")]
    form = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    assert inner != text
    if kind == "ip":
        assert inner.count(".") == 3 and max(map(int, inner.split("."))) < 256
    else:
        assert form(inner) == form(text)
    # What comes out is valid of the same kind, goes back to what it was, and is the same elsewhere.
    again, seen = p.pseudonymised(new, CIPHER, back=True)
    assert again == f"Ü {text}, then" and seen[kind] == 1
    assert p.pseudonymised(f"({text})", CIPHER)[0] == f"({inner})"
    assert p.pseudonymised(text, p.Cipher(b"other"))[0] != inner


@pytest.mark.parametrize("text", NOT_VALID)
def test_other_values_stay(text):
    new, counts = p.pseudonymised(text, CIPHER)
    assert new == text and not +counts


def test_different_dates_stay_different():
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2024) for m in range(1, 13) for d in range(1, 29)]
    assert len({p.pseudonymised(d, CIPHER)[0] for d in days}) == len(days)


def test_documents(spark):
    rows = [*AWKWARD, (50, "call +1 (579) 555-6331 or a.b@c.example, card 4817014311044529"), (51, "4817014311044529"), (None, "4817014311044529")]
    rows.append((52, "x " * 50_000 + "43.95.227.29"))
    found = p.pseudonymise(documents(spark, rows), "a key")
    want = []
    for doc, text in rows:
        new, counts = p.pseudonymised(text, CIPHER)
        want.append((doc, new, *[counts[k] for k in p.KINDS]))
    assert rows_of(found, "doc_id", "text", *[f"n_{k}" for k in p.KINDS]) == sorted(want, key=str)
    assert p.pseudonymise(documents(spark, rows).where("false"), "k").collect() == []


@pytest.mark.parametrize(
    "kind, value, after",
    [
        ("card", "4111111111111111", " 123"),
        ("card", "4111 1111 1111 1111", " 12/27"),
        ("card", "4111111111111111", " 99 items"),
        ("iban", "DE89370400440532013000", " BIC COBADEFF"),
        ("iban", "DE89 3704 0044 0532 0130 00", " EUR"),
        ("iban", "GB82WEST12345698765432", " 12 units"),
        ("phone", "579-555-6331", " 12345"),
        ("phone", "+15551234567", ""),
        ("phone", "+15795556331", " 7"),
        ("phone", "+442079460958", " EUR"),
    ],
)
def test_valid_values_before_other_digits_and_capitals(kind, value, after):
    new, counts = p.pseudonymised(f"x {value}{after}.", CIPHER)
    alone, _ = p.pseudonymised(value, CIPHER)
    assert dict(+counts) == {kind: 1} and alone != value
    assert new == f"x {alone}{after}."
    assert p.pseudonymised(alone, CIPHER, back=True)[0] == value


def test_the_rest_of_a_failed_match_is_searched():
    text = "1234 4111111111111111 and 99 DE89370400440532013000 AB"
    new, counts = p.pseudonymised(text, CIPHER)
    assert dict(+counts) == {"card": 1, "iban": 1}
    assert p.pseudonymised("+1 (579) 555-6331", CIPHER)[0].replace(" (", "").replace(") ", "").replace("-", "") == p.pseudonymised("+15795556331", CIPHER)[0]
