"""Personal data replaced by format-preserving Feistel pseudonyms.

Card numbers, bank accounts, social security numbers, phone numbers, IP and mail addresses and
dates are found by their form and by the checks their kind has. The value of each, as an integer
within the range of its format, goes through a keyed Feistel permutation of that range; what comes
out has the same form and passes the same checks. A permutation maps equal values to equal
pseudonyms and different ones to different ones, so they stay linked across documents without any
table of values, and whoever holds the key can turn them back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, whole_text

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "mail")


class Cipher:
    """Keyed permutations of ranges of integers."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, kind: str, n: int, turn: int, half: int) -> int:
        data = f"{kind}|{n}|{turn}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, n: int, kind: str, back: bool = False) -> int:
        """A permutation of 0 .. n - 1 for each kind; ``back`` undoes it.

        The Feistel network covers a * b >= n; values beyond n are sent through again until one
        lies below n, which keeps the map one to one.
        """
        a = math.isqrt(max(n - 1, 0)) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for turn in range(ROUNDS)[:: -1 if back else 1]:
                sign = -1 if back else 1
                if turn % 2:
                    right = (right + sign * self._round(kind, n, turn, left)) % b
                else:
                    left = (left + sign * self._round(kind, n, turn, right)) % a
            value = left * b + right
            if value < n:
                return value


def luhn(digits: str) -> int:
    """The check digit that completes the digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _fill(form: str, symbols: str) -> str:
    """Put symbols in the places of the letters and digits of a written form."""
    at = iter(symbols)
    return "".join(next(at) if c.isalnum() else c for c in form)


def _mixed(text: str, cipher: Cipher, kind: str, back: bool) -> str:
    """Permute letters among letters and digits among digits, keeping case and place."""
    bases = [(10, "0") if c.isdigit() else (26, "A") if c.isupper() else (26, "a") for c in text]
    value, n = 0, 1
    for c, (size, zero) in zip(text, bases):
        value, n = value * size + ord(c) - ord(zero), n * size
    value = cipher.permute(value, n, kind, back)
    out = []
    for size, zero in reversed(bases):
        value, d = divmod(value, size)
        out.append(chr(ord(zero) + d))
    return "".join(reversed(out))


def _card(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    # All zeros is no card number, so the permutation leaves it out.
    body = f"{cipher.permute(int(digits[:-1]) - 1, 10**n - 1, 'card', back) + 1:0{n}d}"
    return _fill(m[0], body + str(luhn(body)))


def _iban(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    text = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(text) <= 34 or number(text[4:] + text[:4]) % 97 != 1:
        return None
    body = _mixed(text[4:], cipher, "iban" + text[:2], back)
    check = 98 - number(body + text[:2] + "00") % 97
    return _fill(m[0], f"{text[:2]}{check:02d}{body}")


def _ssn(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    area, group, serial = int(m["area"]), int(m["group"]), int(m["serial"])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(cipher.permute(value, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _north_american(digits: str, cipher: Cipher, back: bool) -> str:
    # Area and exchange begin with 2 to 9.
    value = ((int(digits[:3]) - 200) * 800 + int(digits[3:6]) - 200) * 10_000 + int(digits[6:])
    value, line = divmod(cipher.permute(value, 800 * 800 * 10_000, "phone", back), 10_000)
    area, exchange = divmod(value, 800)
    return f"{area + 200}{exchange + 200}{line:04d}"


def _phone(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m["number"])
    if m["plus"] == "+1" or not m["plus"]:
        if not _american(digits):
            return None
        found = _north_american(digits, cipher, back)
    else:
        if not 6 <= len(digits) <= 14:
            return None
        found = f"{cipher.permute(int(digits), 10 ** len(digits), 'phone' + m['plus'], back):0{len(digits)}d}"
    return (m["plus"] or "") + _fill(m["number"], found)


def _ip(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = cipher.permute(int.from_bytes(bytes(parts), "big"), 2**32, "ip", back)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    # Year first, or last after day and month; month before day only if slashes leave no other reading.
    a, sep, b, _, c = m["d1"], m["sep"], m["d2"], m["sep"], m["d3"]
    if len(a) == 4:
        order = ("y", "m", "d")
    elif sep == "/" and int(b) > 12:
        order = ("m", "d", "y")
    else:
        order = ("d", "m", "y")
    at = dict(zip(order, (a, b, c)))
    try:
        day = date(int(at["y"]), int(at["m"]), int(at["d"]))
    except ValueError:
        return None
    if len(at["y"]) != 4 or not 0 <= (day - _FIRST_DAY).days < _DAYS:
        return None
    value = (day - _FIRST_DAY).days
    while True:
        value = cipher.permute(value, _DAYS, "date" + "".join(order) * (order[0] == "m"), back)
        new = date.fromordinal(_FIRST_DAY.toordinal() + value)
        # Month before day is read back as such only where the day is above 12.
        if order[0] != "m" or new.day > 12:
            break
    put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return sep.join(put[k] for k in order)


def _mail(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    name = re.sub(r"[^A-Za-z0-9]", "", m["name"])
    if not name:
        return None
    return _fill(m["name"], _mixed(name, cipher, "mail", back)) + "@" + m["host"]


def _american(digits: str) -> bool:
    return len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01"


def _bare(m: re.Match, cipher: Cipher, back: bool) -> str | None:
    # The first digit stays: country codes have none that sets them apart from what follows, but +1.
    first, digits = m["bare"][1], m["bare"][2:]
    if first == "0":
        return None
    if first == "1" and _american(digits):
        return "+1" + _north_american(digits, cipher, back)
    while True:
        digits = f"{cipher.permute(int(digits), 10 ** len(digits), 'phone+' + first, back):0{len(digits)}d}"
        # What is no North American number stays none, so that it is read back as such.
        if first != "1" or not _american(digits):
            return f"+{first}{digits}"


_FORMS: dict[str, Callable[[re.Match, Cipher, bool], str | None]] = {
    "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "mail": _mail,
    "bare": _bare,
}
#: Lengths of account numbers by country, from the registry of the standard.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        entry.split(":")
        for entry in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
            "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV "
            "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 33:RU 32:LC"
        ).split()
    )
    for country in countries.split(",")
}

_START = r"(?<![\w.+-])"
_PATTERNS = {
    "iban": r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))",
    "date": _START + r"(?P<date>(?P<d1>[0-9]{4}|[0-9]{2})(?P<sep>[-/.])(?P<d2>[0-9]{2})(?P=sep)(?P<d3>[0-9]{4}|[0-9]{2})(?![\w-]|[./][0-9]))",
    "ssn": _START + r"(?P<ssn>(?P<area>[0-9]{3})-(?P<group>[0-9]{2})-(?P<serial>[0-9]{4})(?![\w-]))",
    "ip": _START + r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9]))",
    "card": _START + r"(?P<card>[0-9](?:[\ -]?[0-9]){12,18}(?![\w-]))",
    "phone": _START
    + r"(?P<phone>(?P<plus>\+[0-9]{1,3})?(?P<number>\ ?(?:\([0-9]{3}\)\ ?|[0-9]{2,4}[-.\ ])[0-9]{3,4}[-.\ ]?[0-9]{3,4})(?![\w-]))",
    "bare": _START + r"(?P<bare>\+[0-9]{8,15}(?![\w-]))",
}
#: One pass over a text: at the leftmost place where a form fits, the first that passes its check is taken.
_NUMBERS = re.compile("|".join(_PATTERNS.values()))
_EACH = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])(?P<mail>(?P<name>[A-Za-z0-9._%+-]+)@(?P<host>[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+))")
_HAS_NUMBER = re.compile(r"[0-9][0-9]")


def _readings(part: str, m: re.Match) -> Iterator[tuple[str, re.Match]]:
    """The forms that fit where ``m`` begins: each kind, the longest first, then shorter ones that end at a separator."""
    for kind, form in _EACH.items():
        found = form.match(part, m.start())
        if not found:
            continue
        ends = []
        if kind in ("card", "iban"):
            ends = [e for e in range(found.end() - 1, found.start() + 12, -1) if part[e] in " -" and part[e - 1] not in " -"]
        tried = [found, *filter(None, (form.match(part, m.start(), e) for e in ends))]
        if kind == "iban" and (length := IBAN_LENGTHS.get(found[0][:2])):
            # The country's length comes first, and nothing shorter than the whole is of another one.
            right = [t for t in tried if len(t[0].replace(" ", "")) == length]
            tried = [*right, *([] if found in right else [found])]
        yield from ((kind, t) for t in tried)


def pseudonymised(text: str | None, cipher: Cipher, back: bool = False) -> tuple[str, Counter]:
    """The text with every valid value replaced, and how many of each kind there were."""
    counts: Counter = Counter()

    def numbers(part: str) -> str:
        out, at, done = [], 0, 0
        while m := _NUMBERS.search(part, at):
            new = None
            for kind, tried in _readings(part, m):
                new = _FORMS[kind](tried, cipher, back)
                if new is not None:
                    break
            if new is None:
                # Nothing fits from here on: later values may begin inside.
                at = m.start() + 1
                continue
            counts["phone" if kind == "bare" else kind] += 1
            out += [part[done : m.start()], new]
            at = done = tried.end()
        return "".join([*out, part[done:]])

    text = text or ""
    if "@" in text:
        # Mail addresses first, each left out of the search for numbers.
        out, at = [], 0
        for m in _MAIL.finditer(text):
            new = _mail(m, cipher, back)
            counts["mail"] += new is not None
            out += [numbers(text[at : m.start()]), m[0] if new is None else new]
            at = m.end()
        return "".join([*out, numbers(text[at:])]), counts
    if _HAS_NUMBER.search(text):
        text = numbers(text)
    return text, counts


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, and n_<kind> for each kind.

    NULL and empty texts come out empty; values that fail the checks of their kind stay as they
    are. A row is changed by itself, so repeated and tied rows come out alike and no row moves.
    The same key gives the same pseudonyms in every table. Only doc_id and text are read.
    """
    names = [f"n_{k}" for k in KINDS]

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher = Cipher(key.encode())
        for rows in batches:
            done = [pseudonymised(t, cipher) for t in rows["text"]]
            counts = {n: [c[k] for _, c in done] for n, k in zip(names, KINDS)}
            yield pd.DataFrame({"doc_id": rows["doc_id"], "text": [t for t, _ in done], **counts})

    slim = docs.select(id_text(), whole_text().alias("text"))
    schema = "doc_id string, text string, " + ", ".join(f"{n} bigint" for n in names)
    return slim.mapInPandas(change, schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
