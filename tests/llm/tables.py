"""Small tables for the text operators, with the awkward rows every operator has to bear."""

from __future__ import annotations

import random

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in old green trees near cold rivers".split()

#: Names the operators use inside; a table may have columns of these names as well.
CLASHING = ("row", "pos", "name", "block", "key", "size", "fp", "h1", "line", "component", "taken", "t", "id", "n", "head")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ed")) for _ in range(words))


def documents(spark, rows, partitions: int = 3):
    """(doc_id, text) or (doc_id, text, source) rows as a table with further, clashing columns."""
    full = [(*r, "src0")[:3] if len(r) == 2 else r for r in rows]
    names = "doc_id bigint, text string, source string, lang string, n_chars bigint"
    table = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in full], names).repartition(partitions, "doc_id", "text")
    return table.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \t\n "),
    (None, "a row without an id"),
    (4, "one"),
    (5, "repeated row"),
    (5, "repeated row"),
    (6, prose(1, 30_000)),
    (7, "tie of two texts"),
    (8, "tie  of two\ttexts"),
]
