"""Secrets: known patterns, and character Markov models of random strings and ordinary identifiers.

Everything runs on Spark's own functions. Spans come from splitting a text by a pattern: the
pieces between the matches and the matches themselves, laid end to end, are the text, so adding
up their lengths gives each position in one pass over the row.

The model holds, for every pair of adjacent characters, the logarithm of how much likelier it is
in a random string than in an ordinary identifier. It is counted over a bounded sample of rows:
values that a pattern marks as secret against all other identifiers of the same rows. A long
identifier is a secret if its pairs together favour the random model by enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import whole_text
from souk.session import settle

# The patterns of the known kinds, and the characters a kept match has at least.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: A run of such characters, this long, is judged by the model.
IDENTIFIER = r"[A-Za-z0-9+/_=-]"
LEAST = 16
#: Rows the model is counted over at most, half of them with a known secret.
TRAIN_ROWS = 4000
#: Pairs that the frequency of the second character counts for.
BACK = 4.0
#: Total log-likelihood ratio, and its mean per pair, from which on a string counts as random.
TOTAL, MEAN = 12.0, 0.5

#: Printable ASCII: the characters an identifier can hold.
FIRST, SYMBOLS = 33, 94


def _spans(kind: str, pattern: str, keep: Column | None = None) -> Column:
    """Array of (begin, rank, kind, end) of the matches in ``t`` for which ``keep`` over ``m`` holds."""
    rank = ["assign", "access", "hex", "markov"].index(kind)
    matches, pieces = F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), F.split("t", pattern, -1)

    def step(seen: Column, pair: Column) -> Column:
        begin = seen["at"] + F.length(pair["piece"])
        # The piece after the last match has no match beside it.
        end = begin + F.coalesce(F.length(pair["m"]), F.lit(0))
        span = F.struct(begin.alias("begin"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = pair["m"].isNotNull() & (keep(pair["m"]) if keep else F.lit(True))
        return F.struct(end.alias("at"), F.when(kept, F.concat(seen["out"], F.array(span))).otherwise(seen["out"]).alias("out"))

    empty = F.array().cast("array<struct<begin:int,rank:int,kind:string,end:int>>")
    pairs = F.zip_with(pieces, matches, lambda piece, m: F.struct(piece.alias("piece"), m.alias("m")))
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda seen: seen["out"])
    return F.when(F.regexp_like("t", F.lit(pattern)), found).otherwise(empty)


def known_spans() -> dict[str, Column]:
    """Spans of each known kind in the column ``t``: leftmost, not overlapping within the kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_LEAST
    return {
        "assign": _spans("assign", ASSIGN, value),
        "access": _spans("access", ACCESS, lambda m: F.length(m) >= ACCESS_LEAST),
        # A match is a whole run of hex digits, so asking for the length at once finds the same runs.
        "hex": _spans("hex", f"{HEX[:-1]}{{{HEX_LEAST},}}"),
    }


def _pairs(string: Column) -> Column:
    """Places of the adjacent character pairs of an identifier in the model."""
    codes = F.transform(F.split(string, ""), lambda c: F.ascii(c) - FIRST)
    pairs = F.zip_with(codes, F.slice(codes, 2, F.length(string)), lambda a, b: a * SYMBOLS + b)
    # The last character begins no pair.
    return F.filter(pairs, lambda p: p.isNotNull())


def training_strings(docs: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(secret, string): labelled strings of at most ``most`` rows, picked by a hash of the text.

    Secret are the values the known patterns mark. Ordinary are the other identifiers of four
    letters or more that stand in at least two of these rows. Each string is given once.
    """
    marked = f"{ASSIGN}|({ACCESS[:-1]}{{{ACCESS_LEAST - 4},}})|({HEX[:-1]}{{{HEX_LEAST},}})"
    texts = docs.select(whole_text().alias("t")).withColumns(
        {"has": F.regexp_like("t", F.lit(marked)), "order": F.xxhash64("t")}
    )
    # Only hashes are sorted; the texts up to the last hash follow, one of each.
    orders = settle(texts.groupBy("has", "order").count().select("has", "order"), "orders")
    last = [orders.where(c).orderBy("order").limit(most // 2).agg(F.max("order")).first()[0] for c in ("has", "not has")]
    chosen = F.when(F.col("has"), F.col("order") <= F.lit(last[0])).otherwise(F.col("order") <= F.lit(last[1]))
    rows = settle(texts.where(chosen).groupBy("has", "order").agg(F.first("t").alias("t")), "sample")
    values = [
        F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1)),
        F.regexp_extract_all("t", F.lit(f"{ACCESS[:-1]}{{{ACCESS_LEAST - 4},}}"), F.lit(0)),
        F.regexp_extract_all("t", F.lit(f"{HEX[:-1]}{{{HEX_LEAST},}}"), F.lit(0)),
    ]
    secret = rows.where("has").select(F.explode(F.concat(*values)).alias("string"))
    secret = secret.where(F.length("string") >= ASSIGN_LEAST).select(F.lit(True).alias("secret"), "string")
    rest = F.regexp_replace("t", marked, " ")
    plain = rows.select("order", F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(f"{IDENTIFIER}{{4,}}"), F.lit(0)))).alias("string"))
    # A random string stands in one row; what stands in two is part of a vocabulary.
    plain = plain.groupBy("string").agg(F.count("*").alias("n")).where("n > 1")
    return secret.distinct().unionByName(plain.select(F.lit(False).alias("secret"), "string"))


def pair_ratios(strings: DataFrame) -> list[float]:
    """Log-likelihood ratio of every character given the one before it, random against ordinary.

    A pair is smoothed towards the frequency of its second character, and that by a half towards
    an even one, so a character an ordinary identifier hardly has speaks for a random string even
    after one that was never seen there. A string counts a pair once, so that no long string
    outweighs the others. A label without strings leaves even frequencies.
    """
    counted = strings.select("secret", F.explode(F.array_distinct(_pairs(F.col("string")))).alias("pair")).groupBy("secret", "pair").count()
    counts = {True: [0] * SYMBOLS**2, False: [0] * SYMBOLS**2}
    for r in counted.where(F.col("pair").between(0, SYMBOLS**2 - 1)).collect():
        counts[r["secret"]][r["pair"]] = r["count"]
    logs = {}
    for label, pairs in counts.items():
        rows = [pairs[a * SYMBOLS : (a + 1) * SYMBOLS] for a in range(SYMBOLS)]
        second = [sum(column) + 0.5 for column in zip(*rows)]
        total = sum(second)
        logs[label] = [
            math.log((c + BACK * second[b] / total) / (sum(row) + BACK)) for row in rows for b, c in enumerate(row)
        ]
    return [a - b for a, b in zip(logs[True], logs[False])]


def with_secrets(docs: DataFrame, sample: DataFrame | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, known and found.

    ``known`` holds a span array per known kind; ``found`` holds those and the spans the model
    adds, which overlap no known one, as structs (begin, rank, kind, end) in order. Positions
    count code points, the end is exclusive. NULL and empty texts have no spans. ``sample`` gives
    the rows the model is learned from, by default ``docs`` itself.
    """
    ratios = pair_ratios(training_strings(docs if sample is None else sample, most))
    model = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")

    def random(m: Column) -> Column:
        score = F.aggregate(_pairs(m), F.lit(0.0), lambda sum_, p: sum_ + F.get(model, p))
        # Digits alone are a number and capitals alone a word in capitals, whatever their order.
        plain = F.regexp_like(m, F.lit("^(?:[0-9+/_=-]+|[A-Z+/_=-]+)$"))
        return ~plain & (score >= TOTAL) & (score >= MEAN * (F.length(m) - 1))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("t"))
    spans = texts.withColumns(known_spans() | {"markov": _spans("markov", f"{IDENTIFIER}{{{LEAST},}}", random)})
    known = F.concat("assign", "access", "hex")
    new = F.filter("markov", lambda s: ~F.exists(F.col("all_known"), lambda k: (k["begin"] < s["end"]) & (s["begin"] < k["end"])))
    spans = spans.withColumn("all_known", known)
    return spans.select(
        "doc_id",
        F.struct("assign", "access", "hex").alias("known"),
        F.array_sort("all_known").alias("base"),
        F.array_sort(F.concat("all_known", new)).alias("found"),
    )


def span_text(spans: str) -> Column:
    """Spans as kind:begin:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
