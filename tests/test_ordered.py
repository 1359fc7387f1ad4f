import random
import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from souk.operators import ordered
from souk.operators.ordered import bracketed_median, exact_median, keep_first, median_bracket, number_rows, running, running_totals
from tests.helpers import frame, plan, values


def _rows(seed=7, n=600):
    """A third of the rows in one group, a third of all values equal."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        value = Decimal("10.00") if rng.random() < 0.33 else Decimal(rng.randrange(10000)) / 100
        rows.append((group, i, value))
    return rows


def test_running_totals_equal_one_global_window(spark):
    rows = _rows()
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    out = running_totals(df, [F.desc("v"), F.asc("id")], {"rank": F.lit(1), "upto": F.col("v")}, slices=7)
    total, expected, running = sum(r[2] for r in rows), [], Decimal(0)
    for rank, (_, i, v) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1):
        running += v
        expected.append((i, rank, running, len(rows), total))
    got = [tuple(r) for r in out.orderBy("rank").select("id", "rank", "upto", "rank_total", "upto_total").collect()]
    assert got == expected


def test_running_totals_within_groups_and_null_group(spark):
    rows = [*_rows(), (None, 9001, Decimal("1.00")), (None, 9002, Decimal("2.00"))]
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    out = running_totals(df, [F.asc("id")], {"at": F.lit(1)}, by=["g"], slices=7)
    seen: dict = {}
    expected = {}
    for g, i, _ in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert {r["id"]: r["at"] for r in out.collect()} == expected


def test_row_numbers_within_groups(spark):
    rows = _rows()
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    out = number_rows(df, ["g"], [F.asc("v"), F.asc("id")], "n")
    expected, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert {r["id"]: r["n"] for r in out.collect()} == expected


def test_row_numbers_of_small_groups_take_one_shuffle_and_large_ones_slices(spark, monkeypatch):
    rows = [*_rows(), (None, 9001, Decimal("1.00")), (None, 9002, Decimal("0.50"))]
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    expected, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    out = number_rows(df, ["g"], [F.asc("v"), F.asc("id")], "n")
    assert plan(out).count("rangepartitioning") == 0 and "_slice" not in plan(out)
    assert {r["id"]: r["n"] for r in out.collect()} == expected
    monkeypatch.setattr(ordered, "SMALL_GROUP", 100)
    cut = number_rows(df, ["g"], [F.asc("v"), F.asc("id")], "n")
    assert "_slice" in plan(cut)
    assert {r["id"]: r["n"] for r in cut.collect()} == expected and dict(cut.dtypes)["n"] == dict(out.dtypes)["n"]


def test_median_of_even_odd_single_and_tied_groups(spark):
    rows = [*_rows(), ("one", 1, Decimal("5.55")), ("two", 1, Decimal("1.10")), ("two", 2, Decimal("2.25"))]
    rows += [("null", 1, None), (None, 1, Decimal("3.00"))]
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", "m").collect()}
    groups: dict = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {g: float(statistics.median(vs)) for g, vs in groups.items()}


def test_keep_first_limits_before_the_shuffle(spark):
    df = frame(spark, "g string, id int, v decimal(12,2)", *_rows())
    out = keep_first(df, ["g"], [F.desc("v"), F.asc("id")])
    assert len(values(out, "g")) == 6
    text = plan(out)
    assert text.index("WindowGroupLimit") < text.index("Exchange")
    assert "Partial" in text


def test_median_by_brackets_is_exact_whatever_the_sketch_said(spark):
    rows = [*_rows(), ("one", 1, Decimal("5.55")), ("two", 1, Decimal("1.10")), ("two", 2, Decimal("2.25")), ("null", 1, None), (None, 1, Decimal("3.00"))]
    df = frame(spark, "g string, id int, v decimal(12,2)", *rows)
    want = values(exact_median(df, ["g"], "v", "m"), "g", "m")
    brackets = df.groupBy("g").agg(*median_bracket("v"))
    assert values(bracketed_median(df, brackets, ["g"], "v", "m"), "g", "m") == want
    # Brackets that miss the middle of some groups, and of all.
    for low, high in ((3.0, 4.0), (1e9, 1e9)):
        wrong = brackets.withColumns({"_low": F.lit(low), "_high": F.lit(high)})
        assert values(bracketed_median(df, wrong, ["g"], "v", "m"), "g", "m") == want


def test_running_values_over_slices(spark):
    rows = [(n, (n * 7) % 13, f"v{n}" if n % 5 == 0 else None) for n in range(60)]
    df = frame(spark, "n int, x int, label string", *rows).repartition(5)
    out = running(df, [F.col("n")], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("label"))})
    got = {r["n"]: (r["s"], r["m"], r["l"]) for r in out.collect()}
    want, total, top, last = {}, 0, 0, None
    for n, x, label in rows:
        total, top, last = total + x, max(top, x), label or last
        want[n] = (total, top, last)
    assert got == want
