"""Parallel reading of CSV with line breaks against Spark's reading of whole files in one task."""

import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from souk.sources.quoted_csv import read_quoted_csv, text_lines
from tests.helpers import values

CORRUPT = "_bad"
SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b", "c", CORRUPT)])


def one_task(spark, path):
    options = {"header": True, "enforceSchema": False, "quote": '"', "escape": '"', "multiLine": True, "columnPruning": False}
    return spark.read.schema(SCHEMA).options(**options).option("columnNameOfCorruptRecord", CORRUPT).csv(path)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def field(rng, messy):
    words = [rng.choice(("one", "two", ",", '"', "\n", "\n\n", "", " ", "ü")) for _ in range(rng.randint(0, 9))]
    text = "".join(words)
    kind = rng.random()
    if kind < 0.5:
        return quoted(text)
    plain = text.replace(",", "").replace("\n", "").replace('"', "")
    if messy and kind < 0.6:
        return f"x{plain}\"y"  # a quote inside an unquoted field opens nothing
    if messy and kind < 0.65:
        return f'"x"{plain}y'  # text after a closing quote
    return plain


def document(seed, breaks="\n", messy=False):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        cells = [f"{k}", field(rng, messy), field(rng, messy)]
        if rng.random() < 0.05:
            cells.append("surplus")
        rows.append(",".join(cells))
        if rng.random() < 0.03:
            rows.append("")
        if rng.random() < 0.03:
            rows.append("x," + quoted("\n".join(["long"] * 150)) + ",y")
    return breaks.join(["a,b,c", *rows]) + breaks


@pytest.mark.parametrize(("seed", "breaks", "messy"), [(1, "\n", False), (2, "\n", True), (3, "\r\n", False), (4, "\n", True)])
def test_a_file_over_many_splits_equals_the_reading_in_one_task(spark, tmp_path, small_splits, seed, breaks, messy):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for k in range(2):
        with open(folder / f"{k}.csv", "w", newline="") as out:
            out.write(document(10 * seed + k, breaks, messy))
    path = str(folder)
    want = values(one_task(spark, path))
    assert text_lines(spark, path).select("file", "split").distinct().count() > 8
    assert values(read_quoted_csv(spark, path, SCHEMA, CORRUPT)) == want
    assert sum("long\nlong" in (r[1] or "") for r in want) > 1


def test_files_without_line_breaks_without_rows_and_without_last_break(spark, tmp_path):
    for name, text in {"plain": "a,b,c\n1,2,3\n4,,\n", "none": "a,b,c\n", "open": 'a,b,c\n1,2,"3\n4"'}.items():
        (tmp_path / name).write_text(text)
        path = str(tmp_path / name)
        assert values(read_quoted_csv(spark, path, SCHEMA, CORRUPT)) == values(one_task(spark, path))


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="does not name the columns"):
        read_quoted_csv(spark, str(tmp_path / "t.csv"), SCHEMA, CORRUPT).collect()
