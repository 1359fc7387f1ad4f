"""Python workers find what they need although the package is not on their path."""

import os
import subprocess
import sys

import pytest

from tests.llm.tables import AWKWARD, documents

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from souk.session import local_session
from souk.llm import entries
spark = local_session("2", partitions=2, memory="2g")
spark.sparkContext.setLogLevel("OFF")
assert spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib.util").util.find_spec("souk") is None).first()
for name in {names!r}:
    assert entries.QUERIES[name](spark, {folder!r}).count() >= 0, name
print("all ran")
"""


@pytest.mark.parametrize(
    "names",
    [
        ["op1_site_style_tree", "op2_decontamination", "op8_pii_feistel", "op10_exact_dedup", "op13_periodic_runs"],
        ["op3_simhash_neardup", "op9_quality_cnn", "op11_imatch", "op12_spelling_variants"],
    ],
)
def test_queries_run_from_another_folder(spark, tmp_path, names):
    folder = tmp_path / "data"
    docs = [(d, t) for d, t in AWKWARD if t is None or len(t) < 1000] + [(100 + k, "word another sentence here " * 4) for k in range(8)]
    documents(spark, docs).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(100 + k, k % 2, 0) for k in range(8)], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, "word another sentence here word another")], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    pages = [(k, f"http://h{k % 2}/p", f"<html><body><article><p>text {k}</p></article></body></html>") for k in range(4)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(folder / "pages.parquet"))
    elsewhere = tmp_path / "elsewhere"
    elsewhere.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, names=names, folder=str(folder))
    done = subprocess.run([sys.executable, "-c", script], cwd=elsewhere, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
