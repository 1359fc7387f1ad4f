"""The registered queries and the pipeline, stage by stage against brute force."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from souk.llm import block_identity, decontamination, entries, quality_cnn, simhash_neardup
from souk.session import settle
from tests.llm.tables import documents, prose, rows_of
from tests.llm.test_quality_cnn import junk
from tools.compare import differences

FOLDER = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in entries.QUERIES) == list(range(1, 14))
    assert set(entries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(entries.ORACLE_SQL) <= set(contract.oracle_sql())


@present
@pytest.mark.parametrize("key", sorted(entries.ORACLE_SQL))
def test_queries_against_sql(spark, key):
    assert differences(spark, FOLDER, key) == []


@present
def test_queries_without_sql_have_their_columns(spark):
    want = {
        "op1_site_style_tree": ["page_id", "url", "text", "n_chars"],
        "op3_simhash_neardup": ["doc_id", "fingerprint", "component_id"],
        "op4_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op9_quality_cnn": ["doc_id", "held_out", "score", "predicted"],
    }
    for key, columns in want.items():
        assert entries.QUERIES[key](spark, FOLDER).columns[: len(columns)] == columns


def test_pipeline_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    item = prose(4242, 40)
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 50 + i % 90), f"src{i % 3}") for i in range(200, 400)]
    rows += [(401 + k, rows[1][1], "src1") for k in range(4)]
    rows += [(420, rows[2][1] + " ", "src0"), (430, f"{prose(1, 60)} {item} {prose(2, 60)}", "src2"), (431, None, None), (432, "", "src0")]
    documents(spark, rows).select("doc_id", "text", "source", "lang", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200, 400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder), "stage")
        steps.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.columns == columns if name != "mixing sources" else set(docs.columns) == {*columns, "taken"}
    score = quality_cnn.fitted(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {d: t for d, t, _ in rows if score(t) >= quality_cnn.THRESHOLD}
    assert steps[0] == good
    assert sum(i in good for i in range(200, 400) if i % 5) >= 158 and sum(i in good for i in range(200, 400, 5)) <= 2
    firsts = {}
    for d in sorted(good):
        firsts.setdefault(" ".join((good[d] or "").split(" ")), d)
    exact = {d: t for d, t in good.items() if d in firsts.values()}
    assert steps[1] == exact
    prints = {d: simhash_neardup.fingerprint(t) for d, t in exact.items()}
    label = {d: d for d in exact}
    for a in exact:
        for b in exact:
            if ((prints[a] ^ prints[b]) % 2**64).bit_count() <= 2:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert steps[2] == {d: t for d, t in exact.items() if label[d] == d}
    assert steps[3] == {d: t for d, t in steps[2].items() if item not in (t or "")}
    assert 430 in steps[2] and 430 not in steps[3]
    assert steps[4] == steps[3]
    assert rows_of(corpus_pipeline.run(spark, folder), "doc_id", "taken") == rows_of(docs, "doc_id", "taken")


def test_an_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, [(1, "x")]).select("doc_id", "text", "source", "lang", "n_chars").where("false").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_stages_call_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources",
    ]
    assert block_identity.without_copies and decontamination.without_benchmark
