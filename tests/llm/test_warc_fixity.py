import hashlib

from pyspark.sql import functions as F

from souk.llm import warc_fixity as w
from tests.llm.tables import CLASHING, prose, rows_of


def pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return table.selectExpr("*", *[f"1 as `{c}`" for c in (*CLASHING, "file", "offset", "digest", "node") if c not in ("id",)])


def rows():
    made = [(i, f"http://h/{i}", f"<p>{prose(i, 30 + i % 50)}</p>") for i in range(300)]
    made += [(1000, None, None), (1001, "http://h/é\r\nx", ""), (1002, "http://h/long", "<p>" + prose(5, 40_000)), (None, "u", "v")]
    return made + [(2000, "same", "same")] * 3


def plain_record(url, html):
    body = (html or "").encode()
    url = (url or "").replace("\r", " ").replace("\n", " ")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\n"
    head += f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_records_follow_each_other(spark):
    layout = w.warc_layout(pages(spark, rows()), file_bytes=20_000)
    want, begin, first = [], 0, {}
    made = [(p is not None, p or 0, hashlib.sha256(r).hexdigest(), len(r)) for p, r in ((p, plain_record(u, h)) for p, u, h in rows())]
    for known, page, digest, length in sorted(made):
        file = begin // 20_000
        want.append((page if known else None, file, begin - first.setdefault(file, begin), length, digest))
        begin += length
    assert rows_of(layout, "page_id", "file", "offset", "length", "digest") == sorted(want, key=str)


def test_damage_is_located_and_nothing_else(spark):
    one = w.warc_layout(pages(spark, rows()), file_bytes=50_000).select("page_id", "file", "offset", "length", "digest")
    bad, gone = F.col("page_id").isin(7, 8, 250, 1002), F.col("page_id").isin(9, 120)
    two = one.where(~gone | F.col("page_id").isNull()).withColumn("digest", F.when(bad, "rot").otherwise(F.col("digest")))
    extra = one.where("page_id = 3").withColumn("file", F.lit(99).cast("bigint"))
    two = two.unionByName(extra)
    for leaf, fanout in ((1000, 2), (4096, 16), (1 << 20, 16)):
        found = w.audit(one, two, leaf, fanout).join(one.select("file", "offset", "page_id"), ["file", "offset"], "left")
        got = sorted(((r["page_id"], r["state"]) for r in found.collect()), key=str)
        assert got == sorted([(7, "changed"), (8, "changed"), (250, "changed"), (1002, "changed"), (9, "missing"), (120, "missing"), (None, "extra")], key=str)


def test_a_tree_has_the_hashes_of_its_children(spark):
    one = w.warc_layout(pages(spark, rows()[:40])).select("file", "offset", "length", "digest")
    levels = w.merkle_levels(one, 2, 1000, 4)
    below = {(r["file"], r["node"]): r["hash"] for r in levels[0].collect()}
    for r in levels[1].collect():
        lines = "\n".join(f"{n}:{h}" for (f, n), h in sorted(below.items()) if f == r["file"] and n // 4 == r["node"])
        assert r["hash"] == hashlib.sha256(lines.encode()).hexdigest()


def test_equal_and_empty_replicas(spark):
    one = w.warc_layout(pages(spark, rows()[:20]))
    assert w.audit(one, one).collect() == []
    assert w.audit(one.where("false"), one.where("false")).collect() == []
    assert {r["state"] for r in w.audit(one, one.where("false")).collect()} == {"missing"}
