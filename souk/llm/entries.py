"""Registered queries over the text operators, and their expected SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import mixing, warc_fixity
from souk.llm.block_identity import exact_groups
from souk.llm.common import WORD, whole_text
from souk.llm.decontamination import contaminations
from souk.llm.fuzzy_lines import deduplicated
from souk.llm.imatch import beside_edited
from souk.llm.periodic_runs import with_runs
from souk.llm.pii_feistel import pseudonymise
from souk.llm.quality_cnn import scored
from souk.llm.secrets import span_text, with_secrets
from souk.llm.simhash_neardup import hex_fingerprint, near_duplicates
from souk.llm.site_style_tree import main_texts
from souk.llm.spelling_variants import runs_of_letters, spelling_forms
from souk.session import ship

#: Any key gives the same kind of result; a deployment brings its own, kept out of the code.
PSEUDONYM_KEY = "example"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(_table(spark, folder, "pages"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminations(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = with_secrets(_table(spark, folder, "documents"))
    counts = [F.size(f"known.{kind}").cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("found").alias("spans"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The WARC records of all pages against a replica in which some rotted and some were lost.

    Rot turns the payload end for end, so lengths stay; which records it meets follows from page_id.
    """
    rotten = warc_fixity.warc_record(F.col("url"), F.reverse("html"))
    two = F.when(F.col("page_id") % 89 == 5, F.sha2(rotten, 256)).otherwise(F.sha2("record", 256))
    layout = warc_fixity.warc_layout(_table(spark, folder, "pages"), also={"digest_two": two})
    other = layout.where(F.col("page_id") % 211 != 7).withColumn("digest", F.col("digest_two"))
    found = warc_fixity.audit(layout, other)
    return found.join(layout.select("file", "offset", "page_id"), ["file", "offset"])


def op7_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(_table(spark, folder, "documents"))


def op8_pii_feistel(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(_table(spark, folder, "documents"), PSEUDONYM_KEY)


def op9_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(_table(spark, folder, "documents"))


def op11_imatch(spark: SparkSession, folder: str) -> DataFrame:
    found = beside_edited(_table(spark, folder, "documents"))
    edited = F.sha2("edited", 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of 7 letters and more that occur twice, after one run in 31 of a document has lost a letter.

    Which run loses which letter follows from the checksum of id and run; a NULL id counts as an empty one.
    """
    docs = _table(spark, folder, "documents")
    # A shorter run cannot become a word, so only runs of at least 7 letters are taken.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")).alias("doc"), F.explode(runs_of_letters(least=7)).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % 31 == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    words = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return spelling_forms(words, ratio=10)


def _partly_periodic(docs: DataFrame) -> DataFrame:
    """One text in ten, chosen by the checksum of its id, repeats its words from a place on; a row without id never."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary"))
    changes = F.coalesce(h % 10 == 0, F.lit(False)).alias("changes")
    words = F.when(F.col("changes"), F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0)))
    n, g = F.size("words").cast("bigint"), F.floor(h / 10)
    begin, rest = F.col("begin"), F.col("n") - F.col("begin")
    repeated = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[int(if(i < begin, i, begin + (i - begin) % period))]), ' ')")
    return (
        docs.select("doc_id", "text", g.alias("g"), changes)
        .withColumn("words", words)
        .withColumn("n", n)
        .withColumn("begin", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("period", 1 + F.floor(rest / (3 + F.col("g") % 8)))
        .select("doc_id", F.when(F.col("changes") & (F.col("n") > 0), repeated).otherwise(F.col("text")).alias("text"))
    )


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = with_runs(_partly_periodic(_table(spark, folder, "documents").select("doc_id", "text")))
    line = lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", line), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        "best.length",
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_site_style_tree,
        op2_decontamination,
        op3_simhash_neardup,
        op4_secret_scan,
        op5_source_mixing,
        op6_warc_fixity,
        op7_fuzzy_lines,
        op8_pii_feistel,
        op9_quality_cnn,
        op10_exact_dedup,
        op11_imatch,
        op12_spelling_variants,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op5_source_mixing": mixing.ORACLE_SQL,
    "op6_warc_fixity": r"""
        with sized as (
            select page_id, cast(
                octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                    || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') || chr(13) || chr(10)
                    || 'Content-Type: text/html' || chr(13) || chr(10)
                    || 'WARC-Payload-Digest: sha256:')) + 64 + 2
                + length('Content-Length: ') + length(cast(octet_length(encode(coalesce(html, ''))) as varchar)) + 4
                + octet_length(encode(coalesce(html, ''))) + 4 as bigint) as length
            from pages
        ), placed as (
            select *, cast(sum(length) over (order by page_id rows unbounded preceding) as bigint) - length as begin from sized
        ), filed as (
            select *, begin // 1073741824 as file, begin - min(begin) over (partition by begin // 1073741824) as "offset" from placed
        )
        select file, "offset", case when page_id % 211 = 7 then 'missing' else 'changed' end as state,
            length as length_one, case when page_id % 211 <> 7 then length end as length_two, page_id
        from filed where page_id % 89 = 5 or page_id % 211 = 7
    """,
    "op10_exact_dedup": r"""
        with normal as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
        ), ranked as (
            select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
                row_number() over (partition by t order by doc_id nulls last) as place
            from normal
        )
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from ranked
    """,
}
