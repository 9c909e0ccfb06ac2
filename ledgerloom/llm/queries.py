"""The ``opN_*`` queries over the driver tables and their SQL twins."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from . import alignment, ann_forest, chat, decontam, fingerprints, ngram_join, packing, phrases, spelling, suffix_dedup, toxicity, \
    url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.page_records(read_table(spark, sf_dir, "pages")), archive)
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return warc.read_warc(spark, archive, payload="digest").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


ORACLES["op1_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


@query
def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.remove_passages(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"),
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read_table(spark, sf_dir, "conversations"))


ORACLES["op4_chat_perspectives"] = chat.PERSPECTIVES_SQL


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


URL_RULES = [url_rules.UrlRule("block", "net", "/"), url_rules.UrlRule("allow", "example.net", "/en/"),
             url_rules.UrlRule("block", "example.com", "/de/"), url_rules.UrlRule("allow", "org", "/fr/")]


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(read_table(spark, sf_dir, "documents"))


@query
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.neighbour_fingerprints(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.marked_words(read_table(spark, sf_dir, "documents")))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(),
                                    tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
