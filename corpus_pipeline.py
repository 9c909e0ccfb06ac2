"""Corpus pipeline: documents -> packed token pieces in five stages.

toxicity (10) -> n-gram Jaccard join (6) -> suffix-array dedup (9) -> benchmark decontamination
(3) -> packing (5).  Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet to the shared folder and read again as the docs of the next stage.  All but
the last return the columns of ``documents``.

Rows with a null doc_id pass the join stage (they cannot be named as a group's document); a
null text is the empty text; a document whose text is removed as a whole stays with an empty
text.  Repeated rows of one doc_id are one document for the join stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, ngram_join, packing, suffix_dedup, toxicity
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.sources.tables import read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or
    more: that with the smallest doc_id."""
    links = ngram_join.link_documents(docs.select("doc_id", "text"), size=5, percent=80)
    first = links.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def _whole_characters(part: Column) -> Column:
    """Text of a run of bytes of a valid text, without the characters that its ends cut through."""
    byte = F.decode(part, "ISO-8859-1")         # one letter per byte
    byte = F.regexp_replace(byte, r"^[\x80-\xBF]+", "")
    byte = F.regexp_replace(byte, r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})\z", "")
    return F.encode(byte, "ISO-8859-1").cast("string")


def mended(kept: Column, spans: Column) -> Column:
    """What is left of a text after the removal of byte spans, as text: kept is cut where a span was
    removed, and each part loses the characters that the cuts go through, nothing else."""
    cut = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("gone"), F.array().cast("array<bigint>").alias("at")),
        lambda s, x: F.struct((s["gone"] + x["end"] - x["start"]).alias("gone"),
                              F.concat(s["at"], F.array(x["start"] - s["gone"])).alias("at")), lambda s: s["at"])
    first, last = F.concat(F.array(F.lit(0).cast("long")), cut), F.concat(cut, F.array(F.length(kept).cast("long")))
    part = lambda a, b: _whole_characters(F.substring(kept, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) == 0, kept.cast("string")).otherwise(F.array_join(F.zip_with(first, last, part), ""))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has; characters that are cut
    through go as well."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = suffix_dedup.remove_repeats(docs, carry=others)
    out = out.select("doc_id", mended(F.col("kept"), F.col("spans")).alias("text"), "rest.*")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


STAGES = [("toxicity", toxicity_stage), ("ngram_join", join_stage), ("suffix_dedup", suffix_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: the label model, sketches, suffix sorting and tokeniser have no SQL form; tested by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
