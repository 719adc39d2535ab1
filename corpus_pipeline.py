"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Rules, near-duplicates and contamination take documents out, the secret scan rewrites texts, packing
makes the sequences. Every stage is written as Parquet and read again before the next one starts.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm.decontaminate import benchmark_hits, contaminated
from supplyscope.llm.packing import pack
from supplyscope.llm.quality_rules import quality_rules
from supplyscope.llm.secret_scan import redact
from supplyscope.llm.simhash import near_duplicates
from supplyscope.plans.shared import settle, shared_folder

TOKENIZER = "word_bpe_49k.json"


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """`docs` but the rows whose id and text hash are in `rejected` (doc_id, row_hash)."""
    gone = rejected.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__hash"])
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return _without(docs, settle(quality_rules(docs).where("not kept").select("doc_id", "row_hash")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of equal rows one."""
    text_hash = F.xxhash64("text").alias("h")
    keyed = docs.select(F.struct(F.col("doc_id"), text_hash).alias("key"), "text")
    groups = near_duplicates(keyed, "key", "text")
    first = settle(groups.groupBy("component").agg(F.min("key").alias("k")).select("k.*"))
    same = docs["doc_id"].eqNullSafe(first["doc_id"]) & (F.xxhash64(docs["text"]) == first["h"])
    place = F.monotonically_increasing_id()
    rows = docs.select("doc_id", text_hash).withColumn("place", place)
    twice = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = docs.join(first, same, "left_semi")
    # equal rows of a kept document: only where there are any is one picked
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, settle(hits.where(contaminated()).select("doc_id", "row_hash")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced and n_chars counted again."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in the sequences."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
