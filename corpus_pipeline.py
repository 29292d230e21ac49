"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each result as Parquet in the shared scratch folder and reads it again for the next stage.

Rows: documents that the quality rules reject go, one document of each near-duplicate class stays, secrets in the
texts give way to a placeholder (n_chars follows), each document is repeated as the mix takes it, and the result is
one row per packed piece. Null texts are rejected by the first stage; null languages, sources and ids pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm import mixing, neardup, packing, quality, secrets
from tracewell.llm.queries import secret_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, Scratch(spark, "stage1"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, Scratch(spark, "stage2"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secret_model(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copy_out(docs, Scratch(spark, "stage4"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "piece_salt")
    return packing.pack(Scratch(spark, "stage5").save(pieces, "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Signatures, models and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
