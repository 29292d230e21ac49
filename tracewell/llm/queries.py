"""The numbered queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scratch import Scratch
from tracewell.llm import best_fit, chat, collocations, embeddings, extraction, language_model, mixing, neardup, packing, quality, secrets, token_counts, whitening

#: Labelled documents whose words train the model of ordinary strings.
LABELLED = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "piece_salt")
    return packing.pack(Scratch(spark, "op1").save(pieces, "pieces"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scratch = Scratch(spark, "op4")
    measured = scratch.save(quality.with_statistics(docs).drop("text"), "measured")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(measured, scratch).select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in counts], quality.base_failed().alias("base_failed"), "kept", "distance"
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op5"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def secret_model(spark: SparkSession, sf_dir: str) -> list[float]:
    """Models from generated samples and words of labelled good documents (a bounded sample by hash order)."""
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    ordinary = secrets.document_samples(_table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return secrets.train(secrets.generated_samples(spark).unionByName(ordinary))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_spans(docs, secret_model(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scratch = Scratch(spark, "op9")
    measured = scratch.save(mixing.with_size_and_rank(docs).select("doc_id", "source", "mix_size", "mix_u"), "documents")
    return mixing.mix(measured, scratch).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select cast(-1 as bigint) conv_id, cast(x as bigint) turn, r role, p text from values "
        f"(0, 'user', '{chat.PROBE}'), (1, 'assistant', '{chat.PROBE}') as t(x, r, p)"
    )
    return chat.digest(chat.format_examples(table.unionByName(probe)))


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))
    # as long: null beyond its range
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = best_fit.cut_documents(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "piece_salt")
    return best_fit.pack(Scratch(spark, "op13").save(pieces, "pieces"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack_sequences": op1_pack_sequences,
        "op2_token_counts": op2_token_counts,
        "op3_lm_score": op3_lm_score,
        "op4_quality_rules": op4_quality_rules,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_html_extract": op6_html_extract,
        "op7_secret_scan": op7_secret_scan,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_mix_sources": op9_mix_sources,
        "op10_chat_format": op10_chat_format,
        "op11_whiten_embeddings": op11_whiten_embeddings,
        "op12_collocations": op12_collocations,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_mix_sources": mixing.ORACLE,
        "op10_chat_format": chat.ORACLE,
        "op12_collocations": collocations.ORACLE,
    }
