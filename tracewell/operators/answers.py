"""Answers and generated cards: citations attached to lines, grounding figures, cards checked against what they may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T


def attach_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers (id, text) with [n] after each uncited line whose content words, three or more, are for the most part (0.7) in
    one source (id, n, text); the best source, of equals the one with the highest number. Only sources of the same answer
    that share a word with the line are compared.
    """
    counts = sources.groupBy("id").agg(F.max("n").alias("n_sources"))
    lines = answers.join(counts, "id", "left").select("id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("words", T.content_words(F.col("line")))
    open_ = lines.where((F.size("words") >= T.SUPPORT_WORDS) & (F.size(T.citations(F.col("line"), F.col("n_sources"))) == 0))
    words = open_.select("id", "at", F.size("words").alias("size"), F.explode("words").alias("word"))
    vocabulary = sources.select("id", "n", F.explode(T.content_words(F.col("text"))).alias("word")).distinct()
    shared = words.join(vocabulary, ["id", "word"]).groupBy("id", "at", "n").agg((F.count("*") / F.first("size")).alias("score"))
    best = shared.where(F.col("score") >= T.SUPPORT_SHARE).groupBy("id", "at").agg(F.max(F.struct("score", "n")).alias("b"))
    rows = lines.join(best.select("id", "at", F.col("b.n").alias("cited")), ["id", "at"], "left")
    body = F.rtrim(F.col("line"))
    marked = F.when(F.col("cited").isNotNull(), F.concat(body, F.lit(" ["), F.col("cited").cast("string"), F.lit("]"), F.substr("line", F.length(body) + 1))).otherwise(F.col("line"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", marked.alias("t")))), lambda r: r["t"]), "\n").alias("text"))


def answer_figures(answers: DataFrame, *by: str) -> DataFrame:
    """Shares of grounded answers, of answers that cite an expected source, and of right abstentions.

    answers: text, n_sources, expected (source numbers; empty where the answer must abstain). Null where nothing counts.
    """
    abstains = F.col("text").contains(T.ABSTAIN)
    must = F.size("expected") == 0
    hit = F.arrays_overlap(T.citations(F.col("text"), F.col("n_sources")), F.col("expected"))
    share = lambda flag: F.round(F.avg(flag.cast("double")), 6)
    return answers.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(T.grounded(F.col("text"), F.col("n_sources"))).alias("grounded"),
        share(F.when(~must, F.coalesce(hit, F.lit(False)))).alias("citation_hit"),
        share(abstains == must).alias("abstention"),
    )


def clean_cards(cards: DataFrame, allowed: Column) -> DataFrame:
    """Cards fit to keep: trimmed titles that are not empty, a known case type, each cited id once and among the allowed ones.

    A card that cites nothing allowed goes.
    """
    kind = F.lower(F.trim("case_type"))
    cited = F.array_distinct(F.array_intersect("sources", allowed))
    kept = cards.withColumns({"title": T.collapse(F.col("title")), "case_type": F.when(kind.isin(*T.CASE_TYPES), kind).otherwise(T.CASE_TYPES[0]), "sources": cited})
    return kept.where((F.length("title") > 0) & (F.size("sources") > 0))
