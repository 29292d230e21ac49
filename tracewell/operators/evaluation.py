"""Retrieval metrics, threshold calibration, regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Per stage and query: hit, recall, precision, rr, ndcg of ranked (stage, query_id, rank from 0, id)."""
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = ranked.join(relevant.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    near = F.col("rank") < k
    gains = F.sum(F.when(near & F.col("hit"), 1 / F.log2(F.col("rank") + 2)).otherwise(0.0))
    found = marked.groupBy("stage", "query_id").agg(
        F.count_if(near & F.col("hit")).alias("hits"), F.count_if(near).alias("returned"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), gains.alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_relevant"), F.lit(k))).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + F.lit(1)))
    return found.join(counts, "query_id").select(
        "stage",
        "query_id",
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"),
        F.round(F.col("hits") / F.greatest(F.col("returned"), F.lit(1)), 6).alias("precision"),
        F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("rr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def stage_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("stage").agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 4).alias(m) for m in ("hit", "recall", "precision", "rr", "ndcg")])


def calibrate(scores: DataFrame) -> DataFrame:
    """Best abstention threshold for scores (score, abstain): a midpoint of neighbours or just beyond an end.

    Counts of both kinds are accumulated over the distinct scores, so no threshold meets every score.
    """
    per = scores.groupBy("score").agg(F.count_if(~F.col("abstain")).alias("answerable"), F.count_if("abstain").alias("abstain"))
    # a total order over distinct scores: partial counts are small, one row per distinct score
    order = Window.orderBy("score")
    steps = per.select(
        "score",
        F.lead("score").over(order).alias("next"),
        F.lag("score").over(order).alias("previous"),
        F.sum("abstain").over(order).alias("below_abstain"),
        F.sum("answerable").over(order).alias("below_answerable"),
        F.sum("abstain").over(Window.partitionBy()).alias("n_abstain"),
        F.sum("answerable").over(Window.partitionBy()).alias("n_answerable"),
    )
    after = steps.select(
        F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 0.01).alias("threshold"), "below_abstain", "below_answerable", "n_abstain", "n_answerable"
    )
    before = steps.where("previous is null").select((F.col("score") - 0.01).alias("threshold"), F.lit(0).alias("below_abstain"), F.lit(0).alias("below_answerable"), "n_abstain", "n_answerable")
    tried = after.unionByName(before).withColumn("correct", F.col("below_abstain") + F.col("n_answerable") - F.col("below_answerable"))
    best = tried.agg(F.max_by(F.struct("*"), F.struct("correct", "threshold")).alias("b")).select("b.*")
    return best.where("threshold is not null").select(
        F.round("threshold", 6).alias("threshold"),
        F.round(F.col("correct") / (F.col("n_abstain") + F.col("n_answerable")), 6).alias("accuracy"),
        F.col("below_answerable").alias("false_abstain"),
        (F.col("n_abstain") - F.col("below_abstain")).alias("false_answer"),
    )


def gate(baseline: DataFrame, report: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, value) tables compared: delta and whether it falls by more than the tolerance."""
    both = baseline.select("metric", F.col("value").alias("was")).join(report.select("metric", F.col("value").alias("now")), "metric")
    delta = F.round(F.col("now") - F.col("was"), 6)
    return both.select("metric", "was", "now", delta.alias("delta"), (delta < -tolerance).alias("failed"))
