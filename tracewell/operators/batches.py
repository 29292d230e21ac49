"""Texts to embed, in batches of bounded size, without those that a cache holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The most texts and estimated tokens of a batch, and the characters of a token.
BATCH_TEXTS, BATCH_TOKENS, TOKEN_CHARS = 64, 3500, 4


def token_batches(inputs: DataFrame, cache: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Distinct inputs (embed_hash, text) that are not in the cache (embed_hash), as embed_hash, text, tokens, batch.

    A batch holds at most 64 texts and 3500 tokens; a text above that stands alone. ``ratio`` is the number of tokens counted by
    the service over those estimated before. Each partition fills its own batches as its rows come, so nothing is gathered;
    batch names are unique in a run, and what a rerun puts together depends on the partitions.
    """
    fresh = inputs.where("text is not null").join(cache.select("embed_hash"), "embed_hash", "left_anti")
    fresh = fresh.groupBy("embed_hash").agg(F.min("text").alias("text"))
    fresh = fresh.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / TOKEN_CHARS * ratio).cast("int")))

    # only numbers go to Python; the texts stay where they are, and are not held by the batch
    name = F.concat_ws("-", F.spark_partition_id().cast("string"), _filled("tokens").cast("string"))
    return fresh.select("embed_hash", "text", "tokens", name.alias("batch"))


def _fill(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    batch, texts, total = 0, 0, 0
    for frame in frames:
        named = []
        for tokens in frame.tolist():
            if texts and (texts == BATCH_TEXTS or total + tokens > BATCH_TOKENS):
                batch, texts, total = batch + 1, 0, 0
            texts, total = texts + 1, total + tokens
            named.append(batch)
        yield pd.Series(named, dtype="int64")


_filled = F.pandas_udf(_fill, LongType()).asNondeterministic()
