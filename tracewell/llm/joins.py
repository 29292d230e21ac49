"""Joins with small tables: broadcast behind a check of the size, a shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_bound(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of a saved table, marked for broadcast only where there are at most ``limit`` of them."""
    return F.broadcast(rows) if rows.count() <= limit else rows
