"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` to broadcast if it proves to have at most ``most`` rows; else as it is, for a join that Spark deals out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
