"""Running sums that no single task has to make for a whole key.

A plain window sorts all rows of a key in one task. Here rows are cut into blocks of the order
column; block sums are made with map-side partial sums, their running totals by a window over
blocks only, and the rows' own running sums by a window over (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a block.
BLOCK = 1 << 16


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with, for each name, the sum of its expression up to and including the row, by ``by`` in ``order``.

    ``order`` is an integer column without nulls; rows of one key that tie in it are taken in any order.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy(*by, "_block").agg(*[F.sum(e).alias(f"_{k}") for k, e in sums.items()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inner = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumns({k: F.sum(e).over(inner) for k, e in sums.items()})
        .join(totals, [*by, "_block"])
        .select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])
    )


def numbered(df: DataFrame, by: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the row's number from 0 within ``by`` in ``order``."""
    return running(df, by, order, {name: F.lit(1).cast("long")}, block).withColumn(name, F.col(name) - 1)
