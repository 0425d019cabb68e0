"""Recovery of frames and entries after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verified_prefix(frames: DataFrame) -> DataFrame:
    """Data frames (file, lsn, kind, ok) that count: before the first bad frame and closed by a later BatchEnd."""
    order = Window.partitionBy("file").orderBy("lsn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    good = frames.withColumn("_bad", F.sum((~F.col("ok")).cast("long")).over(upto)).filter("_bad = 0")
    last_end = good.filter("kind = 'BatchEnd'").groupBy("file").agg(F.max("lsn").alias("_end"))
    return good.join(last_end, "file").filter("kind = 'Data' and lsn < _end").drop("_bad", "_end")


def replay(wal: DataFrame, cursors: DataFrame) -> DataFrame:
    """Verified entries above each segment's verified cursor (segment absent: all), in order; others are skipped."""
    c = cursors.withColumnRenamed("entry_id", "_upto")
    return wal.join(c, "range_id", "left").filter(F.col("_upto").isNull() | (F.col("entry_id") > F.col("_upto"))).drop("_upto")


def catch_up(incoming: DataFrame, have: DataFrame, sealed_end: DataFrame) -> DataFrame:
    """(range_id, reached, complete): copies append only the next id; duplicates and entries after a gap drop."""
    start = have.select("range_id", F.col("next_entry_id").alias("_next"))
    rows = incoming.select("range_id", "entry_id").distinct().join(start, "range_id").filter("entry_id >= _next")
    order = Window.partitionBy("range_id").orderBy("entry_id")
    rows = rows.withColumn("_rn", F.row_number().over(order) - 1).filter("entry_id = _next + _rn")
    reached = rows.groupBy("range_id").agg(F.max("entry_id").alias("reached"))
    found = have.join(reached, "range_id", "left").select("range_id", F.coalesce("reached", F.col("next_entry_id") - 1).alias("reached"))
    return found.join(sealed_end, "range_id").select("range_id", "reached", (F.col("reached") >= F.col("end_entry_id")).alias("complete"))


def orphans(recovered: DataFrame, registered: DataFrame, catching_up: DataFrame, sweep: int = 64) -> DataFrame:
    """Recovered segments neither registered as sealed nor being caught up, at most ``sweep`` a node, oldest first."""
    key = ["range_id", "segment_id"]
    rows = recovered.join(registered.filter("state = 'Sealed'").select(*key), key, "left_anti").join(catching_up.select(*key), key, "left_anti")
    order = Window.partitionBy("node_id").orderBy(*key)
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sweep).drop("_rn")
