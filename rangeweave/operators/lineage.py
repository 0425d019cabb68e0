"""Lineage of ranges over splits and merges: ancestors, depths, ownership, what may start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(ranges: DataFrame) -> DataFrame:
    """(parent, child, delegate): split and merge edges; the first child of a split and a merge's child inherit the parent's drain."""
    s = ranges.filter("split_into is not null").select(F.col("range_id").alias("parent"), F.posexplode("split_into").alias("pos", "child"))
    m = ranges.filter("merged_into is not null").select(F.col("range_id").alias("parent"), F.col("merged_into").alias("child"))
    return s.select("parent", "child", (F.col("pos") == 0).alias("delegate")).unionByName(m.withColumn("delegate", F.lit(True)))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): all pairs, by a recursive query; distance is the longest path."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("lineage_edges")
    return spark.sql(
        """
        WITH RECURSIVE walk(ancestor, descendant, distance) AS (
          SELECT parent, child, 1L FROM lineage_edges
          UNION ALL
          SELECT w.ancestor, e.child, w.distance + 1L FROM walk w JOIN lineage_edges e ON w.descendant = e.parent
        )
        SELECT ancestor, descendant, max(distance) AS distance FROM walk GROUP BY ancestor, descendant
        """
    )


def depths(ranges: DataFrame) -> DataFrame:
    """(range_id, depth): the longest way down from a root."""
    up = closure(edges(ranges)).groupBy(F.col("descendant").alias("range_id")).agg(F.max("distance").alias("depth"))
    return ranges.select("range_id").join(up, "range_id", "left").select("range_id", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def effective(ranges: DataFrame, assigned: DataFrame) -> DataFrame:
    """(member, range_id): assigned ranges and all sealed predecessors that they inherit."""
    own = closure(edges(ranges).filter("delegate").select("parent", "child"))
    more = assigned.join(own, assigned["range_id"] == own["descendant"]).select("member", F.col("ancestor").alias("range_id"))
    return assigned.select("member", "range_id").unionByName(more).distinct()


def checkpoint_lookups(ranges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ranges whose checkpoints a start needs: those wanted and all their ancestors."""
    up = closure(edges(ranges)).join(wanted, F.col("descendant") == F.col("range_id")).select(F.col("ancestor").alias("range_id"))
    return wanted.select("range_id").unionByName(up).distinct()


def startable(ranges: DataFrame, wanted: DataFrame, saved: DataFrame, running: DataFrame) -> DataFrame:
    """Wanted ranges that may start: no descendant runs, all ancestors are sealed, not running, and drained, and they aren't sealed and consumed.

    ``saved`` (range_id, next_entry_id): the position after the last consumed entry. A parent is drained when that is
    past its end, so a parent of one entry without a checkpoint isn't.
    """
    tree = closure(edges(ranges))
    busy = tree.join(running.select(F.col("range_id").alias("descendant")), "descendant").select(F.col("ancestor").alias("range_id"))
    state = ranges.select("range_id", "state", "end_entry_id").join(saved, "range_id", "left").withColumn("_next", F.coalesce("next_entry_id", F.lit(0).cast("long")))
    state = state.join(running.select("range_id", F.lit(True).alias("_runs")), "range_id", "left")
    undrained = state.filter((F.col("state") == "Active") | F.col("_runs") | ((F.col("state") == "Sealed") & (F.col("_next") <= F.col("end_entry_id"))))
    blocked = tree.join(undrained.select(F.col("range_id").alias("ancestor")), "ancestor").select(F.col("descendant").alias("range_id"))
    consumed = state.filter((F.col("state") == "Sealed") & (F.col("_next") > F.col("end_entry_id"))).select("range_id")
    return wanted.select("range_id").join(busy.union(blocked).union(consumed), "range_id", "left_anti")


def rebalance(ranges: DataFrame, assigned: DataFrame, saved: DataFrame, running: DataFrame) -> DataFrame:
    """(member, range_id, depth) of the effective ranges that may start, shallowest first."""
    own = effective(ranges, assigned)
    ok = startable(ranges, own.select("range_id").distinct(), saved, running)
    return own.join(ok, "range_id", "left_semi").join(depths(ranges), "range_id").select("member", "range_id", "depth")


def transitions(ranges: DataFrame, drained: DataFrame) -> DataFrame:
    """(range_id, starts_at): successors of drained ranges: split children at once; a merged range once all its tracked parents have drained.

    ``drained``: range_id, tracked parents that are done; parents that aren't tracked (``tracked`` false) don't hold a merge up.
    """
    e = edges(ranges)
    done = drained.filter("drained").select(F.col("range_id").alias("parent"), F.lit(True).alias("done"))
    tracked = drained.select(F.col("range_id").alias("parent"), F.lit(True).alias("tracked"))
    rows = e.join(done, "parent", "left").join(tracked, "parent", "left")
    ready = rows.groupBy("child").agg(F.bool_or(F.coalesce("done", F.lit(False))).alias("any"), F.bool_and(F.coalesce("done", F.lit(False)) | F.col("tracked").isNull()).alias("all"))
    return ready.filter(F.col("any") & F.col("all")).select(F.col("child").alias("range_id"), F.lit(0).cast("long").alias("starts_at"))
