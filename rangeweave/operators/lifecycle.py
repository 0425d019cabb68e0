"""Life of ranges and segments: pressure, split, merge, retention, repair, reclaim."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.functions.keyspace import midpoint

#: Fixed value: pressure rolls in a row after which a range splits.
SPLIT_AFTER = 3
#: Bytes at which a log file is rotated, and bytes of a frame besides its payload.
WAL_FILE, WAL_FRAME = 64 << 20, 17


def pressure_streak(rolls: DataFrame) -> DataFrame:
    """Adds streak to rolls (range_id, seq, intent): data pressure adds one up to 3, idle maintenance sets 0, others keep it."""
    order = Window.partitionBy("range_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    idle = F.sum((F.col("intent") == "IdleMaintenance").cast("long")).over(order)
    rows = rolls.withColumn("_run", idle)
    inside = Window.partitionBy("range_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum((F.col("intent") == "DataPressure").cast("long")).over(inside)
    return rows.withColumn("streak", F.least(F.lit(SPLIT_AFTER).cast("long"), count)).drop("_run")


def load_state(rolls: DataFrame) -> DataFrame:
    """(range_id, load, streak): Pressure, Idle or Unclassified after the last roll."""
    rows = pressure_streak(rolls)
    last = rows.groupBy("range_id").agg(F.max_by("streak", "seq").alias("streak"), F.bool_or(F.col("intent") == "IdleMaintenance").alias("_idle"))
    return last.select("range_id", F.when(F.col("streak") > 0, "Pressure").when(F.col("_idle"), "Idle").otherwise("Unclassified").alias("load"), "streak")


def split_candidates(ranges: DataFrame, loads: DataFrame, strategy: str = "AutoSplit") -> DataFrame:
    """Active ranges under pressure with the midpoint at which they split; none where it isn't strictly inside."""
    hot = ranges.filter("state = 'Active'").join(loads.filter(F.col("streak") >= SPLIT_AFTER).select("range_id"), "range_id", "left_semi")
    found = hot.withColumn("split_point", midpoint(F.col("keyspace_start"), F.col("keyspace_end")))
    return found.filter((F.lit(strategy) == "AutoSplit") & (F.col("keyspace_start") < F.col("split_point")) & (F.col("split_point") < F.col("keyspace_end")))


def split(ranges: DataFrame, chosen: DataFrame) -> DataFrame:
    """R2: ``ranges`` after the splits in ``chosen`` (range_id, split_point): parents sealed, two active children each, new ids in start order."""
    order = Window.orderBy("keyspace_start")
    marked = ranges.join(chosen.select("range_id", "split_point"), "range_id", "left")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = marked.withColumn("_next", F.max("range_id").over(every) + 1)
    rank = F.sum(F.col("split_point").isNotNull().cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    marked = marked.withColumn("_left", F.when(F.col("split_point").isNotNull(), F.col("_next") + 2 * rank))
    parents = marked.withColumns(
        {
            "state": F.when(F.col("_left").isNotNull(), "Sealed").otherwise(F.col("state")),
            "split_into": F.when(F.col("_left").isNotNull(), F.array("_left", F.col("_left") + 1)).otherwise(F.col("split_into")),
        }
    ).select(*ranges.columns)
    none = {f.name: F.lit(None).cast(f.dataType) for f in ranges.schema}
    children = marked.filter("split_point is not null").select(
        F.explode(
            F.array(
                F.struct(F.col("_left").alias("range_id"), F.col("keyspace_start"), F.col("split_point").alias("keyspace_end")),
                F.struct((F.col("_left") + 1).alias("range_id"), F.col("split_point").alias("keyspace_start"), F.col("keyspace_end")),
            )
        ).alias("c")
    )
    given = {"range_id": F.col("c.range_id"), "keyspace_start": F.col("c.keyspace_start"), "keyspace_end": F.col("c.keyspace_end"), "state": F.lit("Active")}
    return parents.unionByName(children.select(*[(given.get(k, none[k])).alias(k) for k in ranges.columns]))


def merge_candidate(ranges: DataFrame, loads: DataFrame) -> DataFrame:
    """The first pair of neighbouring active ranges that are both idle and touch, with the merged key space."""
    order = Window.orderBy("keyspace_start")
    rows = ranges.filter("state = 'Active'").join(loads, "range_id", "left").select("range_id", "keyspace_start", "keyspace_end", "load")
    nxt = {k: F.lead(k).over(order).alias(f"next_{k}") for k in ("range_id", "keyspace_start", "keyspace_end", "load")}
    pairs = rows.select("*", *nxt.values()).filter("load = 'Idle' and next_load = 'Idle' and keyspace_end = next_keyspace_start")
    return pairs.orderBy("keyspace_start").limit(1).select(
        F.col("range_id").alias("range_id_1"), F.col("next_range_id").alias("range_id_2"), "keyspace_start", F.col("next_keyspace_end").alias("keyspace_end")
    )


def retention_prefix(segments: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Sealed segments that expired, oldest first, up to the first one that stays; those being deleted are passed over."""
    order = Window.partitionBy("range_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    expired = F.coalesce((F.col("state") == "Sealed") & (F.col("sealed_at_ms") + retention_ms < now_ms), F.lit(False))
    rows = segments.filter("state <> 'Deleting'").withColumn("_all", F.min(expired.cast("int")).over(order))
    return rows.filter("_all = 1").drop("_all")


def delete_segments(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen (range_id, segment_id) go to Deleting if they are Sealed; doing it twice changes nothing."""
    marked = segments.join(chosen.select("range_id", "segment_id", F.lit(True).alias("_gone")), ["range_id", "segment_id"], "left")
    state = F.when(F.col("_gone") & (F.col("state") == "Sealed"), "Deleting").otherwise(F.col("state"))
    return marked.withColumn("state", state).drop("_gone").select(*segments.columns)


def correct_boundaries(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends (range_id, segment_id, end) fill unknown ends of sealed segments; the successor starts one after."""
    rows = segments.join(ends.withColumnRenamed("end", "_end"), ["range_id", "segment_id"], "left")
    fill = (F.col("state") == "Sealed") & F.col("end_entry_id").isNull() & F.col("_end").isNotNull()
    rows = rows.withColumn("_set", F.when(fill, F.col("_end")))
    before = F.lag("_set").over(Window.partitionBy("range_id").orderBy("segment_id"))
    return rows.withColumns({"start_entry_id": F.coalesce(before + 1, F.col("start_entry_id")), "end_entry_id": F.coalesce("end_entry_id", "_set")}).select(*segments.columns)


def reassign(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """Plan (range_id, segment_id, new_replicas): sealed segments only; the same set is no change."""
    rows = segments.join(plan, ["range_id", "segment_id"], "left")
    same = F.array_sort("new_replicas") == F.array_sort("replicas")
    take = F.col("new_replicas").isNotNull() & (F.col("state") == "Sealed") & ~same
    return rows.withColumn("changed", F.coalesce(take, F.lit(False))).withColumn("replicas", F.when(take, F.col("new_replicas")).otherwise(F.col("replicas"))).drop("new_replicas")


def with_dead_members(segments: DataFrame, live: DataFrame) -> DataFrame:
    """Segments that are active, or sealed with a known end, and have replicas that aren't alive (``dead``)."""
    names = live.agg(F.collect_set("node_id").alias("_live"))
    rows = segments.join(F.broadcast(names)).withColumn("dead", F.array_except("replicas", "_live")).drop("_live")
    return rows.filter(((F.col("state") == "Active") | ((F.col("state") == "Sealed") & F.col("end_entry_id").isNotNull())) & (F.size("dead") > 0))


def triage(damaged: DataFrame) -> DataFrame:
    """One dead replica of an active segment: recover its boundary; more: roll; sealed ones: replace."""
    action = F.when(F.col("state") == "Sealed", "Reassign").when(F.size("dead") == 1, "BoundaryRecovery").otherwise("Roll")
    return damaged.withColumn("action", action)


def replacements(damaged: DataFrame, live: DataFrame) -> DataFrame:
    """Survivors in order, then live candidates by node id up to the old number of replicas."""
    names = live.agg(F.array_sort(F.collect_set("node_id")).alias("_live"))
    rows = damaged.join(F.broadcast(names))
    kept = F.array_except("replicas", "dead")
    wide = F.concat(kept, F.array_except("_live", "replicas"))
    return rows.withColumn("new_replicas", F.slice(wide, F.lit(1), F.size("replicas"))).drop("_live")


def boundary_survivors(segments: DataFrame) -> DataFrame:
    """For sealed segments of unknown end: the replicas that are also the successor's."""
    nxt = F.lead("replicas").over(Window.partitionBy("range_id").orderBy("segment_id"))
    rows = segments.withColumn("_next", nxt).filter("state = 'Sealed' and end_entry_id is null")
    return rows.select("range_id", "segment_id", F.array_intersect("replicas", "_next").alias("survivors"))


def roll_due(segments: DataFrame, now_ms: int, idle_ms: int, size_limit: int, leader: str) -> DataFrame:
    """Active segments that ``leader`` leads: Size when full, Idle when quiet for long."""
    own = segments.filter((F.col("state") == "Active") & (F.element_at("replicas", 1) == leader))
    reason = F.when(F.col("size_bytes") >= size_limit, "Size").when(F.lit(now_ms) - F.col("last_ms") >= idle_ms, "Idle")
    return own.withColumn("reason", reason).filter("reason is not null").select("range_id", "segment_id", "reason")


def size_rolls(segments: DataFrame, committed: DataFrame, size_limit: int) -> DataFrame:
    """(range_id, segment_id): active segments of at least ``size_limit`` bytes whose every entry is committed (range_id, committed)."""
    full = segments.filter((F.col("state") == "Active") & (F.col("size_bytes") >= size_limit))
    return full.join(committed, "range_id").filter("committed >= last_entry_id").select("range_id", "segment_id")


def refilled(segments: DataFrame, live: DataFrame) -> DataFrame:
    """``segments`` with the replicas of those that lost some filled up from the live nodes, as far as these go."""
    plan = replacements(with_dead_members(segments, live), live).select("range_id", "segment_id", "new_replicas")
    rows = segments.join(plan, ["range_id", "segment_id"], "left")
    return rows.withColumn("replicas", F.coalesce("new_replicas", "replicas")).drop("new_replicas")


def reclaim_watermark(checkpoints: DataFrame, durable_lsn: int, auxiliary_lsn: int | None) -> DataFrame:
    """The least checkpointed position over segments, at most the durable one, and the auxiliary mark."""
    least = F.least(F.coalesce(F.min("checkpoint_lsn"), F.lit(durable_lsn)), F.lit(durable_lsn), *([F.lit(auxiliary_lsn)] if auxiliary_lsn is not None else []))
    return checkpoints.agg(least.cast("long").alias("watermark"))


def cache_pressure(segments: DataFrame, budget: int, watermark: float) -> DataFrame:
    """Cached bytes against the budget."""
    total = F.coalesce(F.sum("cached_bytes"), F.lit(0)).cast("long")
    return segments.agg(total.alias("cached"), (total > F.lit(int(budget * watermark))).alias("over"))


def eviction_pick(segments: DataFrame) -> DataFrame:
    """The largest segment with something to checkpoint that isn't being checkpointed."""
    rows = segments.filter("checkpointable_bytes > 0 and not in_flight")
    return rows.orderBy(F.desc("checkpointable_bytes"), "range_id", "segment_id").limit(1).select("range_id", "segment_id", "checkpointable_bytes")


def rolled(entries: DataFrame, size_limit: int) -> DataFrame:
    """(range_id, entry_id, segment): a segment closes when its bytes reach the limit; ids go on. A resetting sum, folded in order for each range."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, segment, size = None, 0, 0
        for frame in frames:
            out = []
            for r, n in zip(frame.range_id.tolist(), frame.payload_bytes.tolist(), strict=True):
                if r != now:
                    now, segment, size = r, 0, 0
                out.append(segment)
                size += n
                if size >= size_limit:
                    segment, size = segment + 1, 0
            yield pd.DataFrame({"range_id": frame.range_id, "entry_id": frame.entry_id, "segment": out})

    rows = entries.select("range_id", "entry_id", "payload_bytes")
    return rows.repartition("range_id").sortWithinPartitions("range_id", "entry_id").mapInPandas(fold, "range_id long, entry_id long, segment long")


def wal_files(frames: DataFrame, watermark: DataFrame, size_limit: int = WAL_FILE) -> DataFrame:
    """(log_id, file, frames, bytes, first_lsn, max_lsn, reclaimed) of logs (log_id, lsn, payload_bytes) and a row (watermark).

    Frames of one position are flushed together; a file that reaches the limit is followed by a
    new one. Leading files up to the watermark go, but never the newest, which is still empty
    (and has no row) after a full one. A log is folded in order by one task, as streams of its flushes.
    """
    size = F.sum(F.col("payload_bytes") + WAL_FRAME).cast("long")
    flushes = frames.groupBy("log_id", "lsn").agg(F.count(F.lit(1)).alias("frames"), size.alias("bytes"))
    rolls = rolled(flushes.select(F.col("log_id").alias("range_id"), F.col("lsn").alias("entry_id"), F.col("bytes").alias("payload_bytes")), size_limit)
    rolls = rolls.select(F.col("range_id").alias("log_id"), F.col("entry_id").alias("lsn"), F.col("segment").alias("file"))
    files = flushes.join(rolls, ["log_id", "lsn"]).groupBy("log_id", "file")
    files = files.agg(*[F.sum(k).alias(k) for k in ("frames", "bytes")], F.min("lsn").alias("first_lsn"), F.max("lsn").alias("max_lsn"))
    # a file below the limit is its log's newest; positions rise from file to file, so those up to the watermark lead
    gone = (F.col("bytes") >= size_limit) & F.coalesce(F.col("max_lsn") <= F.col("watermark"), F.lit(False))
    return files.crossJoin(F.broadcast(watermark.select("watermark"))).select("log_id", "file", "frames", "bytes", "first_lsn", "max_lsn", gone.alias("reclaimed"))


def epoch_targets(groups: DataFrame, changed: DataFrame) -> DataFrame:
    """(topic_id, range_id, group_id, generation): every group of a topic learns of each changed range."""
    return groups.join(changed, "topic_id").select("topic_id", "range_id", "group_id", "generation")
