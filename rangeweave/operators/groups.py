"""Consumer groups: committed offsets, epochs, delivery tracking, membership and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.operators.sizes import small

KEY = ["group_id", "range_id"]


def accepted_commits(log: DataFrame) -> DataFrame:
    """Commits of the epoch that is current when they arrive; epochs are sealed by rows of kind Seal. Later epochs' early commits wait (see park)."""
    order = Window.partitionBy(*KEY).orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.coalesce(F.max(F.when(F.col("kind") == "Seal", F.col("generation"))).over(order), F.lit(0).cast("long"))
    return log.withColumn("epoch", epoch).filter((F.col("kind") == "Commit") & (F.col("generation") == F.col("epoch")))


def committed_offsets(log: DataFrame) -> DataFrame:
    """The greatest accepted position by (entry, offset) for each group and range."""
    best = F.max(F.struct("entry_id", "batch_offset"))
    return accepted_commits(log).groupBy(*KEY).agg(best.alias("p")).select(*KEY, F.col("p.entry_id").alias("entry_id"), F.col("p.batch_offset").alias("batch_offset"))


def commit_verdicts(log: DataFrame) -> DataFrame:
    """T4: each commit is Staged, StaleEpoch, or Parked until its epoch is sealed; parked ones are staged by that seal, others wait on."""
    order = Window.partitionBy(*KEY).orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    seal = F.when(F.col("kind") == "Seal", F.col("generation"))
    last = log.filter("kind = 'Seal'").groupBy(*KEY, "generation").agg(F.max("lsn").alias("_sealed"))
    rows = log.withColumn("epoch", F.coalesce(F.max(seal).over(order), F.lit(0).cast("long"))).join(last, [*KEY, "generation"], "left")
    verdict = (
        F.when(F.col("generation") < F.col("epoch"), "StaleEpoch")
        .when(F.col("generation") == F.col("epoch"), "Staged")
        .when(F.col("_sealed") > F.col("lsn"), "ParkedThenStaged")
        .otherwise("Parked")
    )
    return rows.filter("kind = 'Commit'").select("lsn", *KEY, "generation", verdict.alias("verdict"))


def read_offset(log: DataFrame, generation: int) -> DataFrame:
    """T5: each key's position at exactly ``generation``; else the generation observed."""
    epochs = log.groupBy(*KEY).agg(F.coalesce(F.max(F.when(F.col("kind") == "Seal", F.col("generation"))), F.lit(0).cast("long")).alias("generation"))
    rows = epochs.join(committed_offsets(log), KEY, "left")
    same = F.col("generation") == generation
    return rows.select(*KEY, F.when(same, "Ok").otherwise("GenerationMismatch").alias("verdict"), "generation", F.when(same, F.col("entry_id")).alias("entry_id"), F.when(same, F.col("batch_offset")).alias("batch_offset"))


def bootstrap(own: DataFrame, received: DataFrame) -> DataFrame:
    """The greater epoch and the greater position of two ledgers (group, range, generation, entry_id, batch_offset)."""
    best = F.max(F.struct("entry_id", "batch_offset"))
    rows = own.unionByName(received).groupBy(*KEY).agg(F.max("generation").alias("generation"), best.alias("p"))
    return rows.select(*KEY, "generation", F.col("p.entry_id").alias("entry_id"), F.col("p.batch_offset").alias("batch_offset"))


def start_positions(ranges: DataFrame, committed: DataFrame, default_entry: int = 0) -> DataFrame:
    """Saved positions, else the default; absolute offsets go on one after the saved record."""
    rows = ranges.select("range_id").join(committed, "range_id", "left")
    return rows.select("range_id", F.coalesce("entry_id", F.lit(default_entry).cast("long")).alias("entry_id"), F.coalesce("batch_offset", F.lit(-1).cast("long")).alias("after_offset"))


def lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Entries between a group's committed entry and the range's end (a derived measure; extension)."""
    return committed.join(ends, "range_id").select(*KEY, (F.col("end_exclusive") - 1 - F.col("entry_id")).alias("entries_behind"))


def tracked(log: DataFrame) -> DataFrame:
    """(seq, member, range_id, kind Deliver/Ack/Commit, pos): adds delivered, committable, committed after each row and a verdict.

    An ack beyond what was delivered is refused; a commit advances only to a higher committable position.
    """
    order = Window.partitionBy("range_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    delivered = F.max(F.when(F.col("kind") == "Deliver", F.col("pos"))).over(order)
    rows = log.withColumn("delivered", delivered)
    refused = (F.col("kind") == "Ack") & (F.col("delivered").isNull() | (F.col("pos") > F.col("delivered")))
    rows = rows.withColumn("_ok", (F.col("kind") == "Ack") & ~refused)
    rows = rows.withColumn("committable", F.max(F.when(F.col("_ok"), F.col("pos"))).over(order))
    rows = rows.withColumn("committed", F.max(F.when(F.col("kind") == "Commit", F.col("committable"))).over(order))
    before = Window.partitionBy("range_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    old = F.max(F.when(F.col("kind") == "Commit", F.col("committable"))).over(before)
    verdict = (
        F.when(refused & F.col("delivered").isNull(), "NotDelivered")
        .when(refused, "AheadOfDelivered")
        .when((F.col("kind") == "Commit") & (F.col("committable").isNull() | (F.col("committable") <= old)), "NothingToCommit")
        .otherwise("Ok")
    )
    return rows.select("seq", "range_id", "kind", "pos", "delivered", "committable", "committed", verdict.alias("verdict"))


def assigned(members: DataFrame, ranges: DataFrame) -> DataFrame:
    """Active ranges in order to members in order, round robin, for each group."""
    m = members.select("group_id", "member", (F.row_number().over(Window.partitionBy("group_id").orderBy("member")) - 1).alias("_m"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    r = ranges.filter("state = 'Active'").select("range_id", (F.row_number().over(Window.orderBy("keyspace_start")) - 1).alias("_r"))
    wanted = sizes.crossJoin(small(r)).withColumn("_m", F.col("_r") % F.col("_n"))
    return wanted.join(m, ["group_id", "_m"]).select("group_id", "range_id", "member")


def membership(commands: DataFrame, timeout: int) -> DataFrame:
    """(group_id, seq, generation, members, ranges) after each command (group_id, seq, member, action, at, ranges).

    Members unseen for more than ``timeout`` go first, then the action applies. The generation rises when the set
    of members changed, or when the active ``ranges`` at the command aren't the ones that are assigned (none are
    while the group is empty). One group's commands are folded in order; groups are dealt over the cluster.
    """
    from collections.abc import Iterator

    import pandas as pd

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, generation, held = None, {}, 0, ()
        for frame in frames:
            generations, members, owned = [], [], []
            for g, m, action, at, ranges in zip(frame.group_id, frame.member, frame.action, frame["at"], frame.ranges, strict=True):
                if g != now:
                    now, seen, generation, held = g, {}, 0, ()
                before, wanted = set(seen), tuple(sorted(ranges))
                seen = {k: t for k, t in seen.items() if max(0, at - t) <= timeout}
                if action == "Leave":
                    seen.pop(m, None)
                else:
                    seen[m] = at
                if set(seen) != before or held != wanted:
                    generation, held = generation + 1, wanted if seen else ()
                generations.append(generation)
                members.append(",".join(sorted(seen)))
                owned.append(",".join(map(str, held)))
            yield pd.DataFrame({"group_id": frame.group_id, "seq": frame.seq, "generation": generations, "members": members, "ranges": owned})

    rows = commands.select("group_id", "seq", "member", "action", "at", "ranges")
    return rows.repartition("group_id").sortWithinPartitions("group_id", "seq").mapInPandas(fold, "group_id string, seq long, generation long, members string, ranges string")


def delivered_by(log: DataFrame, semantic: str) -> DataFrame:
    """(seq, range_id, kind Deliver/Ack/Commit, pos) under AtLeastOnce or AtMostOnce: (range_id, delivered, committed, again).

    At least once, records are acknowledged by their reader; at most once, by their delivery. A commit takes the
    greatest acknowledged position; after a crash reading goes on behind it, so ``again`` positions come twice.
    """
    if semantic not in ("AtLeastOnce", "AtMostOnce"):
        raise ValueError(f"unknown semantic {semantic}")
    if semantic == "AtMostOnce":
        log = log.filter("kind <> 'Ack'")
        log = log.unionByName(log.filter("kind = 'Deliver'").withColumn("kind", F.lit("Ack")))
        # a delivery comes before its own acknowledgement
        log = log.withColumn("seq", F.col("seq") * 2 + (F.col("kind") == "Ack").cast("long"))
    rows = tracked(log).groupBy("range_id").agg(F.max("delivered").alias("delivered"), F.max("committed").alias("committed"))
    return rows.withColumn("again", F.col("delivered") - F.coalesce("committed", F.lit(-1)))


def auto_commits(log: DataFrame, interval_ms: int) -> DataFrame:
    """Acknowledged positions (range_id, at_ms, pos) to commits (range_id, at_ms, pos): at each tick of the interval the greatest so far, if it rose."""
    tick = (F.floor(F.col("at_ms") / interval_ms) + 1) * interval_ms
    best = log.groupBy("range_id", tick.alias("at_ms")).agg(F.max("pos").alias("pos"))
    before = F.max("pos").over(Window.partitionBy("range_id").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("pos") > F.col("_before"))).select("range_id", "at_ms", "pos")


def rebalances(changes: DataFrame, started_ms: int, tick_ms: int = 1000, grace: int = 2) -> DataFrame:
    """When a consumer that started at ``started_ms`` takes up changes (member, at_ms): ticks begin at its start, the first ``grace`` only pass."""
    tick = F.ceil((F.col("at_ms") - started_ms) / tick_ms) * tick_ms + started_ms
    return changes.select("member", "at_ms", F.greatest(tick, F.lit(started_ms + grace * tick_ms)).cast("long").alias("taken_ms"))


def expired_members(heartbeats: DataFrame, timeout_ms: int) -> DataFrame:
    """Sessions of a member's heartbeats: a gap of more than ``timeout_ms`` ends one."""
    order = Window.partitionBy("member").orderBy("at_ms")
    rows = heartbeats.withColumn("_new", (F.coalesce(F.col("at_ms") - F.lag("at_ms").over(order), F.lit(timeout_ms + 1)) > timeout_ms).cast("long"))
    rows = rows.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("member", "session").agg(F.min("at_ms").alias("joined_ms"), (F.max("at_ms") + timeout_ms).alias("expires_ms"), F.count(F.lit(1)).alias("heartbeats"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranges that a rebalance takes away or hands out: (range_id, member, change)."""
    key = ["range_id", "member"]
    return before.select(*key).exceptAll(after.select(*key)).withColumn("change", F.lit("Revoked")).unionByName(
        after.select(*key).exceptAll(before.select(*key)).withColumn("change", F.lit("Granted"))
    )


def silences(heartbeats: DataFrame, suspect_ms: int, dead_ms: int) -> DataFrame:
    """T16 in batch: (node, suspect_ms, dead_ms) for each silence longer than ``suspect_ms``; dead_ms is null if a heartbeat came before the node was given up."""
    nxt = F.lead("at_ms").over(Window.partitionBy("node").orderBy("seq"))
    rows = heartbeats.withColumn("_gap", F.coalesce(nxt - F.col("at_ms"), F.lit(2**62)))
    given_up = F.when(F.col("_gap") > suspect_ms + dead_ms, F.col("at_ms") + suspect_ms + dead_ms)
    return rows.filter(F.col("_gap") > suspect_ms).select("node", (F.col("at_ms") + suspect_ms).alias("suspect_ms"), given_up.alias("dead_ms"))
