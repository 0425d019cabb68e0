"""Bounded reads of the log: byte budgets, seeks, start policies, segment lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.operators.sizes import small

from .prefix import running


def fetch(entries: DataFrame, start: int, budget: int, by: tuple[str, ...] = ("range_id",)) -> DataFrame:
    """Entries from ``start`` on in id order: at least one, none that would exceed the budget after the first, none once it is reached."""
    rows = entries.filter(F.col("entry_id") >= start)
    rows = running(rows, list(by), "entry_id", {"_cum": F.col("payload_bytes"), "_rn": F.lit(1)})
    fits = (F.col("_cum") <= budget) & (F.col("_cum") - F.col("payload_bytes") < budget)
    return rows.filter((F.col("_rn") == 1) | fits).drop("_cum", "_rn")


def fetch_summary(fetched: DataFrame, by: tuple[str, ...] = ("range_id",)) -> DataFrame:
    """Records, bytes and the next entry id of a fetch."""
    return fetched.groupBy(*by).agg(
        F.sum("record_count").cast("long").alias("records"),
        F.sum("payload_bytes").cast("long").alias("bytes"),
        (F.max("entry_id") + 1).alias("next_entry_id"),
    )


def hot_scan(entries: DataFrame, segments: DataFrame, start: int) -> DataFrame:
    """Entries of the active segment from ``start`` on."""
    live = segments.filter("state = 'Active'").select("range_id", "segment_id")
    return entries.filter(F.col("entry_id") >= start).join(live, ["range_id", "segment_id"], "left_semi")


def cold_scan(entries: DataFrame, segments: DataFrame, start: int) -> DataFrame:
    """Entries of sealed segments from ``start`` to the segment's end."""
    sealed = segments.filter("state = 'Sealed'").select("range_id", "segment_id", "end_entry_id")
    return entries.filter(F.col("entry_id") >= start).join(sealed, ["range_id", "segment_id"]).filter("entry_id <= end_entry_id").drop("end_entry_id")


def anchors(entries: DataFrame, every: int = 64) -> DataFrame:
    """entries that the sparse index keeps: a segment's first, and each whose id divides by ``every``."""
    first = entries.groupBy("range_id", "segment_id").agg(F.min("entry_id").alias("_first"))
    return entries.join(first, ["range_id", "segment_id"]).filter((F.col("entry_id") == F.col("_first")) | (F.col("entry_id") % every == 0)).drop("_first")


def seek_anchor(anchors: DataFrame, target: int) -> DataFrame:
    """The greatest anchor at or below ``target`` in each range."""
    return anchors.filter(F.col("entry_id") <= target).groupBy("range_id").agg(F.max("entry_id").alias("anchor"))


def seek_absolute(entries: DataFrame, records: DataFrame, offset: int) -> DataFrame:
    """Records at or after an absolute offset; whole entries before it go by their counts, without their records being read."""
    rows = running(entries, ["range_id"], "entry_id", {"_upto": F.col("record_count")})
    rows = rows.filter(F.col("_upto") > offset).select("range_id", "entry_id", (F.col("_upto") - F.col("record_count")).alias("_first"))
    return records.join(rows, ["range_id", "entry_id"]).filter(F.col("_first") + F.col("batch_offset") >= offset).drop("_first")


def resume_after(records: DataFrame, committed: DataFrame) -> DataFrame:
    """Records after each range's committed (entry_id, batch_offset); all records of ranges without one."""
    c = committed.select("range_id", F.struct("entry_id", "batch_offset").alias("_at"))
    return records.join(c, "range_id", "left").filter(F.col("_at").isNull() | (F.struct("entry_id", "batch_offset") > F.col("_at"))).drop("_at")


def roots(ranges: DataFrame) -> DataFrame:
    """P5, earliest: ranges that are nobody's split child and weren't merged from others."""
    children = ranges.select(F.explode("split_into").alias("range_id")).distinct()
    return ranges.filter(F.col("merged_from").isNull() | (F.size("merged_from") == 0)).join(children, "range_id", "left_anti")


def start_positions(ranges: DataFrame, segments: DataFrame, policy: str) -> DataFrame:
    """P5: (range_id, entry_id): Latest: active ranges after their last entry; Earliest: root ranges at the first one retained."""
    kept = segments.filter("state <> 'Deleting'")
    if policy == "latest":
        tail = kept.groupBy("range_id").agg((F.max("last_entry_id") + 1).alias("entry_id"))
        return ranges.filter("state = 'Active'").select("range_id").join(tail, "range_id", "left").select("range_id", F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"))
    head = kept.groupBy("range_id").agg(F.min("start_entry_id").alias("entry_id"))
    return roots(ranges).select("range_id").join(head, "range_id", "left").select("range_id", F.coalesce("entry_id", F.lit(0)).cast("long").alias("entry_id"))


def skip_forward(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Requests (range_id, entry_id) below the first retained entry jump to it."""
    head = segments.filter("state <> 'Deleting'").groupBy("range_id").agg(F.min("start_entry_id").alias("first_retained"))
    return requests.join(head, "range_id", "left").select("range_id", F.greatest("entry_id", F.coalesce("first_retained", F.lit(0))).cast("long").alias("entry_id"))


#: Entries in a block, the second key of the join between requests and segments.
LOOKUP = 1 << 12


def locate(requests: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment for (range_id, entry_id): the active one if it starts at or below, else the sealed one that covers it; an unknown end is open.

    Segments are listed under the blocks of entries that they cover, as far as requests go, so that requests meet only the segments of their block.
    """
    block = F.floor(F.col("entry_id") / LOOKUP)
    far = requests.groupBy(F.col("range_id").alias("_r")).agg(F.max("entry_id").alias("_far"))
    s = segments.filter("state <> 'Deleting'").select(F.col("range_id").alias("_r"), "segment_id", "state", "start_entry_id", F.when(F.col("state") == "Sealed", F.col("end_entry_id")).alias("_end"))
    s = s.join(far, "_r").withColumn("_upto", F.least(F.coalesce("_end", "_far"), F.col("_far"))).filter("start_entry_id <= _upto")
    s = s.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_entry_id") / LOOKUP), F.floor(F.col("_upto") / LOOKUP))))
    rows = requests.withColumn("_own", block)
    hit = (F.col("range_id") == F.col("_r")) & (F.col("_own") == F.col("_block")) & (F.col("start_entry_id") <= F.col("entry_id")) & (F.col("_end").isNull() | (F.col("entry_id") <= F.col("_end")))
    best = F.max_by("segment_id", F.struct((F.col("state") == "Active").cast("int"), "start_entry_id"))
    return rows.join(s, hit, "left").groupBy("range_id", "entry_id").agg(best.alias("segment_id"))


def scan_end(segments: DataFrame) -> DataFrame:
    """(range_id, end_exclusive): the greater of the active segment's next id and the last sealed end + 1; null when empty."""
    nxt = F.max(F.when(F.col("state") == "Active", F.greatest(F.col("last_entry_id") + 1, F.col("start_entry_id"))))
    sealed = F.max(F.when(F.col("state") == "Sealed", F.col("end_entry_id") + 1))
    end = F.greatest(nxt, sealed)
    return segments.groupBy("range_id").agg(F.when(end > 0, end).alias("end_exclusive"))


def list_offsets(segments: DataFrame) -> DataFrame:
    """(range_id, start, next) of the active segment only."""
    return segments.filter("state = 'Active'").select("range_id", F.col("start_entry_id").alias("start"), (F.col("last_entry_id") + 1).alias("next"))


def drained(ranges: DataFrame, positions: DataFrame) -> DataFrame:
    """Ranges that are sealed and whose next position is past their end."""
    return ranges.join(positions, "range_id").filter("state = 'Sealed' and next_entry_id > end_entry_id").select("range_id")


def progress(ranges: DataFrame) -> DataFrame:
    """(range_id, progress, transition): Active, or Sealed with Split, Merged or None."""
    kind = F.when(F.col("state") != "Sealed", None).when(F.col("split_into").isNotNull(), "Split").when(F.col("merged_into").isNotNull(), "Merged").otherwise("None")
    return ranges.select("range_id", F.when(F.col("state") == "Sealed", "Sealed").otherwise("Active").alias("progress"), kind.alias("transition"))


def owned_records(records: DataFrame, assignments: DataFrame, member: str) -> DataFrame:
    """A member's records: those of ranges that it owns and isn't fenced from."""
    own = assignments.filter((F.col("member") == member) & ~F.col("fenced")).select("range_id")
    return records.join(small(own), "range_id", "left_semi")


def unpaused(records: DataFrame, paused: DataFrame) -> DataFrame:
    """Records of ranges that aren't paused."""
    return records.join(paused.select("range_id"), "range_id", "left_anti")


#: Error kinds after which a client asks for the route again.
RETRIABLE = ("ShardNotLocal", "NotRaftLeader", "NotWriteLeader", "TopicMetadataRedirect", "SegmentNotLocal", "StaleRange")


def retriable(errors: DataFrame) -> DataFrame:
    """P15."""
    return errors.withColumn("retriable", F.col("kind").isin(*RETRIABLE))


def newest_batches(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent entries of each range."""
    order = Window.partitionBy("range_id").orderBy(F.desc("entry_id"))
    return entries.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")
