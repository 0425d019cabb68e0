"""Key-range routing: which range owns a key, which ranges a key span meets, which addresses serve them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.operators.sizes import small


def lead_bytes(key: Column) -> Column:
    """The first two bytes of a key as 0..65535; missing bytes count as zero."""
    return F.conv(F.hex(F.substring(F.concat(key, F.lit(b"\0\0")), 1, 2)), 16, 10).cast("int")


def tiles(ranges: DataFrame) -> DataFrame:
    """(range_id, lo, hi, lead): active ranges by start with their successor's start, once for each key lead they can own.

    At most 65,536 rows and one for each range: the size that routing broadcasts.
    """
    order = Window.orderBy("keyspace_start")
    active = ranges.filter("state = 'Active'").select(
        "range_id", F.col("keyspace_start").alias("lo"), F.lead("keyspace_start").over(order).alias("hi")
    )
    last = F.when(F.col("hi").isNull(), 65535).otherwise(lead_bytes(F.col("hi")))
    return active.withColumn("lead", F.explode(F.sequence(lead_bytes(F.col("lo")), last)))


def route(records: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """Adds range_id of the active range with the greatest start <= key; the end bound is ignored, keys below all starts get null.

    An equality join on the key's first two bytes, so it stays a hash join however many ranges there are.
    """
    t = tiles(ranges.drop("key"))
    at = F.col(key)
    hit = (lead_bytes(at) == t["lead"]) & (t["lo"] <= at) & (t["hi"].isNull() | (at < t["hi"]))
    return records.join(small(t), hit, "left").select(*[records[c] for c in records.columns], t["range_id"])


def check_writable(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requests (key, claimed) get verdict Ok, StaleRange, or NoRange."""
    found = route(requests, ranges)
    return found.withColumn(
        "verdict",
        F.when(F.col("range_id").isNull(), "NoRange").when(F.col("range_id") == F.col("claimed"), "Ok").otherwise("StaleRange"),
    )


def overlapping(ranges: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Ranges that a half-open key span meets; all ranges without a span. Records are not filtered."""
    if start is None or end is None:
        return ranges
    return ranges.filter((F.col("keyspace_start") < F.lit(end)) & (F.lit(start) < F.col("keyspace_end")))


def span_scan(records: DataFrame, ranges: DataFrame, start: bytes, end: bytes) -> DataFrame:
    """P1 on records: every record of an overlapping range, also those outside the span."""
    return records.join(small(overlapping(ranges, start, end).select("range_id")), "range_id", "left_semi")


def replica_addresses(segments: DataFrame, members: DataFrame) -> DataFrame:
    """(range_id, segment_id, addresses) in replica order; replicas without a known address are dropped."""
    each = segments.select("range_id", "segment_id", F.posexplode("replicas").alias("pos", "node_id"))
    known = each.join(members.select("node_id", "address"), "node_id")
    return known.groupBy("range_id", "segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "address"))), lambda x: x["address"]).alias("addresses")
    )
