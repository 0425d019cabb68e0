"""The log as a service over a folder: topics, producers, consumers.

State is a set of append-only Parquet tables below one path: ``topics`` and ``ranges`` hold versioned rows of
which the newest counts, ``records`` is partitioned by topic and range, ``offsets`` is the commit log of
groups. One writer at a time changes a topic; any number read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeweave.operators import groups, lifecycle, routing, scan
from rangeweave.operators.prefix import numbered
from rangeweave.schemas import RANGES, TOPICS


class LogError(Exception):
    """Base of the errors that callers may tell apart."""


class TopicNotFound(LogError):
    pass


class RangeNotFound(LogError):
    pass


@dataclass(frozen=True)
class StoragePolicy:
    retention_ms: int | None = None
    replication_factor: int = 3
    partition_strategy: str = "AutoSplit"

    def __post_init__(self):
        if self.partition_strategy not in ("AutoSplit", "Fixed"):
            raise ValueError(f"unknown partition strategy {self.partition_strategy}")


@dataclass(frozen=True)
class ProducerConfig:
    max_records: int = 1000


@dataclass(frozen=True)
class KeyInterest:
    """All keys, or those of the ranges that a half-open span meets."""

    start: bytes | None = None
    end: bytes | None = None


@dataclass(frozen=True)
class ConsumerConfig:
    start: str = "latest"
    group: str | None = None
    paused: tuple[int, ...] = ()
    seek: dict[int, int] = field(default_factory=dict)


RECORDS = "seq long, key binary, value binary, range_id long, entry_id long, batch_offset long, absolute_offset long, topic_id long"
OFFSETS = "topic_id long, group_id string, range_id long, kind string, lsn long, generation long, entry_id long, batch_offset long"


def connect(spark: SparkSession, path: str) -> Log:
    """A handle on the log below ``path``; nothing is read yet."""
    if not path:
        raise ValueError("a path is needed")
    return Log(spark, path.rstrip("/"))


class Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, table: str, schema: str) -> DataFrame:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _append(self, table: str, rows: DataFrame, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.path}/{table}")

    def _newest(self, table: str, schema: str, *key: str) -> DataFrame:
        rows = self._read(table, schema + ", version long")
        order = Window.partitionBy(*key).orderBy(F.desc("version"))
        return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "version")

    def _version(self, table: str, schema: str) -> int:
        return (self._read(table, schema + ", version long").agg(F.max("version")).first()[0] or 0) + 1

    def topics(self) -> DataFrame:
        """Topics that aren't deleted."""
        return self._newest("topics", TOPICS, "topic_id").filter("state <> 'Deleted'")

    def _topic(self, name: str) -> int:
        found = self.topics().filter(F.col("name") == name).first()
        if found is None:
            raise TopicNotFound(name)
        return found.topic_id

    def create_topic(self, name: str, policy: StoragePolicy = StoragePolicy()) -> bool:
        """False if the name exists; else the topic with one range over all keys."""
        if self.topics().filter(F.col("name") == name).count():
            return False
        version = self._version("topics", TOPICS)
        row = (version, name, "Active", policy.retention_ms, policy.replication_factor, policy.partition_strategy, version)
        self._put_ranges(version, self.spark.createDataFrame([(0, bytearray(b""), bytearray(b"\xff"), "Active", None, None, None, None)], RANGES))
        self._append("topics", self.spark.createDataFrame([row], TOPICS + ", version long"))
        return True

    def delete_topic(self, name: str) -> None:
        """The topic and its ranges go; readers no longer find it."""
        topic = self._topic(name)
        row = self.topics().filter(F.col("topic_id") == topic).withColumn("state", F.lit("Deleted"))
        self._append("topics", row.withColumn("version", F.lit(self._version("topics", TOPICS))))
        self._put_ranges(topic, self.ranges(topic).withColumn("state", F.lit("Deleting")))

    def _put_ranges(self, topic: int, rows: DataFrame) -> None:
        schema = "topic_id long, " + RANGES
        self._append("ranges", rows.select(F.lit(topic).cast("long").alias("topic_id"), "*", F.lit(self._version("ranges", schema)).alias("version")))

    def ranges(self, topic: int) -> DataFrame:
        return self._newest("ranges", "topic_id long, " + RANGES, "topic_id", "range_id").filter(F.col("topic_id") == topic).drop("topic_id")

    def describe_topic(self, name: str) -> DataFrame:
        """S3: every range with its bounds, state, lineage and next entry."""
        topic = self._topic(name)
        tail = self._records(topic).groupBy("range_id").agg((F.max("entry_id") + 1).alias("next_entry_id"))
        return self.ranges(topic).join(tail, "range_id", "left").withColumn("next_entry_id", F.coalesce("next_entry_id", F.lit(0).cast("long")))

    def split_range(self, name: str, range_id: int) -> None:
        """At the midpoint of its bounds; a fixed topic, or bounds without a point between, refuse."""
        topic = self._topic(name)
        policy = self.topics().filter(F.col("topic_id") == topic).first()
        ranges = self.ranges(topic)
        loads = self.spark.createDataFrame([(range_id, lifecycle.SPLIT_AFTER)], "range_id long, streak long")
        chosen = lifecycle.split_candidates(ranges, loads, policy.partition_strategy)
        if chosen.isEmpty():
            raise LogError(f"range {range_id} can't be split")
        ends = self._records(topic).groupBy("range_id").agg(F.max("entry_id").alias("_end"))
        after = lifecycle.split(ranges, chosen).join(ends, "range_id", "left")
        after = after.withColumn("end_entry_id", F.when(F.col("state") == "Sealed", F.coalesce("end_entry_id", "_end"))).select(*ranges.columns)
        self._put_ranges(topic, after)

    def _records(self, topic: int) -> DataFrame:
        return self._read("records", RECORDS).filter(F.col("topic_id") == topic)

    def append(self, name: str, records: DataFrame, config: ProducerConfig = ProducerConfig()) -> DataFrame:
        """Writes (seq, key, value) in order of seq, and returns each row's range and entry."""
        topic = self._topic(name)
        routed = routing.route(records.select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), self.ranges(topic))
        rows = numbered(routed, ["range_id"], "seq", "_n")
        tail = self._records(topic).groupBy("range_id").agg((F.max("entry_id") + 1).alias("_entry"), (F.max("absolute_offset") + 1).alias("_offset"))
        rows = rows.join(tail, "range_id", "left").select(
            "seq", "key", "value", "range_id",
            (F.coalesce("_entry", F.lit(0)) + F.floor(F.col("_n") / config.max_records)).alias("entry_id"),
            (F.col("_n") % config.max_records).alias("batch_offset"),
            (F.coalesce("_offset", F.lit(0)) + F.col("_n")).alias("absolute_offset"),
            F.lit(topic).cast("long").alias("topic_id"),
        )
        batch = f"{self.path}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(batch)  # what is returned is what was written, however often it is read
        staged = self.spark.read.schema(rows.schema).parquet(batch)
        self._append("records", staged.repartition("range_id").sortWithinPartitions("range_id", "entry_id", "batch_offset"), "topic_id", "range_id")
        return staged.select("seq", "range_id", "entry_id", "batch_offset")

    def range_offsets(self, name: str) -> DataFrame:
        """(range_id, start, next) of ranges in use."""
        topic = self._topic(name)
        live = self.ranges(topic).filter("state = 'Active'").select("range_id")
        own = self._records(topic).groupBy("range_id").agg(F.min("entry_id").alias("start"), (F.max("entry_id") + 1).alias("next"))
        return live.join(own, "range_id", "left").select("range_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("start", "next")])

    def read_log(self, name: str, interest: KeyInterest = KeyInterest(), config: ConsumerConfig = ConsumerConfig()) -> DataFrame:
        """Records by the start policy (``earliest``, ``latest``) or after the group's commits; ranges outside the interest don't count.

        With a group, as in the modelled system, the interest has no effect. ``seek`` gives absolute offsets by
        range, ``paused`` ranges that give nothing.
        """
        topic = self._topic(name)
        ranges, records = self.ranges(topic), self._records(topic).drop("topic_id")
        if config.group:
            records = scan.resume_after(records, self.committed(name, config.group))
        else:
            records = routing.span_scan(records, ranges, interest.start, interest.end) if interest.start is not None else records
            if config.start == "latest":
                tail = self.range_offsets(name).select("range_id", "next")
                records = records.join(tail, "range_id").filter("entry_id >= next").drop("next")
            elif config.start != "earliest":
                raise ValueError(f"unknown start policy {config.start}")
        for range_id, offset in config.seek.items():
            own = self._records(topic).drop("topic_id").filter((F.col("range_id") == range_id) & (F.col("absolute_offset") >= offset))
            records = records.filter(F.col("range_id") != range_id).unionByName(own)
        return records.filter(~F.col("range_id").isin(*config.paused)) if config.paused else records

    def read_stream(self, name: str) -> DataFrame:
        """S15 as a stream: records of the topic as they are appended."""
        topic = self._topic(name)
        return self.spark.readStream.schema(RECORDS).parquet(f"{self.path}/records").filter(F.col("topic_id") == topic).drop("topic_id")

    def commit_offsets(self, name: str, group: str, positions: DataFrame, generation: int = 0) -> None:
        """(range_id, entry_id, batch_offset) become the group's positions where they are ahead."""
        topic = self._topic(name)
        lsn = (self._read("offsets", OFFSETS).agg(F.max("lsn")).first()[0] or 0) + 1
        rows = positions.select(
            F.lit(topic).cast("long").alias("topic_id"), F.lit(group).alias("group_id"), "range_id", F.lit("Commit").alias("kind"), F.lit(lsn).alias("lsn"),
            F.lit(generation).cast("long").alias("generation"), "entry_id", "batch_offset",
        )
        self._append("offsets", rows)

    def seal_epoch(self, name: str, group: str, generation: int) -> None:
        """A new epoch of a group on all ranges: commits of older ones no longer count (T4)."""
        topic = self._topic(name)
        lsn = (self._read("offsets", OFFSETS).agg(F.max("lsn")).first()[0] or 0) + 1
        rows = self.ranges(topic).select(
            F.lit(topic).cast("long").alias("topic_id"), F.lit(group).alias("group_id"), "range_id", F.lit("Seal").alias("kind"), F.lit(lsn).alias("lsn"),
            F.lit(generation).cast("long").alias("generation"), F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("long").alias("batch_offset"),
        )
        self._append("offsets", rows)

    def committed(self, name: str, group: str) -> DataFrame:
        log = self._read("offsets", OFFSETS).filter((F.col("topic_id") == self._topic(name)) & (F.col("group_id") == group))
        return groups.committed_offsets(log).drop("group_id")
