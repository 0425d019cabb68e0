"""Building the log: batches, entries, segments, files, and the views that describe topics."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import numbered

#: Bytes that a record adds to a batch besides its key and value.
RECORD_OVERHEAD = 8


def batched(records: DataFrame, size: int, order: str = "event_id", segment_entries: int = 8) -> DataFrame:
    """A1 by count: adds gapless entry_id, batch_offset, absolute_offset and segment_id for each range."""
    rows = numbered(records, ["range_id"], order, "absolute_offset")
    return rows.withColumns(
        {
            "entry_id": F.floor(F.col("absolute_offset") / size),
            "batch_offset": F.col("absolute_offset") % size,
            "segment_id": F.floor(F.floor(F.col("absolute_offset") / size) / segment_entries),
        }
    )


def entries(records: DataFrame, payload: str = "props") -> DataFrame:
    """One row for each batch of :func:`batched`: record count and payload bytes."""
    return records.groupBy("range_id", "segment_id", "entry_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(F.length(payload)).cast("long").alias("payload_bytes"),
        F.max("ts").alias("last_ts"),
    )


def batched_by_bytes(records: DataFrame, max_bytes: int, max_records: int, linger_ms: int | None = None) -> DataFrame:
    """A1/A2: (range_id, seq, batch): a batch closes once its bytes or its records reach the cap, or ``linger_ms`` after its first record.

    ``records``: range_id, seq, nbytes (key and value), at_ms. The sum starts anew at each batch, which no
    window expresses: each range is folded once in order, over Arrow batches sorted by the cluster, with three numbers of state.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, size, count, first = None, 0, 0, 0, 0
        for frame in frames:
            out = []
            for r, n, t in zip(frame.range_id.tolist(), frame.nbytes.tolist(), frame.at_ms.tolist(), strict=True):
                if r != now:
                    now, batch, size, count = r, 0, 0, 0
                if count and linger_ms is not None and t - first >= linger_ms:
                    batch, size, count = batch + 1, 0, 0
                if not count:
                    first = t
                out.append(batch)
                size, count = size + RECORD_OVERHEAD + n, count + 1
                if size >= max_bytes or count >= max_records:
                    batch, size, count = batch + 1, 0, 0
            yield pd.DataFrame({"range_id": frame.range_id, "seq": frame.seq, "batch": out})

    rows = records.select("range_id", "seq", "nbytes", "at_ms")
    return rows.repartition("range_id").sortWithinPartitions("range_id", "seq").mapInPandas(fold, "range_id long, seq long, batch long")


def segments(entries: DataFrame) -> DataFrame:
    """Segments of each range: the newest is Active without an end, the others are Sealed at their last entry's time."""
    found = entries.groupBy("range_id", "segment_id").agg(
        F.min("entry_id").alias("start_entry_id"),
        F.max("entry_id").alias("last_entry_id"),
        F.sum("payload_bytes").cast("long").alias("size_bytes"),
        F.unix_millis(F.max("last_ts").cast("timestamp")).alias("last_ms"),
    )
    newest = found.groupBy("range_id").agg(F.max("segment_id").alias("newest"))
    active = F.col("segment_id") == F.col("newest")
    return found.join(newest, "range_id").select(
        "range_id",
        "segment_id",
        F.when(active, "Active").otherwise("Sealed").alias("state"),
        "start_entry_id",
        F.when(~active, F.col("last_entry_id")).alias("end_entry_id"),
        F.when(~active, F.col("last_ms")).alias("sealed_at_ms"),
        "size_bytes",
        "last_entry_id",
    )


def create_topics(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, created): false where the name exists."""
    there = catalog.select(F.col("name").alias("_n")).distinct()
    return wanted.join(there, wanted["name"] == F.col("_n"), "left").select("name", F.col("_n").isNull().alias("created"))


def delete_topics(topics: DataFrame, parts: DataFrame, gone: DataFrame) -> DataFrame:
    """Parts (topic_id, ..., state) with state Deleting where the topic is among ``gone`` (name)."""
    ids = topics.join(gone, "name", "left_semi").select("topic_id", F.lit(True).alias("_gone"))
    return parts.join(ids, "topic_id", "left").withColumn("state", F.when(F.col("_gone"), "Deleting").otherwise(F.col("state"))).drop("_gone")


def describe(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """S3/O2: each range with its active segment and its sealed ones by start."""
    sealed = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("state") == "Sealed", F.struct("start_entry_id", "segment_id")))), lambda s: s["segment_id"]
    )
    own = segments.groupBy("range_id").agg(F.max(F.when(F.col("state") == "Active", F.col("segment_id"))).alias("active_segment"), sealed.alias("sealed"))
    return ranges.join(own, "range_id", "left")


def topic_stats(ranges: DataFrame, segments: DataFrame) -> DataFrame:
    """(topic_id, range_count, total_bytes); bytes are real ones."""
    size = segments.groupBy("range_id").agg(F.sum("size_bytes").alias("size_bytes"))
    joined = ranges.join(size, "range_id", "left")
    return joined.groupBy("topic_id").agg(F.count(F.lit(1)).alias("range_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))


def segment_name(topic: str, range_: str, segment: str, start: str):
    """topic/range/segment-start.seg."""
    return F.concat(F.col(topic), F.lit("/"), F.col(range_), F.lit("/"), F.col(segment), F.lit("-"), F.col(start), F.lit(".seg"))


def parse_segment_names(files: DataFrame, path: str = "path") -> DataFrame:
    """S12, inverse: names that aren't segment files are skipped."""
    form = r"^([0-9]+)/([0-9]+)/([0-9]+)-([0-9]+)\.seg$"
    part = lambda k: F.regexp_extract(path, form, k).cast("long")
    return files.filter(F.col(path).rlike(form)).select(
        path, part(1).alias("topic_id"), part(2).alias("range_id"), part(3).alias("segment_id"), part(4).alias("start_entry_id")
    )


#: Spark's name for the folder of a null.
NO_RANGE = "__HIVE_DEFAULT_PARTITION__"


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((range_id, segment_id), rows of it without range_id): each batch cut where the segment changes."""
    for batch in batches:
        rows, at = batch.drop_columns(["range_id"]), 0
        for key, run in itertools.groupby(zip(batch["range_id"].to_pylist(), batch["segment_id"].to_pylist(), strict=True)):
            n = sum(1 for _ in run)
            yield key, rows.slice(at, n)
            at += n


def write_segments(entries: DataFrame, path: str) -> None:
    """Adds a Parquet file for each segment, sorted by entry, to the folder of its range: ``range_id=R/SEGMENT-START-WRITE.parquet``.

    Segments are many and may be small, so what each of them costs is what counts: one folder for each range keeps listings few,
    Arrow writes a small file in a fraction of the time that Spark's writer takes, and the tasks' number is fixed, since Spark
    would join small partitions into one task for all files. A file shows once it is whole; a task that runs again replaces its
    own. In stores that Arrow can't open Spark writes, to a folder for each segment; reads find the same rows.
    """
    spark, write = entries.sparkSession, uuid.uuid4().hex
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.repartition(tasks, "range_id", "segment_id").sortWithinPartitions("range_id", "segment_id", "entry_id")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    try:
        fs, top = pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        rows.write.mode("append").partitionBy("range_id", "segment_id").parquet(path)
        return
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        attempt, made, files = TaskContext.get().taskAttemptId(), set(), 0
        for (range_id, segment_id), pieces in itertools.groupby(_by_segment(batches), lambda x: x[0]):
            _, first = next(pieces)
            folder = f"{top}/range_id={NO_RANGE if range_id is None else range_id}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            name = f"{segment_id}-{first['entry_id'][0]}-{write}.parquet"
            part, whole = f"{folder}/_{name}.{attempt}", f"{folder}/{name}"
            with fs.open_output_stream(part) as file, pq.ParquetWriter(file, first.schema) as out:
                for batch in itertools.chain([first], (b for _, b in pieces)):
                    out.write_batch(batch)
            try:
                fs.move(part, whole)
            except OSError:  # where a rename doesn't replace
                fs.delete_file(whole)
                fs.move(part, whole)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()
