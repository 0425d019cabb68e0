"""The same folds over streams: state lives in the state store, one handler for each key.

Micro-batches don't order rows within a key, so handlers sort by arrival; across batches the order is
the source's. Time comes from rows and watermarks, never from the clock.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rangeweave.operators.dedup import COLUMNS, VERDICTS, Gate


def read_topic(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The live tail of a topic kept as files; ``files_per_trigger`` bounds a micro-batch (A4)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class DedupGate(StatefulProcessor):
    """T1 by (range, producer); the gate's state is one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gate = Gate(json.loads(self.gate.get()[0]) if self.gate.exists() else None)
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        for _, _, seq, *rest in frame[COLUMNS].itertuples(index=False, name=None):
            out.append(gate.offer(*(x.item() if hasattr(x, "item") else x for x in rest), int(seq)))
        self.gate.update((json.dumps(gate.state),))
        yield pd.DataFrame({"range_id": frame.range_id, "producer_id": frame.producer_id, "seq": frame.seq, "verdict": [v for v, _ in out], "number": pd.array([n for _, n in out], "Int64")})

    def close(self) -> None:
        pass


def verdicts(appends: DataFrame) -> DataFrame:
    """T1 over a stream of appends. Needs the RocksDB state store."""
    return appends.select(*COLUMNS).groupBy("range_id", "producer_id").transformWithStateInPandas(
        statefulProcessor=DedupGate(), outputStructType=VERDICTS, outputMode="Append", timeMode="None"
    )


class EntryNumbers(StatefulProcessor):
    """A1: gapless record numbers of each range, from which entry ids follow by count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.next.get()[0] if self.next.exists() else 0
        frame = pd.concat(list(rows)).sort_values("seq")
        self.next.update((start + len(frame),))
        yield pd.DataFrame({"range_id": frame.range_id, "seq": frame.seq, "absolute_offset": range(start, start + len(frame))})

    def close(self) -> None:
        pass


def numbered(records: DataFrame) -> DataFrame:
    return records.select("range_id", "seq").groupBy("range_id").transformWithStateInPandas(
        statefulProcessor=EntryNumbers(), outputStructType="range_id long, seq long, absolute_offset long", outputMode="Append", timeMode="None"
    )


#: A silent node is suspected after this long, and dead after that much more.
SUSPECT_MS, DEAD_MS = 900, 5000


class FailureDetector(StatefulProcessor):
    """Alive, then Suspect, then Dead as event time passes without a heartbeat; a higher incarnation refutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.node = handle.getValueState("node", T.StructType([T.StructField("state", T.StringType()), T.StructField("incarnation", T.LongType()), T.StructField("seen", T.LongType())]))

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, incarnation, seen = self.node.get() if self.node.exists() else ("Alive", 0, 0)
        frame, out = pd.concat(list(rows)).sort_values("at_ms"), []
        for at, i in zip(frame.at_ms.tolist(), frame.incarnation.tolist(), strict=True):
            if state == "Alive" or i > incarnation:
                if state != "Alive":
                    out.append(("Alive", i, at))
                state, incarnation, seen = "Alive", max(i, incarnation), max(at, seen)
        self.node.update((state, incarnation, seen))
        if state == "Alive":
            self._timer(seen + SUSPECT_MS)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["node_id", "state", "incarnation", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, incarnation, seen = self.node.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if state == "Alive" and at >= seen + SUSPECT_MS:
            state = "Suspect"
            self._timer(at + DEAD_MS)
        elif state == "Suspect":
            state = "Dead"
        else:
            return
        self.node.update((state, incarnation, seen))
        yield pd.DataFrame([(key[0], state, incarnation, at)], columns=["node_id", "state", "incarnation", "at_ms"])

    def close(self) -> None:
        pass


def failures(heartbeats: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """T16 over heartbeats (node_id, incarnation, ts timestamp)."""
    rows = heartbeats.withWatermark("ts", delay).select("node_id", "incarnation", "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("node_id").transformWithStateInPandas(
        statefulProcessor=FailureDetector(), outputStructType="node_id string, state string, incarnation long, at_ms long", outputMode="Append", timeMode="EventTime"
    )


def windowed_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: event-time windows with late data dropped after ``delay``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, commit_first: bool = False, on_commit=None):
    """A sink that appends each micro-batch once, in a folder of its own that a retry overwrites.

    ``on_commit`` (batch id) runs after the write (at least once) or, with ``commit_first``, before it (at most once).
    """

    def write(batch: DataFrame, number: int) -> None:
        if commit_first and on_commit:
            on_commit(number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if not commit_first and on_commit:
            on_commit(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
