"""Streams give what the batch operators give, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from rangeweave.operators import dedup
from rangeweave.sources.fixtures import Tables
from rangeweave.streaming import twins

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_files(df, order, path, n=3):
    """``df`` in ``n`` files whose names and times follow ``order``."""
    rows = df.orderBy(order).toPandas()
    step = -(-len(rows) // n)
    import os
    import time

    os.makedirs(path)
    for i in range(n):
        part = rows.iloc[i * step : (i + 1) * step]
        part.to_parquet(f"{path}/{i}.parquet", coerce_timestamps="us")
        t = time.time() - 1000 + i * 10
        os.utime(f"{path}/{i}.parquet", (t, t))
    return df.schema


def finished(stream, spark, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("out")


def test_dedup_twin(spark, tmp_path):
    appends = Tables(spark, DIR).appends
    schema = in_files(appends, "seq", tmp_path / "in")
    got = finished(twins.verdicts(twins.read_topic(spark, str(tmp_path / "in"), schema, 1)), spark, tmp_path)
    key = lambda df: sorted(map(tuple, df.select("range_id", "producer_id", "seq", "verdict", "number").collect()), key=repr)
    assert key(got) == key(dedup.verdicts(appends))


def test_numbering_twin(spark, tmp_path):
    records = Tables(spark, DIR).records.select("range_id", F.col("event_id").alias("seq"), "absolute_offset")
    schema = in_files(records, "seq", tmp_path / "in")
    got = finished(twins.numbered(twins.read_topic(spark, str(tmp_path / "in"), schema, 1)), spark, tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.collect()))


def test_failure_detector(spark, tmp_path):
    ticks = [("n0", 0, t) for t in range(0, 30000, 300)] + [("n1", 0, t) for t in range(0, 3000, 300)]
    df = spark.createDataFrame(ticks, "node_id string, incarnation long, ms long").select("node_id", "incarnation", F.timestamp_millis("ms").alias("ts"))
    schema = in_files(df, "ts", tmp_path / "in", 10)
    got = finished(twins.failures(twins.read_topic(spark, str(tmp_path / "in"), schema, 1)), spark, tmp_path).collect()
    assert [r.state for r in sorted(got, key=lambda r: r.at_ms) if r.node_id == "n1"] == ["Suspect", "Dead"]


def test_sink_appends_once(spark, tmp_path):
    events = Tables(spark, DIR).read("events")
    schema = in_files(events, "event_id", tmp_path / "in")
    seen = []
    q = twins.append_batches(twins.read_topic(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"), on_commit=seen.append)
    q.awaitTermination(120)
    assert seen == [0, 1, 2] and spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_windows(spark, tmp_path):
    events = Tables(spark, DIR).read("events")
    schema = in_files(events, "event_id", tmp_path / "in")
    got = finished(twins.windowed_counts(twins.read_topic(spark, str(tmp_path / "in"), schema, 1)), spark, tmp_path, "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
