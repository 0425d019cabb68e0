"""The service over a folder: the scenarios of producers and consumers."""

import io

import pytest

from rangeweave import cli
from rangeweave.api import ConsumerConfig, KeyInterest, LogError, ProducerConfig, StoragePolicy, TopicNotFound, connect


def rows(spark, pairs, first=0):
    return spark.createDataFrame([(first + i, bytearray(k), bytearray(v)) for i, (k, v) in enumerate(pairs)], "seq long, key binary, value binary")


def values(df):
    return [bytes(r.value).decode() for r in df.orderBy("range_id", "entry_id", "batch_offset").collect()]


EARLIEST = ConsumerConfig(start="earliest")


def test_topics(spark, tmp_path):
    with pytest.raises(ValueError):
        connect(spark, "")
    log = connect(spark, str(tmp_path))
    assert log.create_topic("t") and not log.create_topic("t")
    with pytest.raises(TopicNotFound):
        log.delete_topic("other")
    log.delete_topic("t")
    with pytest.raises(TopicNotFound):
        log.describe_topic("t")
    assert log.create_topic("t", StoragePolicy(partition_strategy="Fixed"))
    with pytest.raises(LogError):
        log.split_range("t", 0)


def test_earliest_latest_split_seek_pause(spark, tmp_path):
    log = connect(spark, str(tmp_path))
    log.create_topic("t")
    log.append("t", rows(spark, [(b"key-%d" % i, b"val-%d" % i) for i in range(3)]), ProducerConfig(max_records=2))
    assert values(log.read_log("t", config=EARLIEST)) == ["val-0", "val-1", "val-2"] and values(log.read_log("t")) == []
    assert tuple(log.range_offsets("t").first()) == (0, 0, 2)
    log.split_range("t", 0)
    at = log.append("t", rows(spark, [(b"a", b"left"), (b"\x90", b"right")])).orderBy("seq").collect()
    assert [(r.range_id, r.entry_id) for r in at] == [(1, 0), (2, 0)]
    assert values(log.read_log("t", config=EARLIEST)) == ["val-0", "val-1", "val-2", "left", "right"]
    assert values(log.read_log("t", KeyInterest(b"\x90", b"\x95"), EARLIEST)) == ["val-0", "val-1", "val-2", "right"]
    assert values(log.read_log("t", config=ConsumerConfig(start="earliest", paused=(0,), seek={1: 0}))) == ["left", "right"]
    assert values(log.read_log("t", config=ConsumerConfig(seek={0: 1}))) == ["val-1", "val-2"]
    states = {r.range_id: (r.state, r.end_entry_id) for r in log.describe_topic("t").collect()}
    assert states == {0: ("Sealed", 1), 1: ("Active", None), 2: ("Active", None)}


def test_groups(spark, tmp_path):
    log = connect(spark, str(tmp_path))
    log.create_topic("t")
    log.append("t", rows(spark, [(b"k", b"%d" % i) for i in range(5)]), ProducerConfig(max_records=2))
    own = ConsumerConfig(group="g")
    assert len(values(log.read_log("t", config=own))) == 5
    at = spark.createDataFrame([(0, 1, 0)], "range_id long, entry_id long, batch_offset long")
    log.commit_offsets("t", "g", at)
    assert values(log.read_log("t", config=own)) == ["3", "4"]
    log.seal_epoch("t", "g", 2)
    log.commit_offsets("t", "g", spark.createDataFrame([(0, 2, 0)], "range_id long, entry_id long, batch_offset long"), generation=1)
    assert values(log.read_log("t", config=own)) == ["3", "4"]


def test_command_line(spark, tmp_path):
    out = io.StringIO()
    for line in (["create-topic", "t"], ["publish", "t", "k", "v1"], ["publish", "t", "k", "v2"], ["consume", "t", "--start", "earliest", "--count", "1"]):
        cli.run(spark, [str(tmp_path), *line], out)
    assert out.getvalue().splitlines() == ["created", "range 0 entry 0", "range 0 entry 1", "k\tv1"]
