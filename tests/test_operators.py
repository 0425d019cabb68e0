"""Cases with literals: order-dependent folds, codecs, plans."""

import random
import zlib

import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rangeweave.functions import codec, keyspace
from rangeweave.functions.ring import murmur3
from rangeweave.operators import dedup, groups, lifecycle, log, membership, prefix, recovery, routing, scan
from rangeweave.schemas import APPENDS, RANGES, ROLLS


def appends(spark, cases):
    """(incarnation, sequence, digest[, verified]) in arrival order of one producer."""
    rows = [(i, 0, "p", c[0], c[1], c[2], 1000, i, c[3] if len(c) > 3 else True) for i, c in enumerate(cases)]
    found = dedup.verdicts(spark.createDataFrame(rows, APPENDS)).orderBy("seq").collect()
    return [(r.verdict, r.number) for r in found]


def test_dedup_gate(spark):
    got = appends(spark, [(0, 0, 7), (0, 0, 7), (0, 0, 9), (0, 2, 1), (0, 1, 8), (1, 5, 1), (1, 0, 3), (0, 2, 1), (2, 0, 1, False)])
    assert got == [
        ("Ok", 0), ("Duplicate", 0), ("RequestIdentityConflict", None), ("SequenceGap", 1), ("Ok", 4),
        ("SequenceGap", 0), ("Ok", 6), ("ProducerFenced", None), ("SessionNotInstalled", None),
    ]


def test_dedup_window_overflow(spark):
    got = appends(spark, [(0, s, s) for s in range(17)] + [(0, 0, 0), (0, 1, 1)])
    assert got[17] == ("DuplicatePositionUnavailable", None) and got[18] == ("Duplicate", 1)


def test_expired_append(spark):
    row = [(0, 0, "p", 0, 0, 1, 5, 6, True)]
    assert dedup.verdicts(spark.createDataFrame(row, APPENDS)).first().verdict == "SessionExpired"


def test_sessions(spark):
    rows = [("p", 0, "a", 0), ("p", 1, "a", 20), ("p", 2, "b", 21), ("p", 3, "c", 222)]
    found = dedup.sessions(spark.createDataFrame(rows, "producer_id string, seq long, nonce string, observed_at long"), 100)
    assert [tuple(r)[2:] for r in found.orderBy("seq").collect()] == [(0, 100), (0, 120), (1, 121), (0, 322)]


def test_membership_epochs(spark):
    rows = [("g", 0, "a", "Heartbeat", 1), ("g", 1, "a", "Heartbeat", 2), ("g", 2, "b", "Heartbeat", 3), ("g", 3, "b", "Heartbeat", 20)]
    commands = spark.createDataFrame(rows, "group_id string, seq long, member string, action string, at long").withColumn("ranges", F.array(F.lit(0)))
    found = groups.membership(commands, 10)
    assert [(r.generation, r.members) for r in found.orderBy("seq").collect()] == [(1, "a"), (1, "a"), (2, "a,b"), (3, "b")]


def test_byte_batches(spark):
    rows = [(0, i, n, i) for i, n in enumerate([10, 10, 50, 1, 1, 1])]
    found = log.batched_by_bytes(spark.createDataFrame(rows, "range_id long, seq long, nbytes long, at_ms long"), 60, 3)
    assert [r.batch for r in found.orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]
    found = log.batched_by_bytes(spark.createDataFrame([(0, i, 1, t) for i, t in enumerate([0, 5, 11, 12, 30])], "range_id long, seq long, nbytes long, at_ms long"), 10**6, 10**6, 10)
    assert [r.batch for r in found.orderBy("seq").collect()] == [0, 0, 1, 1, 2]


def test_streak_splits_after_three(spark):
    rows = [(0, i, k) for i, k in enumerate(["DataPressure", "Recovery", "DataPressure", "DataPressure", "DataPressure", "IdleMaintenance"])]
    found = lifecycle.pressure_streak(spark.createDataFrame(rows, ROLLS)).orderBy("seq")
    assert [r.streak for r in found.collect()] == [1, 1, 2, 3, 3, 0]


def test_midpoint_and_split_point(spark):
    rows = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in [(b"", b"\xff"), (b"\x7f", b"\x80"), (b"\x7e\xff", b"\x7f\xff")]], "a binary, b binary")
    mid = keyspace.midpoint(F.col("a"), F.col("b"))
    got = [(bytes(r[0]), r[1]) for r in rows.select(mid, keyspace.inside(mid, F.col("a"), F.col("b"))).collect()]
    assert got == [(b"\x7f", True), (b"\x7f", False), (b"\x7e\x7f", False)]


def test_split_then_route(spark):
    whole = spark.createDataFrame([(0, bytearray(b""), bytearray(b"\xff"), "Active", None, None, None, None)], RANGES)
    loads = spark.createDataFrame([(0, 3)], "range_id long, streak long")
    after = lifecycle.split(whole, lifecycle.split_candidates(whole, loads))
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"\x90"),), (bytearray(b""),), (bytearray(b"\x7f"),), (bytearray(b"\xff\xff"),)], "key binary")
    assert [r.range_id for r in routing.route(keys, after).orderBy("key").collect()] == [1, 1, 2, 2, 2]
    span = routing.overlapping(after.filter("state = 'Active'"), b"\x90", b"\x95")
    assert [r.range_id for r in span.collect()] == [2]


def test_merge_of_idle_children(spark):
    rows = [(1, bytearray(b""), bytearray(b"\x7f"), "Active", None, None, None, None), (2, bytearray(b"\x7f"), bytearray(b"\xff"), "Active", None, None, None, None)]
    loads = spark.createDataFrame([(1, "Idle"), (2, "Idle")], "range_id long, load string")
    assert tuple(lifecycle.merge_candidate(spark.createDataFrame(rows, RANGES), loads).first())[:2] == (1, 2)


def test_routing_is_a_hash_join(spark):
    rows = spark.createDataFrame([(0, bytearray(b""), bytearray(b"\xff"), "Active", None, None, None, None)], RANGES)
    plan = routing.route(spark.createDataFrame([(bytearray(b"a"),)], "key binary"), rows)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_running_sums_over_blocks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    found = prefix.running(rows, ["k"], "o", {"n": F.lit(1), "s": F.col("o")}, block=64).orderBy("o").collect()
    for k in range(3):
        mine = [r for r in found if r.k == k]
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.s for r in mine] == [sum(x.o for x in mine[: i + 1]) for i in range(len(mine))]


def test_budget_always_takes_one(spark):
    rows = spark.createDataFrame([(0, i, 1, n) for i, n in enumerate([500, 0, 10])], "range_id long, entry_id long, record_count long, payload_bytes long")
    assert [r.entry_id for r in scan.fetch(rows, 0, 100).collect()] == [0]
    assert sorted(r.entry_id for r in scan.fetch(rows, 1, 100).collect()) == [1, 2]
    assert scan.fetch(rows, 9, 100).count() == 0


def test_earliest_after_retention(spark):
    rows = [(0, 0, "Sealed", 0, 0, 5, 9), (0, 1, "Active", 1, None, None, 3)]
    segments = spark.createDataFrame(rows, "range_id long, segment_id long, state string, start_entry_id long, end_entry_id long, sealed_at_ms long, last_entry_id long")
    gone = lifecycle.retention_prefix(segments, 100, 0)
    left = lifecycle.delete_segments(segments, gone)
    start = scan.skip_forward(spark.createDataFrame([(0, 0)], "range_id long, entry_id long"), left)
    assert start.first().entry_id == 1


def test_scan_end_of_an_empty_tail(spark):
    rows = [(0, 0, "Sealed", 0, 0, 0), (0, 1, "Active", 1, None, 0)]
    segments = spark.createDataFrame(rows, "range_id long, segment_id long, state string, start_entry_id long, end_entry_id long, last_entry_id long")
    assert scan.scan_end(segments).first().end_exclusive == 1


def test_boundary_and_recency(spark):
    rows = spark.createDataFrame([(0, 0, "n1", 5), (0, 0, "n2", 7), (0, 0, "n0", 7), (1, 0, "n1", 3), (1, 0, "n2", None)], "range_id long, segment_id long, node_id string, extent long")
    assert {r.range_id: r.boundary for r in membership.durable_boundary(rows).collect()} == {0: 5, 1: None}
    assert {r.range_id: r.leader for r in membership.recency_leader(rows).collect()} == {0: "n0", 1: "n1"}


def test_codec():
    records = [(b"k", b"only-once"), (b"", b""), (b"\xff" * 300, b"v")]
    for tag in (codec.NONE, codec.LZ4, codec.ZSTD):
        assert codec.decode(codec.encode(records, tag), 3) == records
        assert codec.decode(codec.encode([], tag), 0) == []
    packed = codec.encode(records, codec.LZ4)
    assert packed[0] == 1 and int.from_bytes(packed[1:5], "little") == len(codec.encode(records)) - 1
    assert codec.encode([(b"k", b"v")]) == b"\0\0\0\0\1k\0\0\0\1v"
    with pytest.raises(ValueError):
        codec.decode(b"", 0)
    with pytest.raises(ValueError):
        codec.decode(b"\x07", 0)
    with pytest.raises(ValueError):
        codec.decode(codec.encode(records)[:-1], 3)
    for broken in (packed[:3], packed[:5] + b"\xff" * 9):
        with pytest.raises(ValueError):
            codec.decode(broken, 3)


def test_murmur3():
    known = {b"": 0, b"a": 0x3C2569B2, b"abc": 0xB3DD93FA, b"hello": 0x248BFA47, b"hello, world": 0x149BBB7F}
    assert dict(zip(known, murmur3(list(known)).tolist())) == known


def test_frame_crc(spark):
    want = zlib.crc32(b"\x01" + (3).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"hello")
    assert spark.range(1).select(keyspace.frame_crc(F.lit(1), F.lit(3), F.lit(b"hello"))).first()[0] == want


def test_torn_tail(spark):
    rows = [(0, 0, "Data", True), (0, 1, "BatchEnd", True), (0, 2, "Data", True), (1, 0, "Data", False), (1, 1, "BatchEnd", True)]
    found = recovery.verified_prefix(spark.createDataFrame(rows, "file long, lsn long, kind string, ok boolean"))
    assert [(r.file, r.lsn) for r in found.collect()] == [(0, 0)]


def test_wal_files_rotate_and_go(spark):
    rows = [(0, lsn, 33) for lsn in (1, 1, 2, 3, 4, 5)] + [(1, 7, 83), (2, 1, 10)]  # with their headers 50 bytes each, 100, 27
    mark = lambda n: spark.createDataFrame([(n,)], "watermark long")
    frames = spark.createDataFrame(rows, "log_id long, lsn long, payload_bytes long")
    found = lifecycle.wal_files(frames, mark(7), 100).orderBy("log_id", "file").collect()
    assert [tuple(r) for r in found] == [(0, 0, 2, 100, 1, 1, True), (0, 1, 2, 100, 2, 3, True), (0, 2, 2, 100, 4, 5, True), (1, 0, 1, 100, 7, 7, True), (2, 0, 1, 27, 1, 1, False)]
    found = lifecycle.wal_files(frames, mark(3), 100).filter("reclaimed").orderBy("file").collect()
    assert [(r.log_id, r.file) for r in found] == [(0, 0), (0, 1)]


def test_wal_files_of_the_whole_log(spark):
    from rangeweave.plans import catalog
    from rangeweave.sources.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    records, state = t.records.orderBy("event_id").collect(), {(s.range_id, s.segment_id): s.state for s in t.segments.collect()}
    last, files = {}, {}
    for r in records:
        if state[r.range_id, r.segment_id] == "Sealed":
            last[r.range_id] = r.event_id
        logs = files.setdefault(r.range_id, [[0, 0, None, None]])
        if logs[-1][1] >= 1 << 12:
            logs.append([0, 0, None, None])
        now = logs[-1]
        now[:] = [now[0] + 1, now[1] + len(r.props) + 17, r.event_id if now[2] is None else now[2], r.event_id]
    mark = min(last.values())
    want = {(k, i, *f, f[1] >= 1 << 12 and f[3] <= mark) for k, logs in files.items() for i, f in enumerate(logs)}
    got = [tuple(r) for r in catalog.queries()["s13_wal_files"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(want) and set(got) == want and sum(g[2] for g in got) == len(records)
    assert len({g[6] for g in got}) == 2


def test_segments_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(r, s, e, 1) for r in range(2) for s in range(2) for e in range(s * 4, s * 4 + 4)], "range_id long, segment_id long, entry_id long, record_count long")
    log.write_segments(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.filter("range_id = 1 and entry_id >= 4").count() == 4
    assert "PartitionFilters: [isnotnull(range_id" in back.filter("range_id = 1")._jdf.queryExecution().toString()


def test_segment_files_without_folders_of_their_own(spark, tmp_path):
    """A file for each segment, whole and in order, however batches cut it; folders for ranges only; writes add up; no range, no rows."""
    top = tmp_path / "a log"
    rows = [(r, s, e, f"{r}/{e}") for r in (0, 1, None) for s in range(20) for e in range(s * 7, s * 7 + 7)]
    schema = "range_id long, segment_id long, entry_id long, note string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        log.write_segments(spark.createDataFrame(rows[::-1], schema), str(top))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {p.name for p in top.rglob("*") if p.is_dir()} == {"range_id=0", "range_id=1", f"range_id={log.NO_RANGE}"}
    files = [p for p in top.rglob("*") if p.is_file()]
    assert sorted(p.name.split("-")[:2] for p in files) == sorted([str(s), str(s * 7)] for s in range(20) for _ in range(3))
    for p in files:
        found = pq.ParquetFile(p).read().to_pydict()
        assert set(found["segment_id"]) == {int(p.name.split("-")[0])} and found["entry_id"] == list(range(found["entry_id"][0], found["entry_id"][0] + 7))
    read = lambda: spark.read.schema(schema).parquet(str(top)).select("range_id", "segment_id", "entry_id", "note")
    assert sorted(map(tuple, read().collect()), key=repr) == sorted(rows, key=repr)
    log.write_segments(spark.createDataFrame(rows[:5], schema), str(top))
    assert sorted(map(tuple, read().collect()), key=repr) == sorted(rows + rows[:5], key=repr)
    log.write_segments(spark.createDataFrame([], schema), str(tmp_path / "empty"))
    assert spark.read.schema(schema).parquet(str(tmp_path / "empty")).count() == 0


def test_segment_files_where_arrow_cannot_write(spark, tmp_path, monkeypatch):
    rows = [(r, s, e, f"{r}/{e}") for r in range(2) for s in range(3) for e in range(s * 4, s * 4 + 4)]
    schema = "range_id long, segment_id long, entry_id long, note string"

    class Unknown:
        from_uri = staticmethod(lambda uri: pafs.FileSystem.from_uri("nowhere://a/b"))

    monkeypatch.setattr(log, "pafs", type("Stores", (), {"FileSystem": Unknown}))
    log.write_segments(spark.createDataFrame(rows, schema), str(tmp_path / "log"))
    back = spark.read.schema(schema).parquet(str(tmp_path / "log")).select("range_id", "segment_id", "entry_id", "note")
    assert sorted(map(tuple, back.collect())) == rows


def test_owners_by_brute_force(spark):
    """Few tokens, equal hashes, an excluded node, more owners wanted than there are nodes; no pairs of anchors and tokens."""
    rng = random.Random(2)
    tokens = [(rng.randrange(2**32), f"n{rng.randrange(6)}") for _ in range(60)]
    tokens += [(tokens[0][0], "n5"), (tokens[1][0], "n0"), (7, "n6"), (7, "n1")]
    ring = spark.createDataFrame(tokens, "hash long, node_id string")
    anchors = ring.select(F.col("hash").alias("group_id"))
    for n, gone in ((3, None), (9, None), (2, "n1")):
        excluded = None if gone is None else spark.createDataFrame([(gone,)], "node_id string")
        found = membership.owners(anchors, ring, n, excluded)
        got = {(r.group_id, r.pos): r.node_id for r in found.collect()}
        want = {}
        for a, _ in tokens:
            near = {}
            for h, node in tokens:
                if node != gone:
                    near[node] = min(near.get(node, 2**32), (h - a) % 2**32)
            for pos, node in enumerate(sorted(near, key=lambda x: (near[x], x))[:n]):
                want[a, pos] = node
        assert got == want
        assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_parked_commits_of_one_key(spark):
    """Thousands of commits of one key: no frame holds the whole key for each row."""
    rows = [(i, "Seal" if i % 100 == 0 else "Commit", "g", 0, i // 100 + (1 if i % 7 == 0 else 0) - (1 if i % 11 == 0 else 0)) for i in range(6000)]
    log_ = spark.createDataFrame(rows, "lsn long, kind string, group_id string, range_id long, generation long")
    got = {r.lsn: r.verdict for r in groups.commit_verdicts(log_).collect()}
    epoch, seals = 0, {}
    for lsn, kind, _, _, g in rows:
        if kind == "Seal":
            seals[g] = lsn
    for lsn, kind, _, _, g in rows:
        if kind == "Seal":
            epoch = max(epoch, g)
        else:
            assert got[lsn] == ("StaleEpoch" if g < epoch else "Staged" if g == epoch else "ParkedThenStaged" if seals.get(g, -1) > lsn else "Parked")


def test_lookup_joins_on_blocks(spark):
    segments = spark.createDataFrame([(0, 0, "Sealed", 0, 9000), (0, 1, "Sealed", 9001, None), (0, 2, "Active", 20000, None), (1, 0, "Active", 5, None)], "range_id long, segment_id long, state string, start_entry_id long, end_entry_id long")
    asked = spark.createDataFrame([(0, 0), (0, 4096), (0, 9000), (0, 9001), (0, 19999), (0, 20000), (0, 99999), (1, 4), (1, 70000), (2, 1)], "range_id long, entry_id long")
    found = {(r.range_id, r.entry_id): r.segment_id for r in scan.locate(asked, segments).collect()}
    assert found == {(0, 0): 0, (0, 4096): 0, (0, 9000): 0, (0, 9001): 1, (0, 19999): 1, (0, 20000): 2, (0, 99999): 2, (1, 4): None, (1, 70000): 0, (2, 1): None}


def test_groups_learn_of_ranges(spark):
    rows = [(1, "a", "Heartbeat", 1, [0, 1]), (2, "a", "Heartbeat", 2, [0, 1]), (3, "a", "Heartbeat", 3, [0, 2, 3]), (4, "a", "Leave", 4, [0, 2, 3]), (5, "b", "Leave", 5, [0, 2, 3]), (6, "b", "Leave", 6, [])]
    commands = spark.createDataFrame([("g", s, m, a, t, r) for s, m, a, t, r in rows], "group_id string, seq long, member string, action string, at long, ranges array<long>")
    got = {r.seq: (r.generation, r.members, r.ranges) for r in groups.membership(commands, 100).collect()}
    assert got == {1: (1, "a", "0,1"), 2: (1, "a", "0,1"), 3: (2, "a", "0,2,3"), 4: (3, "", ""), 5: (4, "", ""), 6: (4, "", "")}


def test_semantics(spark):
    rows = [(1, 0, "Deliver", 5), (2, 0, "Ack", 4), (3, 0, "Deliver", 6), (4, 0, "Commit", None), (5, 0, "Deliver", 9)]
    log_ = spark.createDataFrame(rows, "seq long, range_id long, kind string, pos long")
    got = {s: groups.delivered_by(log_, s).first() for s in ("AtLeastOnce", "AtMostOnce")}
    assert (got["AtLeastOnce"].committed, got["AtLeastOnce"].again) == (4, 5) and (got["AtMostOnce"].committed, got["AtMostOnce"].again) == (6, 3)
    with pytest.raises(ValueError):
        groups.delivered_by(log_, "Twice")
