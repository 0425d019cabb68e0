"""Queries: routing, batches, scans, seeks, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import codec, keyspace
from rangeweave.operators import log, routing, scan
from rangeweave.plans import folds
from rangeweave.plans.catalog import query
from rangeweave.sources.fixtures import sql


@query(sql("SELECT range_id, count(*) AS n, min(k) AS first_key FROM routed GROUP BY range_id", "routed"))
def j1_route_counts(t):
    return t.routed.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.lower(F.hex(F.min("key"))).alias("first_key"))


@query(sql("SELECT event_id, range_id, user_id % 4 AS claimed, CASE WHEN range_id = user_id % 4 THEN 'Ok' ELSE 'StaleRange' END AS verdict FROM routed", "routed"))
def j2_writable_check(t):
    requests = t.events.select("event_id", "key", (F.col("user_id") % 4).alias("claimed"))
    return routing.check_writable(requests, t.ranges).select("event_id", "range_id", "claimed", "verdict")


@query(sql("SELECT range_id, segment_id, entry_id, record_count, payload_bytes FROM entries", "entries"))
def a1_batch_entries(t):
    return t.entries.select("range_id", "segment_id", "entry_id", "record_count", "payload_bytes")


@query(sql("SELECT event_id, range_id, entry_id, batch_offset FROM records", "records"))
def s5_produce(t):
    return t.records.select("event_id", "range_id", "entry_id", "batch_offset")


@query(sql("SELECT range_id, entry_id, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM records GROUP BY ALL", "records"))
def a3_regroup_by_range(t):
    return t.records.groupBy("range_id", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


_FETCH = """
, c AS (SELECT *, sum(payload_bytes) OVER w AS cum, row_number() OVER w AS rn FROM entries WHERE entry_id >= 5 WINDOW w AS (PARTITION BY range_id ORDER BY entry_id))
, f AS (SELECT * FROM c WHERE rn = 1 OR (cum <= 2000 AND cum - payload_bytes < 2000))
"""


@query(sql(_FETCH + "SELECT range_id, sum(record_count)::BIGINT AS records, sum(payload_bytes)::BIGINT AS bytes, max(entry_id) + 1 AS next_entry_id FROM f GROUP BY range_id", "entries"))
def p4_fetch_budget(t):
    return scan.fetch_summary(scan.fetch(t.entries, 5, 2000))


@query(sql(_FETCH + "SELECT range_id, entry_id, record_count, payload_bytes, 'Active' AS progress FROM f", "entries"))
def s8_fetch_by_id(t):
    return scan.fetch(t.entries, 5, 2000).select("range_id", "entry_id", "record_count", "payload_bytes", F.lit("Active").alias("progress"))


@query(sql("SELECT e.range_id, e.entry_id FROM entries e JOIN segments s USING (range_id, segment_id) WHERE s.state = 'Active' AND e.entry_id >= 10", "segments"))
def s9_hot_scan(t):
    return scan.hot_scan(t.entries, t.segments, 10).select("range_id", "entry_id")


@query(sql("SELECT e.range_id, e.entry_id FROM entries e JOIN segments s USING (range_id, segment_id) WHERE s.state = 'Sealed' AND e.entry_id BETWEEN 10 AND s.end_entry_id", "segments"))
def s10_cold_scan(t):
    return scan.cold_scan(t.entries, t.segments, 10).select("range_id", "entry_id")


@query(sql("SELECT range_id, max(entry_id) AS anchor FROM (SELECT *, min(entry_id) OVER (PARTITION BY range_id, segment_id) AS f FROM entries) WHERE (entry_id = f OR entry_id % 64 = 0) AND entry_id <= 21 GROUP BY range_id", "entries"))
def f9_sparse_seek(t):
    return scan.seek_anchor(scan.anchors(t.entries), 21)


@query(sql("SELECT event_id, range_id FROM routed JOIN ranges r USING (range_id) WHERE r.lo < '95' AND '90' < r.hi", "routed"))
def p1_keyspan_scan(t):
    return routing.span_scan(t.routed, t.ranges, b"\x90", b"\x95").select("event_id", "range_id")


@query(sql("SELECT event_id FROM ev WHERE k = md5('7')", "ev"))
def p2_key_equality(t):
    return t.events.filter(F.col("key") == F.unhex(F.md5(F.lit("7").cast("binary")))).select("event_id")


@query(sql("SELECT event_id, k AS key_hex FROM ev WHERE k >= '90' AND k < '95'", "ev"))
def p3_record_span_extension(t):
    return t.events.filter((F.col("key") >= F.lit(b"\x90")) & (F.col("key") < F.lit(b"\x95"))).select("event_id", F.lower(F.hex("key")).alias("key_hex"))


@query(sql("SELECT r.range_id FROM history r WHERE r.merged_from IS NULL AND r.range_id NOT IN (SELECT unnest(split_into) FROM history WHERE split_into IS NOT NULL)", "history"))
def p5_earliest_roots(t):
    return scan.roots(t.history).select("range_id")


@query(sql("SELECT range_id, max(last_entry_id) + 1 AS entry_id FROM segments GROUP BY range_id", "segments"))
def p5_latest_positions(t):
    return scan.start_positions(t.ranges, t.segments, "latest")


@query(sql("SELECT r.range_id, r.event_id FROM records r LEFT JOIN (SELECT * FROM committed WHERE group_id = 'g1') c USING (range_id) WHERE c.entry_id IS NULL OR (r.entry_id, r.batch_offset) > (c.entry_id, c.batch_offset)", "committed"))
def p6_resume_after_commit(t):
    from rangeweave.operators import groups

    saved = groups.committed_offsets(t.offset_log).filter("group_id = 'g1'")
    return scan.resume_after(t.records.select("range_id", "event_id", "entry_id", "batch_offset"), saved).select("range_id", "event_id")


@query(sql("SELECT range_id, event_id, absolute_offset FROM records WHERE absolute_offset >= 95", "records"))
def p7_seek_absolute(t):
    records = t.records.select("range_id", "entry_id", "batch_offset", "event_id", "absolute_offset")
    return scan.seek_absolute(t.entries, records, 95).select("range_id", "event_id", "absolute_offset")


@query(sql("SELECT range_id, count(*) AS n FROM records WHERE range_id <> 2 GROUP BY range_id", "records"))
def p8_paused_ranges(t):
    paused = t.spark.createDataFrame([(2,)], "range_id long")
    return scan.unpaused(t.records, paused).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))


_KEPT = "SELECT range_id, min(start_entry_id) AS first_retained FROM segments WHERE segment_id >= 1 GROUP BY range_id"


@query(sql(f"SELECT r.range_id, greatest(r.range_id * 7, coalesce(first_retained, 0)) AS entry_id FROM ranges r LEFT JOIN ({_KEPT}) USING (range_id)", "segments"))
def p9_skip_forward(t):
    kept = t.segments.filter("segment_id >= 1")
    return scan.skip_forward(t.ranges.select("range_id", (F.col("range_id") * 7).alias("entry_id")), kept)


@query(sql("SELECT e.range_id, e.entry_id, max(s.segment_id) AS segment_id FROM entries e JOIN segments s ON e.range_id = s.range_id AND s.start_entry_id <= e.entry_id AND (s.end_entry_id IS NULL OR e.entry_id <= s.end_entry_id) GROUP BY ALL", "segments"))
def p10_segment_for_offset(t):
    return scan.locate(t.entries.select("range_id", "entry_id"), t.segments)


@query(sql("SELECT r.range_id, r.q AS entry_id, s.segment_id FROM (SELECT range_id, range_id * 9 + 3 AS q FROM ranges) r ASOF LEFT JOIN segments s ON r.range_id = s.range_id AND r.q >= s.start_entry_id", "segments"))
def p11_local_resolve(t):
    return scan.locate(t.ranges.select("range_id", (F.col("range_id") * 9 + 3).alias("entry_id")), t.segments)


@query(sql("SELECT range_id, max(last_entry_id) + 1 AS end_exclusive FROM segments GROUP BY range_id", "segments"))
def p12_scan_end(t):
    return scan.scan_end(t.segments)


@query(sql("SELECT event_id, range_id FROM records WHERE range_id IN (0, 2)", "records"))
def p13_owned_records(t):
    own = t.ranges.select("range_id", F.when(F.col("range_id") % 2 == 0, "m0").otherwise("m1").alias("member"), F.lit(False).alias("fenced"))
    return scan.owned_records(t.records, own, "m0").select("event_id", "range_id")


@query(sql("SELECT range_id FROM history WHERE state = 'Sealed' AND range_id + 4 > end_entry_id", "history"))
def p14_drained(t):
    return scan.drained(t.history, t.history.select("range_id", (F.col("range_id") + 4).alias("next_entry_id")))


@query(sql("SELECT event_id, event_type IN ('click', 'view') AS retriable FROM ev", "ev"))
def p15_retriable(t):
    kind = F.when(F.col("event_type") == "click", "StaleRange").when(F.col("event_type") == "view", "NotWriteLeader").otherwise("TopicNotFound")
    return scan.retriable(t.events.select("event_id", kind.alias("kind"))).select("event_id", "retriable")


@query(sql("SELECT range_id, start_entry_id AS start, last_entry_id + 1 AS next FROM segments WHERE state = 'Active'", "segments"))
def s14_list_offsets(t):
    return scan.list_offsets(t.segments)


@query(sql("SELECT range_id, entry_id FROM entries QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY entry_id DESC) <= 16", "entries"))
def o8_recent_results(t):
    return scan.newest_batches(t.entries, 16).select("range_id", "entry_id")


@query(sql("SELECT event_id, range_id, absolute_offset FROM records QUALIFY row_number() OVER (ORDER BY event_id) <= 25", "records"))
def o5_record_limit(t):
    return t.records.orderBy("event_id").limit(25).select("event_id", "range_id", "absolute_offset")


@query(sql("SELECT range_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS events FROM records WHERE entry_id = 0 GROUP BY range_id", "records"))
def o1_batch_order(t):
    rows = t.records.filter("entry_id = 0")
    return rows.groupBy("range_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("events"))


@query(sql("SELECT name, name NOT IN ('click', 'view') AS created FROM (SELECT DISTINCT event_type AS name FROM events) ORDER BY name"))
def s1_create_topic(t):
    catalog = t.spark.createDataFrame([("click",), ("view",)], "name string")
    return log.create_topics(catalog, t.read("events").select(F.col("event_type").alias("name")).distinct())


@query(sql("SELECT range_id, segment_id, CASE WHEN range_id % 2 = 1 THEN 'Deleting' ELSE state END AS state FROM segments", "segments"))
def s2_delete_topic(t):
    topics = t.spark.createDataFrame([(0, "even"), (1, "odd")], "topic_id long, name string")
    parts = t.segments.select((F.col("range_id") % 2).alias("topic_id"), "range_id", "segment_id", "state")
    return log.delete_topics(topics, parts, t.spark.createDataFrame([("odd",)], "name string")).select("range_id", "segment_id", "state")


@query(sql("SELECT range_id, max(CASE WHEN state = 'Active' THEN segment_id END) AS active_segment, string_agg(CASE WHEN state = 'Sealed' THEN segment_id::VARCHAR END, ',' ORDER BY start_entry_id) AS sealed FROM segments GROUP BY range_id", "segments"))
def s3_describe_topic(t):
    rows = log.describe(t.ranges, t.segments).withColumn("sealed", F.array_join(F.transform("sealed", lambda x: x.cast("string")), ","))
    return rows.select("range_id", "active_segment", F.when(F.col("sealed") != "", F.col("sealed")).alias("sealed"))


@query(sql("SELECT range_id % 2 AS topic_id, count(DISTINCT range_id) AS range_count, sum(size_bytes)::BIGINT AS total_bytes FROM segments GROUP BY range_id % 2", "segments"))
def s4_topic_stats(t):
    return log.topic_stats(t.ranges.select("range_id", (F.col("range_id") % 2).alias("topic_id")), t.segments)


@query(sql("SELECT event_type, count(*) AS n, sum(length(props))::BIGINT AS bytes FROM events GROUP BY event_type"))
def s6_send_flush(t):
    return t.read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("bytes"))


@query(sql("SELECT '1/' || range_id || '/' || segment_id || '-' || start_entry_id || '.seg' AS path, 1::BIGINT AS topic_id, range_id, segment_id, start_entry_id FROM segments", "segments"))
def s12_segment_names(t):
    named = t.segments.withColumn("topic_id", F.lit(1)).select(log.segment_name("topic_id", "range_id", "segment_id", "start_entry_id").alias("path"))
    foreign = t.spark.createDataFrame([("1/2/readme.txt",), ("x/1/2-3.seg",)], "path string")
    return log.parse_segment_names(named.union(foreign))


@query(sql("SELECT range_id, entry_id, batch_offset, k AS key_hex, event_type AS value FROM records", "records"))
def s16_codec_round_trip(t):
    rows = t.records.select("range_id", "entry_id", "batch_offset", "key", F.col("event_type").alias("value"))
    back = codec.decoded_records(codec.encoded_entries(rows, codec.ZSTD))
    return back.select("range_id", "entry_id", "batch_offset", F.lower(F.hex("key")).alias("key_hex"), F.col("value").cast("string").alias("value"))


@query(
    sql(
        "SELECT c AS codec, range_id, entry_id, count(*) AS records, string_agg(k || ':' || event_type, ',' ORDER BY batch_offset) AS content FROM records, (VALUES ('None'), ('Lz4'), ('Zstd')) AS v(c) GROUP BY ALL",
        "records",
    )
)
def s17_codecs(t):
    """Every entry packed by each codec and unpacked again."""
    rows = t.records.select("range_id", "entry_id", "batch_offset", "key", F.col("event_type").alias("value"))
    found = None
    for name, tag in (("None", codec.NONE), ("Lz4", codec.LZ4), ("Zstd", codec.ZSTD)):
        back = codec.decoded_records(codec.encoded_entries(rows, tag)).withColumn("codec", F.lit(name))
        found = back if found is None else found.unionByName(back)
    one = F.concat(F.lower(F.hex("key")), F.lit(":"), F.col("value").cast("string"))
    content = F.transform(F.array_sort(F.collect_list(F.struct("batch_offset", one.alias("x")))), lambda r: r["x"])
    return found.groupBy("codec", "range_id", "entry_id").agg(F.count(F.lit(1)).alias("records"), F.array_join(content, ",").alias("content"))


@query(sql("SELECT count(*) AS records, count(DISTINCT range_id) AS ranges FROM records", "records"))
def s15_read_all(t):
    return t.records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("range_id").alias("ranges"))


@query(sql("SELECT * FROM (VALUES ('', 'ff', '7f', true), ('', '7f', '3f', true), ('7f', 'ff', 'bf', true), ('7f', '80', '7f', false), ('7eff', '7fff', '7e7f', false)) AS v(lo, hi, mid, inside)"))
def f1_midpoint(t):
    rows = t.spark.createDataFrame([("", "ff"), ("", "7f"), ("7f", "ff"), ("7f", "80"), ("7eff", "7fff")], "lo string, hi string")
    a, b = F.unhex("lo"), F.unhex("hi")
    mid = keyspace.midpoint(a, b)
    return rows.select("lo", "hi", F.lower(F.hex(mid)).alias("mid"), keyspace.inside(mid, a, b).alias("inside"))


@query("SELECT event_id, " + folds.crc32("hx") + " AS digest, " + folds.crc32("('0000000001' || printf('%08x', length(hx) // 2) || hx)") + " AS frame FROM (SELECT event_id, lower(hex(props)) AS hx FROM events)")
def f5_payload_digest(t):
    return t.events.select("event_id", F.crc32(F.col("props").cast("binary")).alias("digest"), keyspace.frame_crc(F.lit(0), F.lit(1), F.col("props").cast("binary")).alias("frame"))


@query(sql("SELECT event_id, greatest(event_id - user_id * 50, 0) AS less, event_id + user_id AS more FROM ev", "ev"))
def f7_saturating(t):
    return t.events.select("event_id", keyspace.saturating_sub(F.col("event_id"), F.col("user_id") * 50).alias("less"), keyspace.saturating_add(F.col("event_id"), F.col("user_id")).alias("more"))


@query(sql("SELECT a.range_id AS left_id, b.range_id AS right_id, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM ranges a JOIN ranges b ON a.hi = b.lo", "ranges"))
def f8_merged_spans(t):
    r = t.ranges
    a = r.select(F.col("range_id").alias("left_id"), F.col("keyspace_start").alias("s1"), F.col("keyspace_end").alias("e1"))
    b = r.select(F.col("range_id").alias("right_id"), F.col("keyspace_start").alias("s2"), F.col("keyspace_end").alias("e2"))
    span = keyspace.merged_span(*[F.col(c) for c in ("s1", "e1", "s2", "e2")])
    return a.join(b, F.col("e1") == F.col("s2")).select("left_id", "right_id", F.lower(F.hex(span["keyspace_start"])).alias("lo"), F.lower(F.hex(span["keyspace_end"])).alias("hi"))


@query(sql(_FETCH + "SELECT range_id, sum(payload_bytes)::BIGINT AS bytes, max(entry_id) + 1 AS next_entry_id, 'Active' AS progress FROM f GROUP BY range_id", "entries"))
def s7_fetch_by_name(t):
    got = scan.fetch_summary(scan.fetch(t.entries, 5, 2000)).drop("records")
    return got.join(scan.progress(t.ranges).select("range_id", "progress"), "range_id")


@query(sql("SELECT range_id, segment_id, count(*) AS entries, sum(record_count)::BIGINT AS records, sum(payload_bytes)::BIGINT AS bytes, min(entry_id) AS first_entry, max(entry_id) AS last_entry FROM entries GROUP BY range_id, segment_id", "entries"))
def s11_all_segment_files(t):
    """Every segment of every range, written and read back."""
    from rangeweave.sources.scratch import folder

    path = folder(t.spark, "segments")
    log.write_segments(t.entries.select("range_id", "segment_id", "entry_id", "record_count", "payload_bytes"), path)
    back = t.spark.read.schema("entry_id long, record_count long, payload_bytes long, range_id long, segment_id long").parquet(path)
    total = lambda k, name: F.sum(k).alias(name)
    return back.groupBy("range_id", "segment_id").agg(
        F.count(F.lit(1)).alias("entries"), total("record_count", "records"), total("payload_bytes", "bytes"), F.min("entry_id").alias("first_entry"), F.max("entry_id").alias("last_entry")
    )


@query(sql("SELECT event_id, k AS key_hex, event_type AS value FROM records WHERE range_id <> 1 AND absolute_offset < 40", "records"))
def s19_consume_command(t):
    """What ``consume --start earliest --count`` and ``--pause`` show, for each range."""
    rows = scan.unpaused(t.records, t.spark.createDataFrame([(1,)], "range_id long"))
    return rows.filter("absolute_offset < 40").select("event_id", F.lower(F.hex("key")).alias("key_hex"), F.col("event_type").alias("value"))
