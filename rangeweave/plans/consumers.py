"""Queries: offsets, groups, lineage, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.operators import groups, lifecycle, lineage, recovery, scan
from rangeweave.plans import folds
from rangeweave.plans.catalog import query
from rangeweave.sources.fixtures import sql


@query(sql("SELECT group_id, range_id, entry_id, batch_offset FROM committed", "committed"))
def a6_committed_offsets(t):
    return groups.committed_offsets(t.offset_log)


@query(sql(", o AS (SELECT group_id, range_id, max(generation) AS generation, max(entry_id * 1000 + batch_offset) AS p FROM offset_log GROUP BY ALL) SELECT group_id, range_id, generation, p // 1000 AS entry_id, p % 1000 AS batch_offset FROM o", "offset_log"))
def a7_bootstrap_merge(t):
    columns = ["group_id", "range_id", "generation", "entry_id", "batch_offset"]
    a, b = t.offset_log.filter("lsn % 2 = 0"), t.offset_log.filter("lsn % 2 = 1")
    return groups.bootstrap(a.select(*columns), b.select(*columns))


_T4 = "SELECT *, max(CASE WHEN kind = 'Seal' THEN generation END) OVER (PARTITION BY group_id, range_id ORDER BY lsn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM epochs"


@query(
    sql(
        "SELECT e.lsn, e.group_id, e.range_id, e.generation, CASE WHEN e.generation < e.epoch THEN 'StaleEpoch' WHEN e.generation = e.epoch THEN 'Staged' WHEN EXISTS (SELECT 1 FROM offset_log s WHERE s.kind = 'Seal' AND s.group_id = e.group_id AND s.range_id = e.range_id AND s.lsn > e.lsn AND s.generation = e.generation) THEN 'ParkedThenStaged' ELSE 'Parked' END AS verdict FROM epochs e WHERE e.kind = 'Commit'",
        "epochs",
    )
)
def t4_commit_verdicts(t):
    return groups.commit_verdicts(t.offset_log)


_T5 = ", g AS (SELECT group_id, range_id, coalesce(max(CASE WHEN kind = 'Seal' THEN generation END), 0) AS generation FROM offset_log GROUP BY ALL)"


@query(sql(_T5 + "SELECT g.group_id, g.range_id, CASE WHEN generation = 9 THEN 'Ok' ELSE 'GenerationMismatch' END AS verdict, generation, CASE WHEN generation = 9 THEN entry_id END AS entry_id, CASE WHEN generation = 9 THEN batch_offset END AS batch_offset FROM g LEFT JOIN committed c USING (group_id, range_id)", "committed"))
def t5_offset_read(t):
    return groups.read_offset(t.offset_log, 9)


@query(sql("SELECT r.range_id, coalesce(c.entry_id, 0) AS entry_id, coalesce(c.batch_offset, -1) AS after_offset FROM history r LEFT JOIN committed c ON r.range_id = c.range_id AND c.group_id = 'g1'", "committed", "history"))
def j9_start_positions(t):
    return groups.start_positions(t.history, groups.committed_offsets(t.offset_log).filter("group_id = 'g1'"))


@query(sql("SELECT group_id, c.range_id, e.e - c.entry_id AS entries_behind FROM committed c JOIN (SELECT range_id, max(entry_id) AS e FROM entries GROUP BY range_id) e USING (range_id)", "committed", "entries"))
def consumer_lag_extension(t):
    return groups.lag(groups.committed_offsets(t.offset_log), scan.scan_end(t.segments))


@query(sql("SELECT group_id, range_id, max(entry_id) AS entry_id FROM epochs WHERE kind = 'Commit' AND generation = epoch GROUP BY ALL", "epochs"))
def s20_offset_rpc(t):
    return groups.committed_offsets(t.offset_log).select("group_id", "range_id", "entry_id")


_T6 = """
, l AS (SELECT event_id AS seq, range_id, CASE event_id % 4 WHEN 0 THEN 'Ack' WHEN 1 THEN 'Commit' ELSE 'Deliver' END AS kind, CASE WHEN event_id % 4 = 0 THEN absolute_offset + event_id % 7 - 3 WHEN event_id % 4 = 1 THEN NULL ELSE absolute_offset END AS pos FROM records)
, d AS (SELECT *, max(CASE WHEN kind = 'Deliver' THEN pos END) OVER (PARTITION BY range_id ORDER BY seq) AS delivered FROM l)
, a AS (SELECT *, kind = 'Ack' AND (delivered IS NULL OR pos > delivered) AS refused FROM d)
, k AS (SELECT *, max(CASE WHEN kind = 'Ack' AND NOT refused THEN pos END) OVER (PARTITION BY range_id ORDER BY seq) AS committable FROM a)
, o AS (SELECT *, max(CASE WHEN kind = 'Commit' THEN committable END) OVER (PARTITION BY range_id ORDER BY seq) AS committed, max(CASE WHEN kind = 'Commit' THEN committable END) OVER (PARTITION BY range_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM k)
SELECT seq, range_id, kind, pos, delivered, committable, committed, CASE WHEN refused AND delivered IS NULL THEN 'NotDelivered' WHEN refused THEN 'AheadOfDelivered' WHEN kind = 'Commit' AND (committable IS NULL OR committable <= old) THEN 'NothingToCommit' ELSE 'Ok' END AS verdict FROM o
"""


@query(sql(_T6, "records"))
def t6_delivery_tracking(t):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "Ack").when(e % 4 == 1, "Commit").otherwise("Deliver")
    pos = F.when(e % 4 == 0, F.col("absolute_offset") + e % 7 - 3).when(e % 4 != 1, F.col("absolute_offset"))
    return groups.tracked(t.records.select(e.alias("seq"), "range_id", kind.alias("kind"), pos.alias("pos")))


_MEMBERS = "SELECT DISTINCT 'g' || user_id % 3 AS group_id, 'm' || user_id % 7 AS member FROM ev WHERE user_id % 5 < 3"


@query(sql(f", m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS n FROM ({_MEMBERS})) SELECT m.group_id, r.range_id, m.member FROM m JOIN ranges r ON r.range_id % m.n = m.i", "ev", "ranges"))
def t9_group_assignment(t):
    m = t.events.filter("user_id % 5 < 3").select(F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_id"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("member")).distinct()
    return groups.assigned(m, t.ranges)


@query(sql("SELECT user_id AS member, s AS session, min(at_ms) AS joined_ms, max(at_ms) + 43200000 AS expires_ms, count(*) AS heartbeats FROM (SELECT *, sum((coalesce(at_ms - p, 43200001) > 43200000)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS s FROM (SELECT *, lag(at_ms) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ev)) GROUP BY user_id, s", "ev"))
def t15_heartbeat_sessions(t):
    return groups.expired_members(t.events.select(F.col("user_id").alias("member"), "at_ms"), 43200000)


@query(sql("SELECT range_id, 'm' || (range_id + 1) % 2 AS member, 'Granted' AS change FROM ranges WHERE range_id >= 2 UNION ALL SELECT range_id, 'm' || range_id % 2, 'Revoked' FROM ranges WHERE range_id >= 2", "ranges"))
def t11_ownership_change(t):
    name = lambda k: F.concat(F.lit("m"), (k % 2).cast("string")).alias("member")
    r = F.col("range_id")
    return groups.moved(t.ranges.select("range_id", name(r)), t.ranges.select("range_id", name(F.when(r >= 2, r + 1).otherwise(r))))


@query(sql("SELECT range_id, CASE WHEN state = 'Sealed' THEN 'Sealed' ELSE 'Active' END AS progress, CASE WHEN state <> 'Sealed' THEN NULL WHEN split_into IS NOT NULL THEN 'Split' WHEN merged_into IS NOT NULL THEN 'Merged' ELSE 'None' END AS transition FROM history", "history"))
def t14_progress(t):
    return scan.progress(t.history)


_WALK = "walk(ancestor, descendant, distance) AS (SELECT parent, child, 1 FROM edges UNION ALL SELECT w.ancestor, e.child, w.distance + 1 FROM walk w JOIN edges e ON w.descendant = e.parent)"


@query(sql("SELECT ancestor, descendant, max(distance)::BIGINT AS distance FROM walk GROUP BY ALL", "edges", recursive=_WALK))
def j10_lineage_closure(t):
    return lineage.closure(lineage.edges(t.history))


@query(sql("SELECT h.range_id, coalesce(max(w.distance), 0)::BIGINT AS depth FROM history h LEFT JOIN walk w ON h.range_id = w.descendant GROUP BY h.range_id", "edges", recursive=_WALK))
def o4_lineage_depth(t):
    return lineage.depths(t.history)


_OWN = "own(member, range_id) AS (SELECT * FROM (VALUES ('a', 3), ('b', 7), ('c', 6)) UNION SELECT o.member, e.parent FROM own o JOIN edges e ON e.child = o.range_id AND e.delegate)"


def _assigned(t):
    return t.spark.createDataFrame([("a", 3), ("b", 7), ("c", 6)], "member string, range_id long")


@query(sql("SELECT member, range_id::BIGINT AS range_id FROM own", "edges", recursive=_OWN))
def t10_effective_ownership(t):
    return lineage.effective(t.history, _assigned(t))


@query(sql("SELECT DISTINCT range_id::BIGINT AS range_id FROM (SELECT 7 AS range_id UNION ALL SELECT ancestor FROM walk WHERE descendant = 7)", "edges", recursive=_WALK))
def t11_checkpoint_lookups(t):
    return lineage.checkpoint_lookups(t.history, t.spark.createDataFrame([(7,)], "range_id long"))


_SAVED = ", saved AS (SELECT * FROM (VALUES (0, 10), (1, 6), (2, 0), (4, 2)) AS v(range_id, next_entry_id))"
_BLOCK = (
    _SAVED
    + ", st AS (SELECT h.range_id, h.state, h.end_entry_id, coalesce(s.next_entry_id, 0) AS nxt, h.range_id IN (6) AS runs FROM history h LEFT JOIN saved s USING (range_id))"
    + ", un AS (SELECT range_id FROM st WHERE state = 'Active' OR runs OR (state = 'Sealed' AND nxt <= end_entry_id))"
    + ", bad AS (SELECT ancestor AS range_id FROM walk WHERE descendant IN (6) UNION SELECT descendant FROM walk WHERE ancestor IN (SELECT range_id FROM un) UNION SELECT range_id FROM st WHERE state = 'Sealed' AND nxt > end_entry_id)"
)


def _saved(t):
    return t.spark.createDataFrame([(0, 10), (1, 6), (2, 0), (4, 2)], "range_id long, next_entry_id long")


@query(sql(_BLOCK + "SELECT range_id FROM history WHERE range_id NOT IN (SELECT range_id FROM bad)", "edges", recursive=_WALK))
def t12_start_gating(t):
    running = t.spark.createDataFrame([(6,)], "range_id long")
    return lineage.startable(t.history, t.history.select("range_id"), _saved(t), running)


@query(sql(_BLOCK + ", dp AS (SELECT h.range_id, coalesce(max(w.distance), 0)::BIGINT AS depth FROM history h LEFT JOIN walk w ON h.range_id = w.descendant GROUP BY h.range_id) SELECT o.member, o.range_id::BIGINT AS range_id, dp.depth FROM own o JOIN dp USING (range_id) WHERE o.range_id NOT IN (SELECT range_id FROM bad)", "edges", recursive=_WALK + ",\n" + _OWN))
def t11_rebalance_plan(t):
    running = t.spark.createDataFrame([(6,)], "range_id long")
    return lineage.rebalance(t.history, _assigned(t), _saved(t), running)


@query(sql("SELECT * FROM (VALUES (3::BIGINT, 0::BIGINT), (4, 0)) AS v(range_id, starts_at)"))
def t13_transitions(t):
    drained = t.spark.createDataFrame([(1, True), (4, True), (5, False)], "range_id long, drained boolean")
    return lineage.transitions(t.history, drained)


@query(sql(", g AS (SELECT * FROM frames f WHERE NOT EXISTS (SELECT 1 FROM frames b WHERE b.file = f.file AND NOT b.ok AND b.lsn <= f.lsn)), l AS (SELECT file, max(lsn) AS l FROM g WHERE kind = 'BatchEnd' GROUP BY file) SELECT file, count(*) AS n, max(lsn) AS last_lsn FROM g JOIN l USING (file) WHERE kind = 'Data' AND lsn < l GROUP BY file", "frames"))
def t19_verified_prefix(t):
    rows = recovery.verified_prefix(t.frames)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("last_lsn"))


@query(sql("SELECT range_id, entry_id FROM entries WHERE range_id = 3 OR entry_id > range_id * 10", "entries"))
def t18_replay(t):
    cursors = t.ranges.filter("range_id < 3").select("range_id", (F.col("range_id") * 10).alias("entry_id"))
    return recovery.replay(t.entries.select("range_id", "entry_id"), cursors)


@query(sql(", i AS (SELECT range_id, entry_id, row_number() OVER (PARTITION BY range_id ORDER BY entry_id) - 1 AS rn FROM entries WHERE entry_id % 23 <> 19 AND entry_id >= 4), r AS (SELECT range_id, max(entry_id) AS reached FROM i WHERE entry_id = 4 + rn GROUP BY range_id), e AS (SELECT range_id, max(entry_id) AS e FROM entries GROUP BY range_id) SELECT e.range_id, coalesce(reached, 3) AS reached, coalesce(reached, 3) >= e AS complete FROM e LEFT JOIN r USING (range_id)", "entries"))
def t20_catch_up(t):
    have = t.ranges.select("range_id", F.lit(4).cast("long").alias("next_entry_id"))
    end = t.entries.groupBy("range_id").agg(F.max("entry_id").alias("end_entry_id"))
    return recovery.catch_up(t.entries.filter("entry_id % 23 <> 19"), have, end)


@query(sql("SELECT 'n0' AS node_id, range_id, segment_id FROM segments WHERE state <> 'Sealed' AND range_id <> 1", "segments"))
def j11_orphans(t):
    recovered = t.segments.select(F.lit("n0").alias("node_id"), "range_id", "segment_id")
    return recovery.orphans(recovered, t.segments, t.segments.filter("range_id = 1"))


_WAL = """
, mark AS (SELECT least(min(m), (SELECT max(event_id) FROM records)) AS w FROM (
  SELECT r.range_id, max(r.event_id) AS m FROM records r JOIN segments s ON s.range_id = r.range_id AND s.segment_id = r.segment_id WHERE s.state = 'Sealed' GROUP BY r.range_id))
, file AS (SELECT log_id, file, count(*) AS frames, sum(b)::BIGINT AS bytes, min(lsn) AS first_lsn, max(lsn) AS max_lsn FROM fold WHERE i > 0 GROUP BY ALL)
SELECT file.*, bytes >= 4096 AND coalesce(max_lsn <= coalesce(w, (SELECT max(event_id) FROM records)), false) AS reclaimed FROM file, mark
"""


@query(sql(_WAL, "records", "segments", recursive=folds.wal(1 << 12)))
def s13_wal_files(t):
    """All records framed, a log for each range; sealed segments are checkpointed up to their last record."""
    frames = t.records.select(F.col("range_id").alias("log_id"), F.col("event_id").alias("lsn"), F.length("props").alias("payload_bytes"))
    sealed = t.segments.filter("state = 'Sealed'").select("range_id", "segment_id")
    marks = t.records.join(sealed, ["range_id", "segment_id"]).groupBy("range_id").agg(F.max("event_id").alias("checkpoint_lsn"))
    durable = t.records.agg(F.max("event_id")).first()[0]
    return lifecycle.wal_files(frames, lifecycle.reclaim_watermark(marks, durable or 0, None), 1 << 12)


@query(sql("SELECT range_id, lo AS keyspace_start FROM ranges", "ranges"))
def o3_active_ranges_sorted(t):
    return t.ranges.filter("state = 'Active'").orderBy("keyspace_start").select("range_id", F.lower(F.hex("keyspace_start")).alias("keyspace_start"))


def _deliveries(t):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "Ack").when(e % 4 == 1, "Commit").otherwise("Deliver")
    pos = F.when(e % 4 == 0, F.col("absolute_offset") - 3).when(e % 4 != 1, F.col("absolute_offset"))
    return t.records.select(e.alias("seq"), "range_id", kind.alias("kind"), pos.alias("pos"))


_T7 = """
, d AS (SELECT range_id, event_id AS seq, event_id % 4 AS k, absolute_offset AS o FROM records
), r AS (SELECT *, max(CASE WHEN k >= 2 THEN o END) OVER w AS delivered FROM d WINDOW w AS (PARTITION BY range_id ORDER BY seq)
), a AS (SELECT *, max(CASE WHEN k = 0 AND o - 3 <= delivered THEN o - 3 END) OVER w AS acked FROM r WINDOW w AS (PARTITION BY range_id ORDER BY seq)
), e AS (
  SELECT range_id, 'AtLeastOnce' AS semantic, max(delivered) AS delivered, max(CASE WHEN k = 1 THEN acked END) AS committed FROM a GROUP BY range_id
  UNION ALL SELECT range_id, 'AtMostOnce', max(delivered), max(CASE WHEN k = 1 THEN delivered END) FROM a GROUP BY range_id)
SELECT range_id, semantic, delivered, committed, delivered - coalesce(committed, -1) AS again FROM e
"""


@query(sql(_T7, "records"))
def t7_delivery_semantics(t):
    """What has been committed, and what a restart reads again, under both semantics."""
    both = [groups.delivered_by(_deliveries(t), s).withColumn("semantic", F.lit(s)) for s in ("AtLeastOnce", "AtMostOnce")]
    return both[0].unionByName(both[1])


@query(
    sql(
        ", k AS (SELECT range_id, (at_ms // 3600000 + 1) * 3600000 AS at_ms, max(absolute_offset - event_id % 9) AS pos FROM records GROUP BY ALL), c AS (SELECT *, max(pos) OVER (PARTITION BY range_id ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM k) SELECT range_id, at_ms, pos FROM c WHERE was IS NULL OR pos > was",
        "records",
    )
)
def t8_auto_commits(t):
    rows = t.records.select("range_id", "at_ms", (F.col("absolute_offset") - F.col("event_id") % 9).alias("pos"))
    return groups.auto_commits(rows, 3600000)


@query(sql("SELECT 'm' || user_id % 7 AS member, at_ms, greatest(ceil((at_ms - 1704067200000) / 1000.0)::BIGINT * 1000 + 1704067200000, 1704067202000) AS taken_ms FROM ev", "ev"))
def t8_rebalance_ticks(t):
    changes = t.events.select(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("member"), "at_ms")
    return groups.rebalances(changes, 1704067200000)
