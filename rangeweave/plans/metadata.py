"""Queries: life of segments and ranges, membership, placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import keyspace
from rangeweave.functions.ring import murmur3_32
from rangeweave.operators import lifecycle, membership, routing
from rangeweave.plans import folds
from rangeweave.plans.catalog import query
from rangeweave.sources.fixtures import sql

NOW = 1706400000000  # 2024-01-28
DAY = 86400000
_LIVE = "SELECT 'n' || i AS node_id FROM range(5) AS t(i) WHERE i NOT IN (2)"
_STREAK = """
, i AS (SELECT *, sum((intent = 'IdleMaintenance')::INT) OVER (PARTITION BY range_id ORDER BY seq) AS run FROM rolls)
, st AS (SELECT range_id, seq, intent, least(3, sum((intent = 'DataPressure')::INT) OVER (PARTITION BY range_id, run ORDER BY seq))::BIGINT AS streak FROM i)
"""
_LOADS = _STREAK + ", ld AS (SELECT range_id, arg_max(streak, seq) AS streak, CASE WHEN arg_max(streak, seq) > 0 THEN 'Pressure' WHEN bool_or(intent = 'IdleMaintenance') THEN 'Idle' ELSE 'Unclassified' END AS load FROM st GROUP BY range_id)"


def _live(t):
    return t.spark.range(5).filter("id <> 2").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))


def _hex(*names):
    return [F.lower(F.hex(n)).alias(n) for n in names]


@query(sql("SELECT range_id, segment_id FROM (SELECT *, min((state = 'Sealed' AND sealed_at_ms + %d < %d)::INT) OVER (PARTITION BY range_id ORDER BY segment_id) AS ok FROM segments) WHERE ok = 1" % (12 * DAY, NOW), "segments"))
def r5_retention_prefix(t):
    return lifecycle.retention_prefix(t.segments, NOW, 12 * DAY).select("range_id", "segment_id")


@query(sql("SELECT range_id, segment_id, CASE WHEN state = 'Sealed' AND segment_id % 2 = 0 THEN 'Deleting' ELSE state END AS state FROM segments", "segments"))
def r6_delete_segments(t):
    return lifecycle.delete_segments(t.segments, t.segments.filter("segment_id % 2 = 0")).select("range_id", "segment_id", "state")


@query(sql(_STREAK + "SELECT range_id, seq, intent, streak FROM st", "rolls"))
def a17_pressure_streak(t):
    return lifecycle.pressure_streak(t.rolls).select("range_id", "seq", "intent", "streak")


@query(sql(_LOADS + "SELECT range_id, load, streak FROM ld", "rolls"))
def r3_load_state(t):
    return lifecycle.load_state(t.rolls)


@query(sql("SELECT range_id, CASE range_id WHEN 0 THEN '1f' WHEN 1 THEN '5f' WHEN 2 THEN '9f' ELSE 'df' END AS split_point FROM ranges", "ranges"))
def r3_auto_split(t):
    loads = t.ranges.select("range_id", F.lit(3).alias("streak"))
    return lifecycle.split_candidates(t.ranges, loads).select("range_id", F.lower(F.hex("split_point")).alias("split_point"))


@query(sql("SELECT * FROM (VALUES (0, '', '3f', 'Active', NULL), (1, '3f', '7f', 'Sealed', '4,5'), (2, '7f', 'bf', 'Active', NULL), (3, 'bf', 'ff', 'Active', NULL), (4, '3f', '5f', 'Active', NULL), (5, '5f', '7f', 'Active', NULL)) AS v(range_id, keyspace_start, keyspace_end, state, children)"))
def r2_split(t):
    chosen = t.ranges.filter("range_id = 1").select("range_id", F.unhex(F.lit("5f")).alias("split_point"))
    rows = lifecycle.split(t.ranges, chosen)
    children = F.when(F.col("split_into").isNotNull(), F.array_join(F.transform("split_into", lambda x: x.cast("string")), ","))
    return rows.select(F.col("range_id").cast("int").alias("range_id"), *_hex("keyspace_start", "keyspace_end"), "state", children.alias("children"))


@query(sql(", ld AS (SELECT range_id, CASE WHEN range_id = 0 THEN 'Pressure' ELSE 'Idle' END AS load FROM ranges) SELECT a.range_id AS range_id_1, b.range_id AS range_id_2, a.lo AS keyspace_start, b.hi AS keyspace_end FROM ranges a JOIN ranges b ON a.hi = b.lo JOIN ld x ON x.range_id = a.range_id JOIN ld y ON y.range_id = b.range_id WHERE x.load = 'Idle' AND y.load = 'Idle' ORDER BY a.lo LIMIT 1", "ranges"))
def r4_merge_candidate(t):
    loads = t.ranges.select("range_id", F.when(F.col("range_id") == 0, "Pressure").otherwise("Idle").alias("load"))
    return lifecycle.merge_candidate(t.ranges, loads).select("range_id_1", "range_id_2", *_hex("keyspace_start", "keyspace_end"))


@query(sql(", x AS (SELECT *, state = 'Sealed' AND segment_id % 3 = 1 AS lost FROM segments) SELECT range_id, segment_id, coalesce(CASE WHEN lag(lost) OVER w THEN lag(last_entry_id - 1) OVER w + 1 END, start_entry_id) AS start_entry_id, CASE WHEN lost THEN last_entry_id - 1 ELSE end_entry_id END AS end_entry_id FROM x WINDOW w AS (PARTITION BY range_id ORDER BY segment_id)", "segments"))
def r7_boundary_correction(t):
    lost = (F.col("state") == "Sealed") & (F.col("segment_id") % 3 == 1)
    rows = t.segments.withColumn("end_entry_id", F.when(~lost, F.col("end_entry_id")))
    ends = t.segments.filter(lost).select("range_id", "segment_id", (F.col("last_entry_id") - 1).alias("end"))
    return lifecycle.correct_boundaries(rows, ends).select("range_id", "segment_id", "start_entry_id", "end_entry_id")


@query(sql("SELECT range_id, segment_id, state = 'Sealed' AND segment_id % 2 = 1 AS changed, array_to_string(CASE WHEN state = 'Sealed' AND segment_id % 2 = 1 THEN ['n7', 'n8', 'n9'] ELSE replicas END, ',') AS replicas FROM segments", "segments"))
def r8_reassign(t):
    new = F.when(F.col("segment_id") % 2 == 1, F.array(*[F.lit(x) for x in ("n7", "n8", "n9")])).otherwise(F.reverse("replicas"))
    rows = lifecycle.reassign(t.segments, t.segments.select("range_id", "segment_id", new.alias("new_replicas")))
    return rows.select("range_id", "segment_id", "changed", F.array_join("replicas", ",").alias("replicas"))


_DEAD = f", live AS ({_LIVE}), dm AS (SELECT s.*, list_filter(replicas, lambda x: x = 'n2') AS dead FROM segments s WHERE len(list_filter(replicas, lambda x: x = 'n2')) > 0)"


@query(sql(_DEAD + "SELECT range_id, segment_id, state, array_to_string(dead, ',') AS dead FROM dm", "segments"))
def j7_dead_members(t):
    rows = lifecycle.with_dead_members(t.segments, _live(t))
    return rows.select("range_id", "segment_id", "state", F.array_join("dead", ",").alias("dead"))


@query(sql(_DEAD + "SELECT range_id, segment_id, CASE WHEN state = 'Sealed' THEN 'Reassign' WHEN len(dead) = 1 THEN 'BoundaryRecovery' ELSE 'Roll' END AS action FROM dm", "segments"))
def r12_repair_triage(t):
    return lifecycle.triage(lifecycle.with_dead_members(t.segments, _live(t))).select("range_id", "segment_id", "action")


@query(sql(_DEAD + ", c AS (SELECT range_id, segment_id, (SELECT min(node_id) FROM live WHERE NOT list_contains(dm.replicas, node_id)) AS extra, list_filter(replicas, lambda x: x <> 'n2') AS kept FROM dm) SELECT range_id, segment_id, array_to_string(kept, ',') || ',' || extra AS new_replicas FROM c", "segments"))
def r9_replacement_replicas(t):
    rows = lifecycle.replacements(lifecycle.with_dead_members(t.segments, _live(t)), _live(t))
    return rows.select("range_id", "segment_id", F.array_join("new_replicas", ",").alias("new_replicas"))


@query(sql("SELECT range_id, segment_id, array_to_string(list_filter(replicas, lambda x: list_contains(nxt, x)), ',') AS survivors FROM (SELECT *, lead(replicas) OVER (PARTITION BY range_id ORDER BY segment_id) AS nxt FROM segments) WHERE state = 'Sealed' AND segment_id % 2 = 0", "segments"))
def j8_boundary_survivors(t):
    rows = t.segments.withColumn("end_entry_id", F.when(F.col("segment_id") % 2 == 1, F.col("end_entry_id")))
    return lifecycle.boundary_survivors(rows).select("range_id", "segment_id", F.array_join("survivors", ",").alias("survivors"))


@query(sql(", m AS (SELECT range_id, segment_id, size_bytes, replicas[1] AS leader FROM segments WHERE state = 'Active') SELECT range_id, segment_id, CASE WHEN size_bytes >= 600 THEN 'Size' ELSE 'Idle' END AS reason FROM m WHERE leader = 'n1' OR leader = 'n3'", "segments"))
def r13_roll_due(t):
    rows = t.segments.withColumn("last_ms", F.lit(NOW - DAY))
    both = [lifecycle.roll_due(rows, NOW, DAY, 600, leader) for leader in ("n1", "n3")]
    return both[0].unionByName(both[1])


@query(sql("SELECT least(min(start_entry_id * 100 + range_id), 9000, 50)::BIGINT AS watermark FROM segments WHERE segment_id >= 1", "segments"))
def a14_reclaim_watermark(t):
    marks = t.segments.filter("segment_id >= 1").select((F.col("start_entry_id") * 100 + F.col("range_id")).alias("checkpoint_lsn"))
    return lifecycle.reclaim_watermark(marks, 9000, 50)


@query(sql("SELECT range_id, segment_id, size_bytes AS checkpointable_bytes FROM segments WHERE segment_id % 3 <> 0 ORDER BY size_bytes DESC, range_id, segment_id LIMIT 1", "segments"))
def a15_eviction_pick(t):
    rows = t.segments.select("range_id", "segment_id", F.col("size_bytes").alias("checkpointable_bytes"), (F.col("segment_id") % 3 == 0).alias("in_flight"))
    return lifecycle.eviction_pick(rows)


@query(sql("SELECT sum(size_bytes)::BIGINT AS cached, sum(size_bytes) > 90000 AS over FROM segments", "segments"))
def a16_cache_total(t):
    return lifecycle.cache_pressure(t.segments.select(F.col("size_bytes").alias("cached_bytes")), 100000, 0.9)


@query(sql("SELECT g.group_id, r.range_id, 0::BIGINT AS topic_id, 4::BIGINT AS generation FROM (SELECT DISTINCT group_id FROM offset_log) g, ranges r WHERE r.range_id >= 2", "offset_log"))
def r15_epoch_fan_out(t):
    own = t.offset_log.select("group_id").distinct().select(F.lit(0).cast("long").alias("topic_id"), "group_id", F.lit(4).cast("long").alias("generation"))
    return lifecycle.epoch_targets(own, t.ranges.filter("range_id >= 2").select(F.lit(0).cast("long").alias("topic_id"), "range_id"))


@query(sql(", b AS (SELECT node_id, incarnation, max(list_position(['Alive', 'Suspect', 'Dead'], state)) AS s FROM observations GROUP BY ALL) SELECT node_id, incarnation, ['Alive', 'Suspect', 'Dead'][s] AS state FROM b QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY incarnation DESC) = 1", "observations"))
def a8_member_state(t):
    return membership.merged_members(t.observations)


@query(sql("SELECT o.node_id, CASE WHEN max(incarnation) FILTER (WHERE state <> 'Alive') >= 4 THEN max(incarnation) FILTER (WHERE state <> 'Alive') + 1 ELSE 4 END AS incarnation FROM observations o GROUP BY o.node_id", "observations"))
def t17_refutation(t):
    own = t.observations.select("node_id").distinct().withColumn("incarnation", F.lit(4).cast("long"))
    return membership.refuted(own, t.observations)


@query(sql(", b AS (SELECT node_id, incarnation, max(list_position(['Alive', 'Suspect', 'Dead'], state)) AS s FROM observations GROUP BY ALL) SELECT node_id, node_id || ':7000' AS address, ['Alive', 'Suspect', 'Dead'][s] AS state FROM b QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY incarnation DESC) = 1", "observations"))
def s21_describe_cluster(t):
    return membership.cluster(membership.merged_members(t.observations))


@query(sql("SELECT group_id, arg_min(leader, seq) AS leader, any_value(term) AS term FROM (SELECT user_id % 9 AS group_id, event_id AS seq, 'n' || event_id % 5 AS leader, (event_id * 31) % 97 AS term FROM ev QUALIFY term = max(term) OVER (PARTITION BY group_id)) GROUP BY group_id", "ev"))
def a9_leader_merge(t):
    e = F.col("event_id")
    return membership.leaders(t.events.select((F.col("user_id") % 9).alias("group_id"), e.alias("seq"), F.concat(F.lit("n"), (e % 5).cast("string")).alias("leader"), ((e * 31) % 97).alias("term")))


@query(sql("SELECT range_id, segment_id, CASE WHEN count(*) = count(extent) THEN min(extent) END AS boundary FROM reports GROUP BY ALL", "reports"))
def a10_durable_boundary(t):
    return membership.durable_boundary(t.reports)


@query(sql("SELECT range_id, segment_id, node_id AS leader FROM reports QUALIFY row_number() OVER (PARTITION BY range_id, segment_id ORDER BY extent DESC NULLS LAST, node_id) = 1", "reports"))
def a11_recency_leader(t):
    return membership.recency_leader(t.reports)


@query(sql(", f AS (SELECT range_id, entry_id FROM acks GROUP BY ALL HAVING count(DISTINCT node_id) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY entry_id) - 1 AS rn FROM f) SELECT range_id, max(entry_id) AS committed FROM r WHERE rn = entry_id GROUP BY range_id", "acks"))
def a12_replica_commit(t):
    return membership.committed_prefix(t.acks, 3)


@query(sql(", m AS (SELECT range_id AS group_id, segment_id AS node, last_entry_id AS match_index, row_number() OVER (PARTITION BY range_id ORDER BY last_entry_id DESC) AS rn, count(*) OVER (PARTITION BY range_id) // 2 + 1 AS quorum FROM segments) SELECT m.group_id, max(e.entry_id) AS commit_index FROM m JOIN entries e ON e.range_id = m.group_id AND e.entry_id <= m.match_index WHERE rn = quorum AND e.entry_id % 3 = 1 GROUP BY m.group_id", "segments"))
def a13_commit_index(t):
    matches = t.segments.select(F.col("range_id").alias("group_id"), F.col("last_entry_id").alias("match_index"))
    log = t.entries.select(F.col("range_id").alias("group_id"), F.col("entry_id").alias("idx"), (F.col("entry_id") % 3).alias("term"))
    return membership.commit_index(matches, log, 1)


@query(sql("SELECT n, greatest(3, 3 * ceil(log2(n)))::BIGINT AS sends FROM (SELECT DISTINCT user_id AS n FROM ev WHERE user_id > 0)", "ev"))
def a19_dissemination_count(t):
    return t.events.filter("user_id > 0").select(F.col("user_id").alias("n")).distinct().withColumn("sends", keyspace.dissemination_count(F.col("n")))


@query(sql("SELECT node_id, item FROM (SELECT 'n' || user_id % 5 AS node_id, event_id AS item, sum(length(props)) OVER (PARTITION BY user_id % 5 ORDER BY user_id % 13 DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ev) WHERE c <= 1400", "ev"))
def o7_gossip_budget(t):
    items = t.events.select(F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node_id"), F.col("event_id").alias("item"), (F.col("user_id") % 13).alias("remaining"), F.length("props").alias("size"))
    return membership.gossip(items, 1400).select("node_id", "item")


@query(sql("SELECT g AS group_id, 'n' || n AS node_id FROM range(4) AS a(g), range(5) AS b(n) WHERE (g + n) % 3 <> 0"))
def j12_missing_peers(t):
    every = t.spark.range(4).select(F.col("id").alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    name = F.concat(F.lit("n"), F.col("n").cast("string")).alias("node_id")
    return membership.missing_peers(every.select("group_id", name), every.filter((F.col("group_id") + F.col("n")) % 3 == 0).select("group_id", name))


@query(sql("SELECT range_id, segment_id, array_to_string(list_transform(list_filter(replicas, lambda x: x <> 'n2'), lambda x: x || ':7000'), ',') AS addresses FROM segments", "segments"))
def j6_replica_addresses(t):
    known = _live(t).withColumn("address", F.concat("node_id", F.lit(":7000")))
    return routing.replica_addresses(t.segments, known).select("range_id", "segment_id", F.array_join("addresses", ",").alias("addresses"))


def _ring(t):
    nodes = t.spark.range(5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    return membership.ring(nodes, 16)


@query("WITH " + folds.murmur("hashed", "(SELECT DISTINCT user_id FROM events)", "lower(hex(user_id::VARCHAR))") + " SELECT user_id, hash FROM hashed")
def f3_murmur3(t):
    return t.events.select("user_id").distinct().select("user_id", murmur3_32(F.col("user_id").cast("string").cast("binary")).alias("hash"))


@query("WITH " + folds.RING + " SELECT hash, node_id, replica FROM ring")
def f4_ring_tokens(t):
    return _ring(t)


_KEYED = ", " + folds.murmur("keyed", "ev", "k") + ", " + folds.RING + folds.GROUPED


@query(sql(_KEYED + " SELECT event_id, hash AS key_hash, group_id FROM grouped", "ev"))
def j3_shard_groups(t):
    return membership.shard_groups(t.events.select("event_id", "key"), _ring(t)).select("event_id", "key_hash", "group_id")


@query("WITH " + folds.RING + folds.OWNERS.format(where="") + " SELECT group_id, pos, node_id FROM owned")
def j4_ring_owners(t):
    ring = _ring(t)
    return membership.owners(ring.select(F.col("hash").alias("group_id")), ring, 3)


@query("WITH " + folds.RING + folds.OWNERS.format(where=" WHERE node_id <> 'n2'") + " SELECT group_id, pos, node_id FROM owned")
def j5_replacement_nodes(t):
    ring = _ring(t)
    return membership.owners(ring.select(F.col("hash").alias("group_id")), ring, 3, t.spark.createDataFrame([("n2",)], "node_id string"))


@query("WITH " + folds.RING + folds.OWNERS.format(where="") + " SELECT node_id, count(*) AS groups, min(group_id) AS first_group FROM owned GROUP BY node_id")
def r11_ring_reverse_index(t):
    ring = _ring(t)
    rows = membership.owners(ring.select(F.col("hash").alias("group_id")), ring, 3)
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("groups"), F.min("group_id").alias("first_group"))


@query(sql("SELECT range_id, entry_id, segment FROM fold WHERE entry_id >= 0", "entries", recursive=folds.rolls(1500)))
def r1_segment_rolls(t):
    return lifecycle.rolled(t.entries, 1500)


@query(
    "WITH "
    + folds.murmur("keyed", "(SELECT DISTINCT user_id, md5(user_id::VARCHAR) AS k FROM events)", "k")
    + ", "
    + folds.RING
    + folds.GROUPED
    + folds.OWNERS.format(where="")
    + """, member AS (SELECT group_id, string_agg(node_id, ',' ORDER BY pos) AS members FROM owned GROUP BY group_id
), report AS (SELECT group_id, user_id, 'n' || user_id % 5 AS node, user_id % 3 AS term FROM grouped WHERE user_id % 3 > 0
), leader AS (SELECT group_id, arg_min(node, [-term, user_id]) AS leader FROM report GROUP BY group_id)
SELECT user_id, g.group_id, members, leader FROM grouped g JOIN member m ON m.group_id = g.group_id LEFT JOIN leader l ON l.group_id = g.group_id"""
)
def s22_shard_info(t):
    """Members and leader, if known, of the shard group of each key."""
    ring = _ring(t)
    keys = t.events.select("user_id", "key").distinct()
    at = membership.shard_groups(keys, ring)
    members = membership.owners(at, ring, 3).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]), ",").alias("members"))
    reports = at.select("group_id", F.col("user_id").alias("seq"), F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("leader"), (F.col("user_id") % 3).alias("term")).filter("term > 0")
    return at.join(members, "group_id").join(membership.leaders(reports), "group_id", "left").select("user_id", "group_id", "members", "leader")


@query(sql(_DEAD + ", c AS (SELECT range_id, segment_id, len(replicas) - len(dead) AS kept, len(replicas) AS wanted FROM dm) SELECT range_id, segment_id, kept::BIGINT AS kept, (wanted - kept)::BIGINT AS missing FROM c", "segments"))
def r10_under_replicated(t):
    rows = lifecycle.with_dead_members(t.segments, _live(t))
    kept = F.size("replicas") - F.size("dead")
    return rows.select("range_id", "segment_id", kept.cast("long").alias("kept"), F.size("dead").cast("long").alias("missing"))


@query(sql(_DEAD + ", f AS (SELECT range_id, segment_id, (SELECT min(node_id) FROM live WHERE NOT list_contains(dm.replicas, node_id)) AS extra FROM dm) SELECT s.range_id, s.segment_id, array_to_string(CASE WHEN f.extra IS NULL THEN replicas ELSE list_append(list_filter(replicas, lambda x: x <> 'n2'), f.extra) END, ',') AS replicas FROM segments s LEFT JOIN f ON f.range_id = s.range_id AND f.segment_id = s.segment_id", "segments"))
def r10_refilled(t):
    rows = lifecycle.refilled(t.segments, _live(t))
    return rows.select("range_id", "segment_id", F.array_join("replicas", ",").alias("replicas"))


_FULL = ", ok AS (SELECT range_id, entry_id FROM acks GROUP BY ALL HAVING count(DISTINCT node_id) = 3{where})"


@query(
    sql(
        _FULL.format(where=" AND entry_id >= 9")
        + ", r AS (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY entry_id) + 8 AS k FROM ok) SELECT range_id, max(entry_id) AS committed FROM r WHERE k = entry_id GROUP BY range_id",
        "acks",
    )
)
def a12_after_retention(t):
    """Commit positions of logs whose first nine entries are gone."""
    retained = t.acks.select("range_id").distinct().withColumn("first_entry_id", F.lit(9).cast("long"))
    return membership.committed_prefix(t.acks.filter("entry_id >= 9"), 3, retained)


@query(
    sql(
        _FULL.format(where="")
        + ", last AS (SELECT range_id, max(entry_id) AS committed FROM (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY entry_id) - 1 AS k FROM ok) WHERE k = entry_id GROUP BY range_id) SELECT s.range_id, s.segment_id FROM segments s LEFT JOIN last l ON l.range_id = s.range_id WHERE state = 'Active' AND size_bytes >= 200 AND (s.range_id % 2 = 0 OR l.committed >= last_entry_id)",
        "segments",
        "acks",
    )
)
def r14_size_rolls(t):
    """Even ranges have all acknowledgements; the others stop at their first gap."""
    whole = t.segments.filter("state = 'Active' and range_id % 2 = 0").select("range_id", F.col("last_entry_id").alias("committed"))
    gaps = membership.committed_prefix(t.acks, 3).filter("range_id % 2 = 1")
    return lifecycle.size_rolls(t.segments, whole.unionByName(gaps), 200)


@query(
    sql(
        "SELECT event_id, CASE WHEN r.segment_id = s.newest AND (event_id % 5 = 0 OR event_id % 2 = 0) THEN 'n' || (r.range_id + r.segment_id) % 5 ELSE 'n' || (r.range_id + r.segment_id + event_id % 3) % 5 END AS node FROM records r JOIN (SELECT DISTINCT range_id, newest FROM segs) s ON s.range_id = r.range_id",
        "records",
        "segs",
    )
)
def s25_replica_choice(t):
    """Where each record's reader goes: group fetches, single fetches and offset queries of active and sealed segments."""
    e = F.col("event_id")
    at = t.segments.select("range_id", "segment_id", (F.col("state") == "Active").alias("active"), "replicas")
    requests = t.records.select("event_id", "range_id", "segment_id").join(at, ["range_id", "segment_id"])
    requests = requests.select(e, F.when(e % 5 == 0, "Offsets").otherwise("Fetch").alias("kind"), "active", (e % 2 == 0).alias("group_fetch"), F.get("replicas", F.lit(0)).alias("leader"), "replicas", e.alias("salt"))
    return membership.replica_choice(requests).select("event_id", "node")
