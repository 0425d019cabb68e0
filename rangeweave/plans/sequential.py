"""Queries: folds that depend on order, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.operators import dedup, groups, log
from rangeweave.plans import folds
from rangeweave.plans.catalog import query
from rangeweave.sources.fixtures import sql


@query(sql("SELECT range_id, producer_id, seq, verdict, number FROM gate WHERE i > 0", "routed", recursive=folds.APPENDS))
def t1_dedup_verdicts(t):
    return dedup.verdicts(t.appends)


def _opens(t):
    e = F.col("event_id")
    return t.events.select(F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("producer_id"), e.alias("seq"), F.floor(e / 100).cast("string").alias("nonce"), F.col("at_ms").alias("observed_at"))


_T2 = """
, o AS (SELECT 'p' || user_id % 12 AS producer_id, event_id AS seq, event_id // 100 AS nonce, at_ms AS seen FROM ev)
, p AS (SELECT *, lag(nonce) OVER w AS pn, lag(seen) OVER w AS pa FROM o WINDOW w AS (PARTITION BY producer_id ORDER BY seq))
, f AS (SELECT *, (pa IS NULL OR pa + 600000 < seen)::INT AS fresh FROM p)
, r AS (SELECT *, sum(fresh) OVER (PARTITION BY producer_id ORDER BY seq) AS run FROM f)
SELECT producer_id, seq, sum((fresh = 0 AND nonce <> pn)::INT) OVER (PARTITION BY producer_id, run ORDER BY seq)::BIGINT AS incarnation, seen + 600000 AS expires_at FROM r
"""


@query(sql(_T2, "ev"))
def t2_session_leases(t):
    return dedup.sessions(_opens(t), 600000)


@query(sql(", q AS (SELECT event_id, 'p' || user_id % 12 AS producer_id, event_id // 3000 AS incarnation, at_ms AS seen FROM ev) SELECT event_id, CASE WHEN user_id_mod > 9 THEN 'ExistingOnly' WHEN 1705276800000 < seen THEN 'Expired' WHEN incarnation < 1 THEN 'Fenced' WHEN incarnation = 1 THEN 'Verified' ELSE 'ExistingOnly' END AS verdict FROM (SELECT q.*, substr(producer_id, 2)::INT AS user_id_mod FROM q)", "ev"))
def t3_session_verify(t):
    e = F.col("event_id")
    requests = t.events.select(e, F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("producer_id"), F.floor(e / 3000).alias("incarnation"), F.col("at_ms").alias("at"))
    known = t.spark.range(10).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("producer_id"), F.lit(1).cast("long").alias("incarnation"), F.lit(1705276800000).alias("expires_at"))
    return dedup.verify_sessions(requests, known).select("event_id", "verdict")


@query(sql(folds.MEMBERS + "SELECT group_id, seq, generation, members, ranges FROM grown", "ev"))
def a18_group_membership(t):
    e = F.col("event_id")
    commands = t.events.select(
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_id"),
        e.alias("seq"),
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("member"),
        F.when(e % 29 == 0, "Leave").otherwise("Heartbeat").alias("action"),
        F.col("at_ms").alias("at"),
        F.sequence(F.lit(0).cast("long"), 3 + F.floor(e / 400) % 2).alias("ranges"),
    )
    return groups.membership(commands, 7200000)


@query(sql("SELECT range_id, seq, batch FROM fold WHERE i > 0", "routed", recursive=folds.batches("length(props) + length(event_type)", 600, 25)))
def a1_byte_batches(t):
    rows = t.routed.select("range_id", F.col("event_id").alias("seq"), (F.length("props") + F.length("event_type")).alias("nbytes"), "at_ms")
    return log.batched_by_bytes(rows, 600, 25)


@query(sql("SELECT range_id, seq, batch FROM fold WHERE i > 0", "routed", recursive=folds.batches("length(props)", 1 << 20, 1000, 3600000)))
def a2_linger_batches(t):
    rows = t.routed.select("range_id", F.col("event_id").alias("seq"), F.length("props").alias("nbytes"), "at_ms")
    return log.batched_by_bytes(rows, 1 << 20, 1000, linger_ms=3600000)


@query(sql("SELECT range_id, count(*) // 20 + (count(*) % 20 > 0)::INT AS batches FROM routed GROUP BY range_id", "routed"))
def a1_count_batches(t):
    rows = t.routed.select("range_id", F.col("event_id").alias("seq"), F.lit(1).alias("nbytes"), "at_ms")
    return log.batched_by_bytes(rows, 1 << 40, 20).groupBy("range_id").agg(F.count_distinct("batch").alias("batches"))


@query(
    sql(
        folds.MEMBERS
        + """, one AS (SELECT group_id, seq, generation, string_split(members, ',') AS ms, string_split(ranges, ',') AS rs FROM grown WHERE members <> '')
SELECT group_id, seq, generation, ms[k + 1] AS member, array_to_string(list_filter(rs, lambda r: r::INT % len(ms) = k), ',') AS ranges FROM one, unnest(range(0, len(ms))) AS u(k)""",
        "ev",
    )
)
def s23_group_sync(t):
    """After each heartbeat or leave: the generation and the ranges that each member then has."""
    synced = a18_group_membership(t).filter("members <> ''").withColumns({"ms": F.split("members", ","), "rs": F.split("ranges", ",")})
    each = synced.select("group_id", "seq", "generation", "rs", F.size("ms").alias("n"), F.posexplode("ms").alias("k", "member"))
    own = F.filter("rs", lambda r: r.cast("int") % F.col("n") == F.col("k"))
    return each.select("group_id", "seq", "generation", "member", F.array_join(own, ",").alias("ranges"))


@query(sql(_T2, "ev"))
def s24_open_session(t):
    return dedup.sessions(_opens(t), 600000)


@query(sql(", b AS (SELECT user_id % 5 AS node, at_ms, lead(at_ms) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS nxt FROM ev) SELECT node, at_ms + 7200000 AS suspect_ms, CASE WHEN nxt IS NULL OR nxt - at_ms > 10800000 THEN at_ms + 10800000 END AS dead_ms FROM b WHERE nxt IS NULL OR nxt - at_ms > 7200000", "ev"))
def t16_failure_intervals(t):
    """The failure detector over a bounded log: when silence turns a node Suspect, then Dead."""
    return groups.silences(t.events.select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("seq"), "at_ms"), 7200000, 3600000)
