"""Cluster membership, placement on the hash ring, commit and recovery boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeweave.operators.sizes import small

from rangeweave.functions.ring import murmur3_32, token_key
from rangeweave.operators.prefix import numbered

#: States by severity.
SEVERITY = ("Alive", "Suspect", "Dead")


def severity(state):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), state)


def merged_members(observations: DataFrame) -> DataFrame:
    """The highest incarnation wins, then the gravest state; the order of observations doesn't matter."""
    top = F.max(F.struct("incarnation", severity(F.col("state")).alias("s")))
    rows = observations.groupBy("node_id").agg(top.alias("t"))
    return rows.select("node_id", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("t.s").cast("int")).alias("state"), F.col("t.incarnation").alias("incarnation"))


def refuted(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Own incarnation after hearing of oneself: one above the highest Suspect or Dead report that isn't older."""
    bad = observations.filter("state <> 'Alive'").groupBy("node_id").agg(F.max("incarnation").alias("_heard"))
    rows = members.join(bad, "node_id", "left")
    return rows.select("node_id", F.when(F.col("_heard") >= F.col("incarnation"), F.col("_heard") + 1).otherwise(F.col("incarnation")).alias("incarnation"))


def cluster(members: DataFrame) -> DataFrame:
    """S21."""
    return members.select("node_id", F.concat(F.col("node_id"), F.lit(":7000")).alias("address"), "state")


def leaders(reports: DataFrame) -> DataFrame:
    """(group_id, leader, term): a strictly greater term wins, the first to arrive on a tie."""
    best = F.min(F.struct((-F.col("term")).alias("t"), "seq", "leader"))
    return reports.groupBy("group_id").agg(best.alias("b")).select("group_id", F.col("b.leader").alias("leader"), (-F.col("b.t")).alias("term"))


def durable_boundary(reports: DataFrame) -> DataFrame:
    """A10: (segment, boundary): the least of the survivors' extents; null if one holds nothing."""
    full = F.count(F.lit(1)) == F.count("extent")
    return reports.groupBy("range_id", "segment_id").agg(F.when(full, F.min("extent")).alias("boundary"))


def recency_leader(reports: DataFrame) -> DataFrame:
    """The node of the greatest extent, the least node id on a tie."""
    best = F.min(F.struct(F.coalesce(-F.col("extent"), F.lit(2**62)).alias("e"), "node_id"))
    return reports.groupBy("range_id", "segment_id").agg(best["node_id"].alias("leader"))


def committed_prefix(acks: DataFrame, replicas: int, retained: DataFrame | None = None) -> DataFrame:
    """(range_id, committed): entries that all ``replicas`` acknowledged, up to the first gap; ranges without any are absent.

    ``retained`` (range_id, first_entry_id) tells where a range's log begins after retention; elsewhere it begins at 0.
    """
    full = acks.groupBy("range_id", "entry_id").agg(F.count_distinct("node_id").alias("n")).filter(F.col("n") >= replicas)
    if retained is None:
        full = full.withColumn("first_entry_id", F.lit(0).cast("long"))
    else:
        full = full.join(small(retained), "range_id", "left").fillna(0, ["first_entry_id"]).filter("entry_id >= first_entry_id")
    # the full entries without a gap are those whose id equals their rank from the first on
    ranked = numbered(full, ["range_id"], "entry_id", "_rn").filter("_rn = entry_id - first_entry_id")
    return ranked.groupBy("range_id").agg(F.max("entry_id").alias("committed"))


def commit_index(matches: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """(group_id, commit_index): the greatest index of ``term`` that a majority has."""
    voters = matches.groupBy("group_id").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("_quorum"))
    order = Window.partitionBy("group_id").orderBy(F.desc("match_index"))
    at = matches.withColumn("_rn", F.row_number().over(order)).join(voters, "group_id").filter("_rn = _quorum").select("group_id", "match_index")
    own = log.filter(F.col("term") == term).join(at, "group_id").filter("idx <= match_index")
    return own.groupBy("group_id").agg(F.max("idx").alias("commit_index"))


def missing_peers(ring_nodes: DataFrame, peers: DataFrame) -> DataFrame:
    """(group_id, node_id) on the ring that aren't peers yet."""
    return ring_nodes.join(peers, ["group_id", "node_id"], "left_anti")


def gossip(items: DataFrame, budget: int) -> DataFrame:
    """Items by remaining sends, up to the first that doesn't fit the byte budget, as far as one node's buffer goes."""
    order = Window.partitionBy("node_id").orderBy(F.desc("remaining"), "item")
    return items.withColumn("_cum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_cum") <= budget).drop("_cum")


def ring(nodes: DataFrame, tokens: int) -> DataFrame:
    """(hash, node_id, replica): ``tokens`` virtual nodes for each node."""
    each = nodes.select("node_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tokens - 1).cast("long"))).alias("replica"))
    return each.select(murmur3_32(token_key(F.col("node_id"), F.col("replica"))).alias("hash"), "node_id", "replica")


def shard_groups(keys: DataFrame, ring: DataFrame) -> DataFrame:
    """Adds group_id, the first token's hash at or after the key's own, around the ring.

    Tokens tile the hash space; each tile is cut at the 2^20 hash prefixes that it meets, so that keys
    find theirs by an equality join.
    """
    span = 4096
    order = Window.orderBy("hash")
    t = ring.select("hash").distinct().withColumn("lo", F.coalesce(F.lag("hash").over(order) + 1, F.lit(0).cast("long")))
    first = t.agg(F.min("hash").alias("first"), F.max("hash").alias("last"))
    wrap = first.select(F.col("first").alias("group_id"), (F.col("last") + 1).alias("lo"), F.lit(2**32 - 1).cast("long").alias("hi")).filter("lo <= hi")
    t = t.select(F.col("hash").alias("group_id"), "lo", F.col("hash").alias("hi")).union(wrap)
    width = 2**32 // span
    t = t.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    h = keys.withColumn("key_hash", murmur3_32(F.col("key")))
    hit = (F.floor(F.col("key_hash") / width) == F.col("slot")) & F.col("key_hash").between(F.col("lo"), F.col("hi"))
    return h.join(small(t), hit).select(*keys.columns, "key_hash", "group_id")


def owners(anchors: DataFrame, ring: DataFrame, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """(group_id, pos, node_id): the first ``n`` distinct nodes clockwise from each anchor's token, without those excluded.

    Each token looks at the tokens that follow it; the look-ahead doubles until every token sees enough nodes or the
    whole ring. So the work is tokens times look-ahead, and anchors find their token by an equality join.
    """
    node = F.col("node_id")
    if excluded is not None:
        gone = excluded.select(node, F.lit(True).alias("_gone"))
        ring = ring.join(gone, "node_id", "left").withColumn("node_id", F.when(F.col("_gone").isNull(), node))
    total, nodes = ring.agg(F.count(F.lit(1)), F.count_distinct("node_id")).first()
    twice = ring.select("hash", "node_id").withColumn("at", F.col("hash")).union(ring.select("hash", "node_id", (F.col("hash") + 2**32).alias("at")))
    ahead = 4 * n + 16
    while True:
        seen = Window.orderBy("at", F.col("node_id").asc_nulls_last()).rowsBetween(Window.currentRow, ahead - 1)
        # equal hashes count as one place: the first row of a hash sees them all
        near = twice.withColumn("near", F.array_distinct(F.collect_list("node_id").over(seen))).filter(F.col("at") < 2**32)
        near = near.groupBy("hash").agg(F.min_by("near", F.struct(F.col("node_id").isNull(), "node_id")).alias("near"))
        if ahead >= total or near.filter(F.size("near") < min(n, nodes)).isEmpty():
            break
        ahead *= 4
    rows = anchors.select("group_id").distinct().join(near, F.col("group_id") == F.col("hash"))
    return rows.select("group_id", F.posexplode(F.slice("near", 1, n)).alias("pos", "node_id"))


def replica_choice(requests: DataFrame) -> DataFrame:
    """Adds ``node`` to requests (kind, active, group_fetch, leader, replicas, salt).

    A group's fetch of the active tail and an offset query of an active segment go to the leader; other reads to
    any replica: the one that ``salt`` points at.
    """
    leads = F.col("active") & ((F.col("kind") == "Offsets") | F.col("group_fetch"))
    spread = F.get("replicas", (F.col("salt") % F.size("replicas")).cast("int"))
    return requests.withColumn("node", F.when(leads, F.col("leader")).otherwise(spread))
