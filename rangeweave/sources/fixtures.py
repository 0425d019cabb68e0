"""The ``events`` table read as a topic, and log tables derived from it by arithmetic that SQL can repeat."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.operators import log, routing
from rangeweave.schemas import RANGES

BATCH, SEGMENT = 20, 8
#: Key ranges in force: bounds are bytes.
BOUNDS = [(b"", b"\x3f"), (b"\x3f", b"\x7f"), (b"\x7f", b"\xbf"), (b"\xbf", b"\xff")]
#: A topic's history of splits and a merge: (id, start, end, state, split_into, merged_into, merged_from, end_entry_id).
HISTORY = [
    (0, b"", b"\xff", "Sealed", [1, 2], None, None, 9),
    (1, b"", b"\x7f", "Sealed", [3, 4], None, None, 5),
    (2, b"\x7f", b"\xff", "Sealed", [5, 6], None, None, 0),
    (3, b"", b"\x3f", "Active", None, None, None, None),
    (4, b"\x3f", b"\x7f", "Sealed", None, 7, None, 3),
    (5, b"\x7f", b"\xbf", "Sealed", None, 7, None, 4),
    (6, b"\xbf", b"\xff", "Active", None, None, None, None),
    (7, b"\x3f", b"\xbf", "Active", None, None, [4, 5], None),
]


def at_ms(ts) -> object:
    return F.unix_millis(F.col(ts).cast("timestamp"))


class Tables:
    """Log tables over ``sf_dir``; each is a plan, nothing runs until a query asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumns({"key": F.unhex(F.md5(F.col("user_id").cast("string").cast("binary"))), "at_ms": at_ms("ts")})

    @cached_property
    def ranges(self) -> DataFrame:
        rows = [(i, s, e, "Active", None, None, None, None) for i, (s, e) in enumerate(BOUNDS)]
        return self.spark.createDataFrame([(r[0], bytearray(r[1]), bytearray(r[2]), *r[3:]) for r in rows], RANGES).coalesce(1)

    @cached_property
    def history(self) -> DataFrame:
        return self.spark.createDataFrame([(r[0], bytearray(r[1]), bytearray(r[2]), *r[3:]) for r in HISTORY], RANGES).coalesce(1)

    @cached_property
    def routed(self) -> DataFrame:
        return routing.route(self.events, self.ranges)

    @cached_property
    def records(self) -> DataFrame:
        return log.batched(self.routed, BATCH, segment_entries=SEGMENT)

    @cached_property
    def entries(self) -> DataFrame:
        return log.entries(self.records)

    @cached_property
    def segments(self) -> DataFrame:
        rows = log.segments(self.entries)
        node = lambda k: F.concat(F.lit("n"), ((F.col("range_id") + F.col("segment_id") + k) % 5).cast("string"))
        return rows.withColumn("replicas", F.array(node(0), node(1), node(2)))

    @cached_property
    def observations(self) -> DataFrame:
        state = F.element_at(F.array(F.lit("Alive"), F.lit("Suspect"), F.lit("Dead")), (F.col("event_id") % 3 + 1).cast("int"))
        return self.events.select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("n"), (F.col("user_id") % 5).cast("string")).alias("node_id"),
            state.alias("state"),
            ((F.col("user_id") * 7 + F.floor(F.col("event_id") / 50)) % 11).alias("incarnation"),
        )

    @cached_property
    def rolls(self) -> DataFrame:
        kinds = ["DataPressure", "DataPressure", "DataPressure", "IdleMaintenance", "ReplicationFailure", "Recovery"]
        at = ((F.col("range_id") * 5 + F.col("entry_id") * 7 + F.floor(F.col("entry_id") / 11)) % 6 + 1).cast("int")
        return self.entries.select("range_id", F.col("entry_id").alias("seq"), F.element_at(F.array(*[F.lit(k) for k in kinds]), at).alias("intent"))

    @cached_property
    def acks(self) -> DataFrame:
        rows = self.entries.select("range_id", "entry_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
        return rows.filter((F.col("entry_id") * 3 + F.col("n") + F.col("range_id")) % 101 != 77).select("range_id", "entry_id", F.concat(F.lit("n"), F.col("n").cast("string")).alias("node_id"))

    @cached_property
    def offset_log(self) -> DataFrame:
        e = F.col("event_id")
        seal = e % 50 == 0
        step = F.when(e % 13 == 0, 1).when(e % 11 == 0, -1).otherwise(0)
        return self.records.select(
            e.alias("lsn"),
            F.when(seal, "Seal").otherwise("Commit").alias("kind"),
            F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_id"),
            "range_id",
            F.greatest(F.floor(e / 1000) + F.when(seal, 0).otherwise(step), F.lit(0)).cast("long").alias("generation"),
            "entry_id",
            "batch_offset",
        )

    @cached_property
    def frames(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            F.floor(e / 500).alias("file"), e.alias("lsn"), F.when(e % 10 == 9, "BatchEnd").otherwise("Data").alias("kind"), (e % 997 != 13).alias("ok")
        )

    @cached_property
    def reports(self) -> DataFrame:
        """What each replica of a sealed segment holds: its end, less up to two, or nothing."""
        s = self.segments.filter("state = 'Sealed'").select("range_id", "segment_id", "end_entry_id", F.posexplode("replicas").alias("pos", "node_id"))
        short = (F.col("segment_id") * 3 + F.col("pos") * 5 + F.col("range_id")) % 7
        return s.select("range_id", "segment_id", "node_id", F.when(short < 6, F.col("end_entry_id") - short % 3).alias("extent"))

    @cached_property
    def appends(self) -> DataFrame:
        """Producer appends with retries, gaps, conflicts and new incarnations."""
        e = F.col("event_id")
        rows = self.routed.select(
            e.alias("seq"), "range_id", F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("producer_id"), F.floor(e / 2500).alias("incarnation"), "at_ms"
        )
        from rangeweave.operators.prefix import numbered

        rows = numbered(rows, ["range_id", "producer_id", "incarnation"], "seq", "n")
        sequence = F.when(F.col("seq") % 17 == 3, F.greatest(F.col("n") - 2, F.lit(0))).when(F.col("seq") % 97 == 5, F.col("n") + 3).otherwise(F.col("n"))
        return rows.select(
            "seq", "range_id", "producer_id", "incarnation", sequence.alias("sequence"), (F.col("n") % 1000).alias("digest"), (F.col("at_ms") + 60000).alias("expires_at"), F.col("at_ms").alias("received_at"), (F.col("seq") % 501 != 0).alias("verified")
        )


#: The same tables as DuckDB common table expressions; keys are lower-case hex text, which sorts as the bytes do.
_HISTORY = ", ".join(
    f"({i}, '{s.hex()}', '{e.hex()}', '{st}', {sp if sp else 'NULL'}::BIGINT[], {m if m is not None else 'NULL'}::BIGINT, {mf if mf else 'NULL'}::BIGINT[], {en if en is not None else 'NULL'}::BIGINT)"
    for i, s, e, st, sp, m, mf, en in HISTORY
)
CTES = {
    "ev": "SELECT *, md5(user_id::VARCHAR) AS k, epoch_us(ts) // 1000 AS at_ms FROM events",
    "ranges": "SELECT range_id::BIGINT AS range_id, lo, hi FROM (VALUES (0, '', '3f'), (1, '3f', '7f'), (2, '7f', 'bf'), (3, 'bf', 'ff')) AS v(range_id, lo, hi)",
    "history": f"SELECT range_id::BIGINT AS range_id, lo, hi, state, split_into, merged_into, merged_from, end_entry_id FROM (VALUES {_HISTORY}) AS v(range_id, lo, hi, state, split_into, merged_into, merged_from, end_entry_id)",
    "routed": "SELECT ev.*, r.range_id FROM ev ASOF JOIN ranges r ON ev.k >= r.lo",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY event_id) - 1 AS absolute_offset FROM routed",
    "records": f"SELECT *, absolute_offset // {BATCH} AS entry_id, absolute_offset % {BATCH} AS batch_offset, absolute_offset // {BATCH} // {SEGMENT} AS segment_id FROM numbered",
    "entries": "SELECT range_id, segment_id, entry_id, count(*)::BIGINT AS record_count, sum(length(props))::BIGINT AS payload_bytes, max(at_ms) AS last_ms FROM records GROUP BY ALL",
    "segs": "SELECT range_id, segment_id, min(entry_id) AS start_entry_id, max(entry_id) AS last_entry_id, sum(payload_bytes)::BIGINT AS size_bytes, max(last_ms) AS last_ms, max(segment_id) OVER (PARTITION BY range_id) AS newest FROM entries GROUP BY range_id, segment_id",
    "segments": "SELECT range_id, segment_id, CASE WHEN segment_id = newest THEN 'Active' ELSE 'Sealed' END AS state, start_entry_id, CASE WHEN segment_id <> newest THEN last_entry_id END AS end_entry_id, CASE WHEN segment_id <> newest THEN last_ms END AS sealed_at_ms, size_bytes, last_entry_id, ['n' || (range_id + segment_id) % 5, 'n' || (range_id + segment_id + 1) % 5, 'n' || (range_id + segment_id + 2) % 5] AS replicas FROM segs",
    "observations": "SELECT event_id AS seq, 'n' || user_id % 5 AS node_id, ['Alive', 'Suspect', 'Dead'][event_id % 3 + 1] AS state, (user_id * 7 + event_id // 50) % 11 AS incarnation FROM ev",
    "rolls": "SELECT range_id, entry_id AS seq, ['DataPressure', 'DataPressure', 'DataPressure', 'IdleMaintenance', 'ReplicationFailure', 'Recovery'][(range_id * 5 + entry_id * 7 + entry_id // 11) % 6 + 1] AS intent FROM entries",
    "acks": "SELECT range_id, entry_id, 'n' || n AS node_id FROM entries, range(3) AS t(n) WHERE (entry_id * 3 + n + range_id) % 101 <> 77",
    "offset_log": "SELECT event_id AS lsn, CASE WHEN event_id % 50 = 0 THEN 'Seal' ELSE 'Commit' END AS kind, 'g' || user_id % 3 AS group_id, range_id, greatest(event_id // 1000 + CASE WHEN event_id % 50 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 1 WHEN event_id % 11 = 0 THEN -1 ELSE 0 END, 0)::BIGINT AS generation, entry_id, batch_offset FROM records",
    "epochs": "SELECT *, coalesce(max(CASE WHEN kind = 'Seal' THEN generation END) OVER (PARTITION BY group_id, range_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS epoch FROM offset_log",
    "committed": "SELECT group_id, range_id, arg_max(entry_id, entry_id * 1000 + batch_offset) AS entry_id, arg_max(batch_offset, entry_id * 1000 + batch_offset) AS batch_offset FROM epochs WHERE kind = 'Commit' AND generation = epoch GROUP BY ALL",
    "frames": "SELECT event_id // 500 AS file, event_id AS lsn, CASE WHEN event_id % 10 = 9 THEN 'BatchEnd' ELSE 'Data' END AS kind, event_id % 997 <> 13 AS ok FROM ev",
    "reports": "SELECT range_id, segment_id, replicas[pos + 1] AS node_id, CASE WHEN (segment_id * 3 + pos * 5 + range_id) % 7 < 6 THEN end_entry_id - (segment_id * 3 + pos * 5 + range_id) % 7 % 3 END AS extent FROM segments, range(3) AS t(pos) WHERE state = 'Sealed'",
    "edges": "SELECT range_id AS parent, split_into[p] AS child, p = 1 AS delegate FROM history, range(1, 3) AS t(p) WHERE split_into IS NOT NULL UNION ALL SELECT range_id, merged_into, true FROM history WHERE merged_into IS NOT NULL",
}
NEEDS = {
    "routed": ["ev", "ranges"], "numbered": ["routed"], "records": ["numbered"], "entries": ["records"], "segs": ["entries"], "segments": ["segs"], "observations": ["ev"],
    "rolls": ["entries"], "acks": ["entries"], "offset_log": ["records"], "epochs": ["offset_log"], "committed": ["epochs"], "frames": ["ev"], "reports": ["segments"], "edges": ["history"],
}


def sql(body: str, *names: str, recursive: str = "") -> str:
    """``body`` behind the expressions that ``names`` need; ``recursive``: more of them, already written out."""
    order: list[str] = []

    def need(name):
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body
