"""SQL of hashes, rings and folds that depend on order, for the queries that have them."""

from __future__ import annotations

#: The multipliers of MurmurHash3 (32 bit) and the polynomial of CRC-32.
C1, C2, STEP, FINAL1, FINAL2 = 3432918353, 461845907, 3864292196, 2246822507, 3266489909
POLYNOMIAL = 3988292384
WORD = 4294967296


def _mix(word: str) -> str:
    first = f"(({word}) * {C1}::UBIGINT % {WORD}::UBIGINT)"
    return f"((({first} << 15) | ({first} >> 17)) % {WORD}::UBIGINT * {C2}::UBIGINT % {WORD}::UBIGINT)"


def murmur(table: str, source: str, key: str) -> str:
    """CTEs that end in ``table``: the rows of ``source`` with ``hash`` of the bytes whose hexadecimal digits are ``key``."""
    pairs = lambda at: " || ".join(f"substr(hx, {at} + {k}, 2)" for k in (7, 5, 3, 1))
    rest = " || ".join(f"substr(hx, n // 4 * 8 + {k}, 2)" for k in (5, 3, 1))
    turn = f"((((xor(h, k)) << 13) | (xor(h, k) >> 19)) % {WORD}::UBIGINT * 5 + {STEP}) % {WORD}::UBIGINT"
    return f"""{table}1 AS (SELECT *, {key} AS hx, length({key}) // 2 AS n FROM {source}),
{table}2 AS (SELECT *, list_transform(range(0, n // 4), lambda i: {_mix("('0x' || " + pairs('i * 8') + ")::UBIGINT")}) AS ks, ('0x0' || {rest})::UBIGINT AS tail FROM {table}1),
{table}3 AS (SELECT *, xor(xor(list_reduce(list_prepend(0::UBIGINT, ks), lambda h, k: {turn}), {_mix("tail")}), n::UBIGINT) AS h0 FROM {table}2),
{table}4 AS (SELECT *, xor(h0, h0 >> 16) * {FINAL1}::UBIGINT % {WORD}::UBIGINT AS h1 FROM {table}3),
{table}5 AS (SELECT *, xor(h1, h1 >> 13) * {FINAL2}::UBIGINT % {WORD}::UBIGINT AS h2 FROM {table}4),
{table} AS (SELECT * EXCLUDE (hx, n, ks, tail, h0, h1, h2), xor(h2, h2 >> 16)::BIGINT AS hash FROM {table}5)"""


def crc32(key: str) -> str:
    """CRC-32 of the bytes whose hexadecimal digits are ``key``."""
    byte = f"('0x' || substr({key}, i * 2 + 1, 2))::UBIGINT"
    bits = f"list_reduce(list_prepend(xor(c, x), range(0, 8)::UBIGINT[]), lambda a, b: xor(a >> 1, (a & 1::UBIGINT) * {POLYNOMIAL}::UBIGINT))"
    return f"xor(list_reduce(list_prepend({WORD - 1}::UBIGINT, list_transform(range(0, length({key}) // 2), lambda i: {byte})), lambda c, x: {bits}), {WORD - 1}::UBIGINT)::BIGINT"


#: Five nodes of sixteen tokens.
RING = murmur("ring", "(SELECT 'n' || i AS node_id, r AS replica FROM range(5) AS a(i), range(16) AS b(r))", "(lower(hex(node_id)) || printf('%016x', replica))")
OWNERS = """, anchors AS (SELECT DISTINCT hash AS group_id FROM ring), near AS (
  SELECT group_id, node_id, min((hash - group_id + 4294967296) % 4294967296) AS d FROM anchors, ring{where} GROUP BY ALL
), owned AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY d, node_id) - 1 AS pos, node_id FROM near QUALIFY pos < 3)"""
GROUPED = ", grouped AS (SELECT q.*, coalesce((SELECT min(r.hash) FROM ring r WHERE r.hash >= q.hash), (SELECT min(hash) FROM ring)) AS group_id FROM keyed q)"

APPENDS = """base AS (
  SELECT event_id AS seq, range_id, 'p' || user_id % 12 AS producer_id, event_id // 2500 AS incarnation, at_ms,
         row_number() OVER (PARTITION BY range_id, user_id % 12, event_id // 2500 ORDER BY event_id) - 1 AS n FROM routed
), appends AS (
  SELECT seq, range_id, producer_id, incarnation, n % 1000 AS digest, at_ms + 60000 AS expires_at, at_ms AS received_at, seq % 501 <> 0 AS verified,
         CASE WHEN seq % 17 = 3 THEN greatest(n - 2, 0) WHEN seq % 97 = 5 THEN n + 3 ELSE n END AS sequence,
         row_number() OVER (PARTITION BY range_id, producer_id ORDER BY seq) AS i FROM base
), gate AS (
  SELECT range_id, producer_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS inc, NULL::BIGINT AS front,
         []::STRUCT(s BIGINT, d BIGINT, e BIGINT)[] AS recent, NULL::VARCHAR AS verdict, NULL::BIGINT AS number FROM (SELECT DISTINCT range_id, producer_id FROM appends)
  UNION ALL
  SELECT range_id, producer_id, i, seq, CASE WHEN step = 'new' THEN incarnation ELSE inc END,
         CASE WHEN verdict = 'Ok' THEN sequence WHEN step = 'new' THEN NULL ELSE front END,
         CASE WHEN verdict = 'Ok' THEN list_append(kept, {'s': sequence, 'd': digest, 'e': seq})[-16:] ELSE kept END, verdict,
         CASE verdict WHEN 'Ok' THEN seq WHEN 'Duplicate' THEN old.e WHEN 'SequenceGap' THEN expected END
  FROM (
    SELECT *, CASE WHEN step IN ('SessionExpired', 'SessionNotInstalled', 'ProducerFenced') THEN step
                   WHEN sequence < expected AND old IS NULL THEN 'DuplicatePositionUnavailable'
                   WHEN sequence < expected THEN CASE WHEN old.d = digest THEN 'Duplicate' ELSE 'RequestIdentityConflict' END
                   WHEN sequence <> expected THEN 'SequenceGap' ELSE 'Ok' END AS verdict
    FROM (
      SELECT *, list_filter(kept, lambda x: x.s = sequence)[1] AS old,
             CASE WHEN step = 'new' OR front IS NULL THEN 0 ELSE front + 1 END AS expected
      FROM (
        SELECT a.*, g.inc, g.front, CASE WHEN expires_at < received_at THEN 'SessionExpired'
                 WHEN (g.inc IS NULL OR a.incarnation > g.inc) AND NOT verified THEN 'SessionNotInstalled'
                 WHEN g.inc IS NULL OR a.incarnation > g.inc THEN 'new' WHEN a.incarnation < g.inc THEN 'ProducerFenced' ELSE 'same' END AS step,
               CASE WHEN expires_at >= received_at AND verified AND (g.inc IS NULL OR a.incarnation > g.inc) THEN [] ELSE g.recent END AS kept
        FROM gate g JOIN appends a ON a.range_id = g.range_id AND a.producer_id = g.producer_id AND a.i = g.i + 1
      )
    )
  )
)"""


def batches(nbytes: str, max_bytes: int, max_records: int, linger_ms: int | None = None) -> str:
    """Recursion over each range's records: the batch of a record, and its bytes, records and first time so far."""
    late = f"at_ms - first >= {linger_ms}" if linger_ms is not None else "false"
    return f"""rec AS (SELECT range_id, event_id AS seq, ({nbytes}) + 8 AS b, at_ms, row_number() OVER (PARTITION BY range_id ORDER BY event_id) AS i FROM routed
), fold AS (
  SELECT range_id, 0::BIGINT AS i, NULL::BIGINT AS seq, -1::BIGINT AS batch, 0::BIGINT AS size, 0::BIGINT AS n, 0::BIGINT AS first, true AS closed FROM (SELECT DISTINCT range_id FROM rec)
  UNION ALL
  SELECT range_id, i, seq, CASE WHEN fresh THEN batch + 1 ELSE batch END, CASE WHEN fresh THEN b ELSE size + b END, CASE WHEN fresh THEN 1 ELSE n + 1 END,
         CASE WHEN fresh THEN at_ms ELSE first END, CASE WHEN fresh THEN b ELSE size + b END >= {max_bytes} OR CASE WHEN fresh THEN 1 ELSE n + 1 END >= {max_records}
  FROM (SELECT r.*, f.batch, f.size, f.n, f.first, f.closed OR {late} AS fresh FROM fold f JOIN rec r ON r.range_id = f.range_id AND r.i = f.i + 1)
)"""


def rolls(limit: int) -> str:
    """Recursion over each range's entries: a segment closes once its bytes reach the limit."""
    return f"""fold AS (
  SELECT range_id, -1::BIGINT AS entry_id, 0::BIGINT AS segment, 0::BIGINT AS size FROM (SELECT DISTINCT range_id FROM entries)
  UNION ALL
  SELECT e.range_id, e.entry_id, CASE WHEN f.size >= {limit} THEN f.segment + 1 ELSE f.segment END, CASE WHEN f.size >= {limit} THEN 0 ELSE f.size END + e.payload_bytes
  FROM fold f JOIN entries e ON e.range_id = f.range_id AND e.entry_id = f.entry_id + 1
)"""


#: Members present after a command: those whose last command is a heartbeat that is young enough; times never fall.
MEMBERS = """, cmd AS (
  SELECT 'g' || user_id % 3 AS group_id, event_id AS seq, 'm' || user_id % 8 AS member, event_id % 29 = 0 AS leaves, at_ms, 3 + event_id // 400 % 2 AS top FROM ev
), names AS (SELECT DISTINCT group_id, member AS who FROM cmd), asked AS (SELECT * FROM cmd JOIN names USING (group_id)
), known AS (
  SELECT a.group_id, a.seq, a.top, a.who, c.leaves = false AND a.at_ms - c.at_ms <= 7200000 AS here
  FROM asked a ASOF LEFT JOIN cmd c ON a.group_id = c.group_id AND a.who = c.member AND a.seq >= c.seq
), sets AS (
  SELECT group_id, seq, top, coalesce(string_agg(who, ',' ORDER BY who) FILTER (here), '') AS members FROM known GROUP BY ALL
), held AS (
  SELECT *, CASE WHEN members = '' THEN '' WHEN top = 3 THEN '0,1,2,3' ELSE '0,1,2,3,4' END AS ranges, CASE WHEN top = 3 THEN '0,1,2,3' ELSE '0,1,2,3,4' END AS wanted FROM sets
), turns AS (
  SELECT *, (members <> coalesce(lag(members) OVER w, '') OR wanted <> coalesce(lag(ranges) OVER w, ''))::INT AS turn FROM held WINDOW w AS (PARTITION BY group_id ORDER BY seq)
), grown AS (SELECT *, sum(turn) OVER (PARTITION BY group_id ORDER BY seq)::BIGINT AS generation FROM turns)"""


def wal(limit: int) -> str:
    """Recursion over each log's frames: a file that has reached the limit is followed by a new one."""
    return f"""frame AS (SELECT range_id AS log_id, event_id AS lsn, length(props) + 17 AS b, row_number() OVER (PARTITION BY range_id ORDER BY event_id) AS i FROM records
), fold AS (
  SELECT log_id, 0::BIGINT AS i, NULL::BIGINT AS lsn, 0::BIGINT AS file, 0::BIGINT AS size, 0::BIGINT AS b FROM (SELECT DISTINCT log_id FROM frame)
  UNION ALL
  SELECT f.log_id, f.i, f.lsn, CASE WHEN p.size >= {limit} THEN p.file + 1 ELSE p.file END, CASE WHEN p.size >= {limit} THEN 0 ELSE p.size END + f.b, f.b
  FROM fold p JOIN frame f ON f.log_id = p.log_id AND f.i = p.i + 1
)"""
