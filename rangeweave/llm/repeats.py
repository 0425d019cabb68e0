"""Operator 10, exact repeats: the common-prefix interval tree of an enhanced suffix array.

Repeats of ``LEAST`` = 100 bytes or more are found over all texts at once, in bounded pieces:

1. Anchors. In every window of 100 bytes the smallest hash of its 36-byte strings is its anchor, so
   equal windows have equal anchors. Each chunk of texts sends every distinct anchor once; anchors
   that occur twice anywhere come back as positions. All other text can hold no repeat.
2. Chunk by chunk, windows with such anchors make runs of at most 65, whose suffixes are sorted: by the fingerprint
   of their first 100 bytes, verified byte by byte, then by what follows. The sorted array's
   common-prefix intervals are scanned with a stack. Only intervals whose occurrences differ in
   their left neighbours are kept (others are part of the interval one byte further left): the
   maximal repeats. An interval has all its occurrences, and all but the earliest are covered.
3. Windows that are the first of their kind in their chunk are dealt by anchor over the cluster and
   scanned the same way; a passage sends one run a chunk however often it occurs in it.

Defined results: null texts have no bytes. Ids order documents, null as the largest. Rows of one id
count as one document: equal starts in them are not earlier than one another, so rows repeated in
full are judged alike, and come out repeated. Texts under 100 bytes lose nothing. Empty tables give
empty results. Only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, written

LEAST, GRAM = 100, 36
SPAN = LEAST - GRAM + 1  # 36-byte strings in a window: 65
CHUNK = 3 << 20
LAST = 2**63 - 1
MANY = np.uint32(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(36).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def hashes(buffer: np.ndarray, windows: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of the GRAM and, with ``windows``, of the LEAST bytes from each position on, where there are as many."""
    level, kept = _TABLE[buffer], {}
    for n in (1, 2, 4, 8, 16, 32):
        if n in (4, 32):
            kept[n] = level
        level = level[:-n] * _power(n) + level[n:]
    n = len(buffer)
    gram = kept[32][: n - 35] * _power(4) + kept[4][32 : n - 3]
    gram ^= gram >> np.uint64(31)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    if not windows:
        return gram, None
    window = (level[: n - 99] * _power(32) + kept[32][64 : n - 35]) * _power(4) + kept[4][96 : n - 3]
    return gram, window


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick over the 65 values from each position on."""
    level = x
    for n in (1, 2, 4, 8, 16, 32):
        level = pick(level[:-n], level[n:])
    return pick(level[:-1], x[64:])


class Chunk:
    """Texts side by side: per piece of a text its order, text hash, offset in the text and place in the buffer."""

    def __init__(self, parts, windows: bool):
        self.order = np.array([p[0] for p in parts], np.int64)
        self.th = np.array([p[1] for p in parts], np.int64)
        self.base = np.array([p[2] for p in parts], np.int64)
        sizes = np.array([len(p[3]) for p in parts], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.buffer = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        self.gram, self.window = hashes(self.buffer, windows)
        #: each window's anchor; 0 where the bytes aren't of one text
        self.least = _slide(self.gram, np.minimum)
        for a, b in zip(self.end[:-1] - LEAST + 1, self.end[:-1]):
            self.least[a:b] = 0

    def anchors(self) -> np.ndarray:
        padded = np.concatenate((np.zeros(64, np.uint64), self.least, np.zeros(64, np.uint64)))
        return np.flatnonzero(_slide(padded, np.maximum)[: len(self.gram)] == self.gram)

    def name(self) -> int:
        return xxhash.xxh64_intdigest(self.order.tobytes() + self.th.tobytes() + self.base.tobytes()) >> 1

    def piece(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")


def chunks(rows, windows: bool = True):
    """Chunks of about CHUNK bytes from (order, th, text, ...); long texts are cut so that each window is in one piece."""
    held, size = [], 0
    for row in rows:
        order, th, text = row[:3]
        for at in range(0, max(0, len(text) - LEAST + 1), CHUNK):
            part = text[at : at + CHUNK + LEAST - 1]
            held.append((order, th, at, part, row))
            size += len(part)
            if size >= CHUNK:
                yield Chunk(held, windows), held
                held, size = [], 0
    if held:
        yield Chunk(held, windows), held


def _rows(batches, columns):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _batch(names, rows, kinds):
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


MESSAGE = ["bucket", "chunk", "kind", "data"]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
MESSAGE_TYPE = "bucket int, chunk long, kind int, data binary"
ASK, PLACES, FOUND = 0, 1, 2


def _packed(*arrays) -> bytes:
    return b"".join(np.int64(len(b)).tobytes() + b for b in (a.tobytes() for a in arrays))


def _unpacked(data: bytes, *kinds):
    at = 0
    for kind in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        yield np.frombuffer(data[at + 8 : at + 8 + n], kind)
        at += 8 + n


def _ask(buckets):
    def run(batches):
        for chunk, _ in chunks(_rows(batches, (0, 1, 2)), windows=False):
            name, at = chunk.name(), chunk.anchors()
            value = chunk.gram[at]
            order = np.argsort(value, kind="stable")
            value, at = value[order], at[order]
            first = np.concatenate(([True], value[1:] != value[:-1]))
            alone = first & np.concatenate((first[1:], [True]))
            own = at[~alone]
            where = np.where(alone, at, MANY).astype(np.uint32)[first]
            value = value[first]
            bucket = ((value >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(name % buckets, name, PLACES, _packed(chunk.order, chunk.th, chunk.base, chunk.start, own))]
            for b in range(buckets):
                some = order[cut[b] : cut[b + 1]]
                if len(some):
                    low = np.ascontiguousarray(value[some].view(np.uint8).reshape(-1, 8)[:, :6])
                    rows.append((b, name, ASK, _packed(low, where[some])))
            yield _batch(MESSAGE, rows, KINDS)

    return run


def _groups(batches, key):
    """Lists of rows with equal column ``key``, of batches sorted by it."""
    held, now = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[key] != now:
                yield held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield held


def _answer(batches):
    for rows in _groups(batches, 0):
        out = [r for r in rows if r[2] == PLACES]
        asked = [r for r in rows if r[2] == ASK]
        if asked:
            values, where = [], []
            for r in asked:
                low, at = _unpacked(r[3], np.uint8, np.uint32)
                wide = np.zeros((len(at), 8), np.uint8)
                wide[:, :6] = low.reshape(-1, 6)
                values.append(wide.view(np.uint64).ravel())
                where.append(at)
            source = np.repeat(np.arange(len(asked)), [len(v) for v in where])
            value, at = np.concatenate(values), np.concatenate(where)
            order = np.argsort(value, kind="stable")
            same = value[order][1:] == value[order][:-1]
            again = np.zeros(len(value), bool)
            again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            again &= at != MANY
            cut = np.searchsorted(source[again], np.arange(len(asked) + 1))
            at = at[again]
            out += [(r[0], r[1], FOUND, _packed(at[a:b])) for r, a, b in zip(asked, cut, cut[1:]) if b > a]
        if out:
            yield _batch(MESSAGE, out, KINDS)


def _placed(batches):
    """(o, th, at): positions of repeated anchors in each text."""
    for rows in _groups(batches, 1):
        places = next(r for r in rows if r[2] == PLACES)
        order, th, base, start, own = _unpacked(places[3], *[np.int64] * 5)
        at = np.unique(np.concatenate([own, *[next(_unpacked(r[3], np.uint32)).astype(np.int64) for r in rows if r[2] == FOUND]]))
        piece = np.searchsorted(start, at, "right") - 1
        cut = np.searchsorted(piece, np.arange(len(start) + 1))
        found = [(int(order[i]), int(th[i]), (at[a:b] - start[i] + base[i]).tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        if found:
            yield _batch(["o", "th", "at"], found, [pa.int64(), pa.int64(), pa.binary()])


def scan(buffer, window, starts, opens, ends, key):
    """(start, length) of covered repeats among windows.

    ``starts``: ascending window starts; ``opens``: the window begins its run; ``ends``: where
    its run's bytes end, SPAN windows on at most; ``key``: its place in the order of documents and starts.
    """
    none = np.zeros(0, np.int64)
    order = np.argsort(window[starts], kind="stable")
    value = window[starts[order]]
    same = value[1:] == value[:-1]
    rows = np.lib.stride_tricks.sliding_window_view(buffer, LEAST)
    at = np.flatnonzero(same)
    for a in range(0, len(at), 1 << 18):
        some = at[a : a + (1 << 18)]
        same[some] = (rows[starts[order[some]]] == rows[starts[order[some + 1]]]).all(axis=1)
    member = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else none.astype(bool)
    if not member.any():
        return none, none
    head = np.concatenate(([True], ~same))[member]
    order = order[member]
    first = np.flatnonzero(head)
    # left neighbours that differ, or lie outside the run: the interval cannot be extended to the left as a whole
    left = np.where(opens[order], -1, buffer[np.maximum(starts[order] - 1, 0)].astype(np.int16))
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    group = np.cumsum(head) - 1
    diverse = ((low != high) | (low < 0))[group]
    order, group = order[diverse], group[diverse]
    # the suffix array proper: by group, then by the bytes that follow in the run
    more = ends[order] - starts[order] - LEAST
    wide = np.concatenate((buffer, np.zeros(SPAN + LEAST, np.uint8)))
    tail = np.lib.stride_tricks.sliding_window_view(wide, 64)[starts[order] + LEAST]
    tail = np.where(np.arange(64)[None, :] < more[:, None], tail, 0)
    words = np.ascontiguousarray(tail).view(">u8").astype(np.uint64)
    sort = np.lexsort([more, *words.T[::-1], group])  # of equal bytes the shorter first, as zero bytes may be text
    order, group, tail, more = order[sort], group[sort], tail[sort], more[sort]
    differs = tail[1:] != tail[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), 64)
    common = np.minimum(common, np.minimum(more[1:], more[:-1])) + LEAST
    lcp = np.where(group[1:] == group[:-1], common, 0).tolist() + [0]
    keys, best = key[order].tolist(), [0] * len(order)
    stack: list = []
    own = [0]
    for i, depth in enumerate(lcp, 1):
        while stack and stack[-1][0] > depth:
            level, own2 = stack.pop()
            own += own2
            earliest = min(keys[x] for x in own)
            for x in own:
                if keys[x] > earliest:
                    best[x] = level
            own = [x for x in own if keys[x] == earliest]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1].extend(own)
            else:
                stack.append((depth, own))
        own = [i]
    best = np.array(best, np.int64)
    found = best > 0
    return starts[order[found]], best[found]


def _intervals(flags: np.ndarray, split: np.ndarray):
    """First and past-the-last index of runs of true flags, also cut where ``split`` and after each SPAN windows.

    Text that repeats an anchor within every window makes runs of any length; cut, each piece has an
    opening window, and the 64 bytes that a scan compares after a window reach the piece's end.
    """
    before = np.concatenate(([False], flags[:-1]))
    after = np.concatenate((flags[1:], [False]))
    first = flags & (~before | split)
    last = flags & (~after | np.concatenate((split[1:], [True])))
    first, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = -(-(end - first) // SPAN)
    begin = np.repeat(first, n) + SPAN * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(begin + SPAN, np.repeat(end, n))


def _ranked(order: np.ndarray) -> np.ndarray:
    return np.unique(order, return_inverse=True)[1].astype(np.int64)


COVER, RUNS = 0, 1
PIECE_TYPE = "bucket int, o long, th long, kind int, data binary"
PIECE_NAMES = ["bucket", "o", "th", "kind", "data"]
PIECE_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _covers(order, th, at, size, buckets):
    """Rows of covered stretches (start in text, length), those that meet made one, one row for each text."""
    if not len(at):
        return []
    sort = np.lexsort((at, th, order))
    order, th, at, size = order[sort], th[sort], at[sort], size[sort]
    other = np.concatenate(([True], (order[1:] != order[:-1]) | (th[1:] != th[:-1])))
    upto = np.maximum.accumulate((np.cumsum(other) << 40) + at + size)
    apart = np.flatnonzero(other | np.concatenate(([True], (np.cumsum(other)[1:] << 40) + at[1:] > upto[:-1])))
    upto = upto[np.concatenate((apart[1:], [len(at)])) - 1] & ((1 << 40) - 1)
    order, th, at, other = order[apart], th[apart], at[apart], other[apart]
    size = upto - at
    cut = np.flatnonzero(np.concatenate((other, [True])))
    return [(int(abs(int(th[a])) % buckets), int(order[a]), int(th[a]), COVER, _packed(at[a:b], size[a:b])) for a, b in zip(cut, cut[1:])]


def _local(buckets):
    def run(batches):
        for chunk, held in chunks(_rows(batches, (0, 1, 2, 3))):
            valid = np.zeros(len(chunk.window), bool)
            for i, part in enumerate(held):
                at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in part[4][3]])) - part[2]
                at = at[(at >= 0) & (at <= len(part[3]) - GRAM)] + chunk.start[i]
                for back in range(SPAN):
                    w = at - back
                    ok = (w >= chunk.start[i]) & (w <= chunk.end[i] - LEAST)
                    w, a = w[ok], at[ok]
                    valid[w[chunk.least[w] == chunk.gram[a]]] = True
            split = np.concatenate(([True], chunk.least[1:] != chunk.least[:-1]))
            split[chunk.start[chunk.start < len(split)]] = True
            first, end = _intervals(valid, split)
            starts = np.flatnonzero(valid)
            sizes = end - first
            opens = np.zeros(len(valid), bool)
            opens[first] = True
            piece = chunk.piece(starts)
            key = (_ranked(chunk.order)[piece] << 40) + starts - chunk.start[piece] + chunk.base[piece]
            at, size = scan(chunk.buffer, chunk.window, starts, opens[starts], np.repeat(end + LEAST - 1, sizes), key)
            piece = chunk.piece(at)
            out = _covers(chunk.order[piece], chunk.th[piece], at - chunk.start[piece] + chunk.base[piece], size, buckets)
            done = np.zeros(len(valid) + 1, np.int32)
            np.add.at(done, at, 1)
            np.add.at(done, at + size - LEAST + 1, -1)
            first, end = _intervals(valid & (np.cumsum(done, dtype=np.int32)[:-1] == 0), split)
            bucket = ((chunk.least[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            first, end, bucket = first[sort], end[sort], bucket[sort]
            piece = chunk.piece(first)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            data = chunk.buffer.tobytes()
            for b in range(buckets):
                some = slice(cut[b], cut[b + 1])
                if cut[b + 1] > cut[b]:
                    p = piece[some]
                    text = b"".join(data[x : y + LEAST - 1] for x, y in zip(first[some].tolist(), end[some].tolist(), strict=True))
                    runs = _packed(chunk.order[p], chunk.th[p], first[some] - chunk.start[p] + chunk.base[p], (end - first)[some], np.frombuffer(text, np.uint8))
                    out.append((b, None, None, RUNS, runs))
            if out:
                yield _batch(PIECE_NAMES, out, PIECE_KINDS)

    return run


def _across(buckets):
    def run(batches):
        for rows in _groups(batches, 0):
            out = [r for r in rows if r[3] == COVER]
            parts = [list(_unpacked(r[4], np.int64, np.int64, np.int64, np.int64, np.uint8)) for r in rows if r[3] == RUNS]
            if parts:
                order, th, at, count, buffer = (np.concatenate(x) for x in zip(*parts, strict=True))
                place = np.cumsum(count + LEAST - 1) - (count + LEAST - 1)
                run_of = np.repeat(np.arange(len(count)), count)
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                starts = place[run_of] + within
                key = (_ranked(order)[run_of] << 40) + at[run_of] + within
                _, window = hashes(buffer)
                found, size = scan(buffer, window, starts, within == 0, (place + count + LEAST - 1)[run_of], key)
                run = np.searchsorted(place, found, "right") - 1
                out += _covers(order[run], th[run], at[run] + found - place[run], size, buckets)
            if out:
                yield _batch(PIECE_NAMES, out, PIECE_KINDS)

    return run


def _cut(batches):
    """(o, th, n_removed, n_spans, kept, kept_sha256) of texts with covered stretches."""
    for batch in batches:
        out = []
        for o, th, text, covers in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
            change = np.zeros(len(text) + 1, np.int32)
            for data in covers:
                at, size = _unpacked(data, np.int64, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + size, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((o, th, int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
        if out:
            yield _batch(["o", "th", "n_removed", "n_spans", "kept", "kept_sha256"], out, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()])


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for each row; ``texts`` adds the bytes that are left."""
    with bounded_batches(docs.sparkSession):
        return _dedup(docs, id_column, text_column, texts)


def _dedup(docs: DataFrame, id_column: str, text_column: str, texts: bool) -> DataFrame:
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("t"))
    rows = rows.select("id", F.coalesce("id", F.lit(LAST)).alias("o"), F.xxhash64("t").alias("th"), "t")
    info = rows.select("id", "o", "th", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    info = written(info, "repeats-texts")
    # whole copies of a text with a smaller id are covered from end to end
    copies = info.filter(F.col("n_bytes") >= LEAST).groupBy("sha").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last")
    copies = info.join(copies, "sha").filter("o > first").select("o", "th", F.lit(True).alias("copy")).distinct()
    asked = rows.select("o", "th", "t").mapInArrow(_ask(buckets), MESSAGE_TYPE)
    found = asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, MESSAGE_TYPE)
    places = found.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(_placed, "o long, th long, at binary")
    places = places.groupBy("o", "th").agg(F.collect_list("at").alias("at"))
    places = written(places.join(copies, ["o", "th"], "left_anti"), "repeats-places")
    held = written(rows.select("o", "th", "t").join(places, ["o", "th"]).dropDuplicates(["o", "th"]), "repeats-held")
    local = held.select("o", "th", "t", "at").mapInArrow(_local(buckets), PIECE_TYPE)
    covers = local.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_across(buckets), PIECE_TYPE)
    covers = covers.groupBy("o", "th").agg(F.collect_list("data").alias("covers"))
    done = held.select("o", "th", "t").join(covers, ["o", "th"]).select("o", "th", "t", "covers")
    done = done.mapInArrow(_cut, "o long, th long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    done = written(done if texts else done.drop("kept"), "repeats-done")
    result = info.join(done, ["o", "th"], "left").join(copies, ["o", "th"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if texts:
        whole = rows.select("o", "th", "t").dropDuplicates(["o", "th"])
        result = result.join(whole, ["o", "th"])
        columns.append(F.when(F.col("copy"), F.lit(b"")).otherwise(F.coalesce("kept", "t")).alias("kept"))
    return result.select(*columns)


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all occurrences (text, start)) of each maximal repeat of a small list of texts: the plain form of the method."""
    suffixes = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])] + [0]
    out, stack = [], []
    for i, depth in enumerate(lcp):
        begin = i
        while stack and stack[-1][0] > depth:
            level, begin = stack.pop()
            group = suffixes[begin : i + 1]
            if level >= least and len({texts[d][s - 1] if s else (d, s) for _, d, s in group}) > 1:
                out.append((level, sorted((d, s) for _, d, s in group)))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))
    return out
