"""Operator 1, SimHash near-dedup: a binary trie of fingerprints joined with itself.

Fingerprints come from word shingles; two fingerprints link when at most ``budget`` bits
differ. 64 bits are cut into ``budget + 2`` blocks, so a linked pair agrees in two blocks at
least: each pair of blocks gives one trie whose top levels (those two blocks) must agree, and
whose subtrees are dealt over the cluster. Inside a subtree pairs of nodes are traversed
together, differing bits add up, and a pair of nodes beyond the budget is pruned. Equal
fingerprints are one class from the start; a subtree emits a spanning forest, never all pairs.

Defined results: a null or wordless text has fingerprint zero and links like any other. A row
with a null id keeps its fingerprint, links with nothing and has a null component. Repeated
rows come out repeated. Different texts of one id are grouped apart, each by its own fingerprint. An empty table gives an empty result. Other columns pass by unread.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, bounded_batches, cells, components, partitions, written

STEP = 1 << 20
#: Rows of one subtree that a task takes at once; larger subtrees are cut into cells.
SUBTREE_LIMIT = 16384
LEAF = 64


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles of ``shingle`` words of the lower-cased text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        pairs = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp, th): fp is the fingerprint's 64 bits as a signed long, th a hash of the text."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x.as_py() if x.is_valid else None, shingle) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column(2)], names=["id", "fp", "th"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("t"), F.xxhash64(text_column).alias("th"))
    return rows.mapInArrow(run, "id long, fp long, th long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of the budget + 2 blocks."""
    n = budget + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(keys: np.ndarray, nodes: list[np.ndarray], bits: int, budget: int):
    """Yields index arrays (i, j) of all pairs below the node pairs that differ in <= budget bits.

    ``keys``: each node's slice sorted. ``nodes``: lo1, hi1, lo2, hi2 arrays of node pairs at the
    root; a node with itself stands for its inner pairs.
    """
    counts: dict[int, np.ndarray] = {}
    stack = [(bits - 1, *nodes, np.zeros(len(nodes[0]), np.int64))]
    while stack:
        bit, a, b, c, d, dist = stack.pop()
        if len(a) > 8192:
            half = len(a) // 2
            stack += [(bit, *(x[s] for x in (a, b, c, d, dist))) for s in (slice(0, half), slice(half, None))]
            continue
        small = ((b - a) * (d - c) <= LEAF) | (bit < 0)
        if small.any():
            lo, n, lo2, n2 = a[small], (b - a)[small], c[small], (d - c)[small]
            total = n * n2
            for at, upto in _runs(total, STEP):
                t = total[at:upto]
                owner = np.repeat(np.arange(at, upto), t)
                k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                i, j = lo[owner] + k // n2[owner], lo2[owner] + k % n2[owner]
                ok = popcount(keys[i] ^ keys[j]) <= budget
                ok &= (i < j) | (lo[owner] != lo2[owner])
                if ok.any():
                    yield i[ok], j[ok]
        rest = ~small
        if not rest.any():
            continue
        a, b, c, d, dist = (x[rest] for x in (a, b, c, d, dist))
        if bit not in counts:
            counts[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        ones = counts[bit]
        m, m2 = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        out = [(a, m, c, m2, dist), (m, b, m2, d, dist), (a, m, m2, d, dist + 1)]
        out.append(tuple(x[~same] for x in (m, b, c, m2, dist + 1)))
        out = [np.concatenate(x) for x in zip(*out)]
        keep = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= budget)
        keep &= ~((out[0] == out[2]) & (out[1] - out[0] < 2))
        if keep.any():
            stack.append((bit - 1, *(x[keep] for x in out)))


def _runs(sizes: np.ndarray, most: int):
    """Slices of ``sizes`` that each add up to about ``most``."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def _squeezed(fps: np.ndarray, pair: int, budget: int) -> tuple[np.ndarray, int]:
    """The bits outside the pair of blocks, packed; their number."""
    own = list(combinations(range(budget + 2), 2))[pair]
    out, width = np.zeros(len(fps), np.uint64), 0
    for k, (first, bits) in enumerate(blocks(budget)):
        if k not in own:
            out |= ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)) << np.uint64(width)
            width += bits
    return out, width


def _subtrees(table: pa.Table, budget: int):
    """Spanning links (node a, node b) of the whole cells in ``table``."""
    col = {k: table.column(k).to_numpy() for k in ("pair", "key", "cell", "side", "fp", "node")}
    for pair in np.unique(col["pair"]):
        at = np.flatnonzero(col["pair"] == pair)
        keys, bits = _squeezed(col["fp"][at].view(np.uint64), int(pair), budget)
        order = np.lexsort((keys, col["side"][at], col["cell"][at], col["key"][at]))
        at, keys = at[order], keys[order]
        key, cell, side, node = (col[k][at] for k in ("key", "cell", "side", "node"))
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True])))
        lo, hi = cut[:-1], cut[1:]
        ones = np.concatenate(([0], np.cumsum(side)))
        mid = hi - (ones[hi] - ones[lo])
        two = mid < hi  # both sides: pairs across; else a node with itself
        lo2 = np.where(two, mid, lo)
        hi1 = np.where(two, mid, hi)
        keep = (hi1 > lo) & (two | (hi1 - lo > 1))
        forest = Forest(len(keys))
        for i, j in trie_pairs(keys, [x[keep] for x in (lo, hi1, lo2, hi)], bits, budget):
            forest.link(i, j)
        linked = np.flatnonzero(forest.root != np.arange(len(keys)))
        if len(linked):
            yield node[linked], node[forest.root[linked]]


def links(classes: DataFrame, budget: int = 4, limit: int = SUBTREE_LIMIT) -> DataFrame:
    """(a, b): links that join all nodes of ``classes`` (fp, node; fp distinct) within ``budget`` bits, as forests."""
    cut = blocks(budget)

    def block(k):
        first, bits = cut[k]
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)), bits

    tops = []
    for k, (i, j) in enumerate(combinations(range(budget + 2), 2)):
        (x, bits), (y, _) = block(i), block(j)
        tops.append(F.struct(F.lit(k).alias("pair"), F.shiftleft(y, bits).bitwiseOR(x).alias("key")))
    rows = classes.select("fp", "node", F.explode(F.array(*tops)).alias("t")).select("t.pair", "t.key", "fp", "node")
    rows = cells(rows, ["pair", "key"], limit, "fp")

    def run(batches):
        held, n = [], 0
        schema = None
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            schema = batch.schema
            if n >= 8 * limit:
                table = pa.Table.from_batches(held)
                tail = table.slice(n - 1)
                same = np.ones(n, bool)
                for k in ("pair", "key", "cell"):
                    same &= table.column(k).to_numpy() == tail.column(k).to_numpy()[0]
                last = n - int(same.sum())
                if last:
                    yield from out(table.slice(0, last))
                    table = table.slice(last).combine_chunks()
                held, n = table.to_batches(), table.num_rows
        if held:
            yield from out(pa.Table.from_batches(held, schema))

    def out(table):
        for a, b in _subtrees(table, budget):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    spark = classes.sparkSession
    order = ["pair", "key", "cell"]
    return rows.repartition(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, budget: int = 4
) -> DataFrame:
    """(id, fp, component, th, group): the component is the smallest id reachable over links, the row's own included.

    ``group`` names the linked fingerprints (null ids have none); ``th`` is a hash of the row's text.
    """
    with bounded_batches(docs.sparkSession):
        prints = written(fingerprints(docs, id_column, text_column, shingle), "simhash")
    classes = written(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    # a fingerprint names its class: one id may hold several texts
    linked = written(components(links(classes.select("fp", F.col("fp").alias("node")), budget), "simhash-links"), "simhash-groups")
    label = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    first = label.join(linked.select("component").distinct(), F.col("group") == F.col("component"), "left_semi").groupBy("group").agg(F.min("least").alias("first"))
    label = label.join(first, "group", "left").select("fp", "group", F.coalesce("first", "least").alias("component"))
    known = F.col("id").isNotNull()
    return prints.join(label, "fp", "left").select(
        "id", "fp", F.when(known, F.col("component")).alias("component"), "th", F.when(known, F.col("group")).alias("group")
    )
