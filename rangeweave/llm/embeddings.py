"""Operator 7, embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised; a table's hash is ``k`` quantised Gaussian projections, floor((a.x + b) / w).
k grows with the logarithm of the number of vectors, so that unrelated vectors per bucket stay
about constant, and the number of tables follows from k and the wanted recall of a pair just at
the threshold. Equal vectors are one class with a multiplicity from the start. Within a bucket
cosines are exact, in double precision, on the vectors as given; a pair that meets in several
tables counts in the first of them. Buckets send counts and a spanning forest, never pairs; large
buckets are cut into cells.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links
with nothing, and neither does a row with a null id (its component is null). Vectors of different
lengths never link. Rows repeated in full are vectors of their own: they link with each other. Vectors of
one id are counted apart, each by its own links. Vectors are scaled by powers of two, so huge and tiny
components neither overflow nor vanish.
An empty table gives an empty result. Only id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, cells, components, partitions, written

WIDTH = 3.0
#: Unrelated vectors that a bucket should hold on average.
STRANGERS = 64
RECALL = 0.995
BUCKET_LIMIT = 2048
BLOCK = 1024
ROWS = 64


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points of this distance into one bin."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def design(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2.0))
    k = max(4, math.ceil(math.log(max(n, STRANGERS) / STRANGERS) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


_DRAWN: dict = {}


def _projections(seed: int, dim: int, n: int):
    """The Gaussian directions, shifts and mixing factors; drawn once in a process."""
    if (seed, dim, n) not in _DRAWN:
        rng = np.random.default_rng([seed, dim])
        a, b = rng.standard_normal((dim, n)), rng.uniform(0, WIDTH, n)
        _DRAWN[seed, dim, n] = a, b, rng.integers(1, 2**63 - 1, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    return _DRAWN[seed, dim, n]


def signatures(x: np.ndarray, k: int, tables: int, seed: int = 7) -> np.ndarray:
    """(rows, tables) 64-bit bucket hashes of normalised rows; the same on every machine."""
    dim = x.shape[1]
    a, b, mix = _projections(seed, dim, tables * k)
    bins = np.empty((len(x), tables * k), np.uint64)
    for at in range(0, len(x), ROWS):
        # blocks of one shape: the order of a sum, and so its last bit, must not depend on how many rows come at once
        block = np.zeros((ROWS, dim))
        some = x[at : at + ROWS]
        block[: len(some)] = some
        bins[at : at + ROWS] = np.floor((block @ a + b) / WIDTH)[: len(some)].astype(np.int64).astype(np.uint64)
    bins *= mix
    bins ^= bins >> np.uint64(29)
    bins *= np.uint64(0xBF58476D1CE4E5B9)
    bins ^= bins >> np.uint64(32)
    return (bins.reshape(len(x), tables, k).sum(axis=2, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows in double precision, each scaled by a power of two, which changes no cosine and keeps squares in range."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("rd,rd->r", x, x))[:, None]


def hashed(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """(t, bucket, node, n, v) from (node, n, v): one row for each table."""

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                for at in range(0, part.num_rows, 2048):
                    piece = part.slice(at, 2048)
                    found = signatures(_normal(_matrix(piece.column(2), int(dim))), k, tables)
                    for t in range(tables):
                        yield pa.record_batch(
                            [pa.array(np.full(piece.num_rows, t, np.int32)), pa.array(found[:, t]), *piece.columns],
                            names=["t", "bucket", "node", "n", "v"],
                        )

    return vectors.select("node", "n", "v").mapInArrow(run, f"t int, bucket long, node long, n long, v {vectors.schema['v'].dataType.simpleString()}")


def _bucket(x, v, n, side, alone, t, k, tables, threshold):
    """``x``: ``v`` with unit rows. ``alone``: the cell is one chunk, whose inner pairs count; else pairs across its two sides do.

    (gains, links): for node indexes the number of vectors linked, and pairs of indexes of a spanning forest; None if nothing is near."""
    gains, forest = np.zeros(len(x), np.int64), None
    cut = int((side == 0).sum())
    own: dict[int, np.ndarray] = {}

    def sign(rows):
        lacking = [r for r in rows if r not in own]
        if lacking:
            for r, s in zip(lacking, signatures(x[lacking], k, tables)[:, :t], strict=True):
                own[r] = s
        return np.array([own[r] for r in rows])

    for a in range(0, cut, BLOCK):
        for b in range(a if alone else cut, len(x), BLOCK):
            i, j = np.nonzero(x[a : min(a + BLOCK, cut)] @ x[b : b + BLOCK].T >= threshold - 1e-9)
            i, j = i + a, j + b
            keep = i < j
            i, j = i[keep], j[keep]
            if len(i) and forest is None:
                forest = Forest(len(x))
            for s in range(0, len(i), 65536):
                p, q = i[s : s + 65536], j[s : s + 65536]
                exact = np.einsum("rd,rd->r", v[p], v[q]) / (np.sqrt(np.einsum("rd,rd->r", v[p], v[p])) * np.sqrt(np.einsum("rd,rd->r", v[q], v[q])))
                p, q = p[exact >= threshold], q[exact >= threshold]
                if t and len(p):
                    rows, back = np.unique(np.concatenate((p, q)), return_inverse=True)
                    seen = sign(rows.tolist())
                    first = ~(seen[back[: len(p)]] == seen[back[len(p) :]]).any(axis=1)
                    p, q = p[first], q[first]
                np.add.at(gains, p, n[q])
                np.add.at(gains, q, n[p])
                forest.link(p, q)
    if forest is None:
        return None
    linked = np.flatnonzero(forest.root != np.arange(len(x)))
    return gains, linked, forest.root[linked]


def links(buckets: DataFrame, k: int, tables: int, threshold: float, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b, gain): b is null in rows that count a's linked vectors, else a link of a spanning forest."""
    rows = cells(buckets, ["t", "bucket"], limit, "node")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = [held.column(c).to_numpy() for c in ("t", "bucket", "cell")]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            if len(change):
                yield from groups(held.slice(0, int(change[-1])), change[:-1])
                held = held.slice(int(change[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield from groups(held, np.array([], np.int64))

    def groups(table, change):
        """One batch for all groups of ``table``: columns become arrays once, groups are slices of them."""
        borders = np.array([0, *change.tolist(), table.num_rows])
        column = table.column("v").combine_chunks()
        node, n, side, alone, t = (table.column(c).to_numpy() for c in ("node", "n", "side", "alone", "t"))
        sizes, group = np.asarray(column.value_lengths()), np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        order = np.lexsort((side, group, sizes))
        out: list[list] = [[], [], [], []]
        for dim in np.unique(sizes):
            at = order[sizes[order] == dim]
            v = _matrix(column.take(pa.array(at)), int(dim))
            x = _normal(v)
            node_, n_, side_, group_ = node[at], n[at], side[at], group[at]
            cut = np.flatnonzero(np.concatenate(([True], group_[1:] != group_[:-1], [True])))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if hi - lo > 1:
                    own = slice(lo, hi)
                    found = _bucket(x[own], v[own], n_[own], side_[own], bool(alone[at[lo]]), int(t[at[lo]]), k, tables, threshold)
                    if found is not None:
                        gains, first, second = found
                        some = np.flatnonzero(gains)
                        for into, values in zip(out, (node_[own][some], gains[some], node_[own][first], node_[own][second]), strict=True):
                            into.append(values)
        if out[0]:
            who, gain, first, second = map(np.concatenate, out)
            a, b = np.concatenate((who, first)), np.concatenate((np.zeros(len(who), np.int64), second))
            gain = np.concatenate((gain, np.zeros(len(first), np.int64)))
            yield pa.record_batch([pa.array(a), pa.array(b, mask=np.arange(len(a)) < len(who)), pa.array(gain)], names=["a", "b", "gain"])

    order = ["t", "bucket", "cell"]
    dealt = rows.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long, gain long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(id, n_links, component) for each row of ``vectors``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    # components travel as given, in four bytes where that is what they are; all sums are in double precision
    given = vectors.schema[vector_column].dataType.simpleString()
    v = F.col(vector_column).cast(given if given in ("array<float>", "array<double>") else "array<double>")
    fit = F.col(id_column).isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(F.coalesce(fit, F.lit(False)), v).alias("v"))
    rows = written(rows.withColumn("h", F.xxhash64("v")), "vectors")
    classes = rows.filter("v is not null").groupBy("h", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # a number of its own for each distinct vector: one id may hold several
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    k, tables = design(classes.count(), threshold, recall)
    found = written(links(hashed(classes, k, tables), k, tables, threshold), "vector-links")
    gains = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("gain").alias("gain"))
    reach = components(found.filter("b is not null").select("a", "b"), "vector-components")
    reach = written(reach.join(classes.select("node", "least"), "node"), "vector-reach")
    first = reach.groupBy("component").agg(F.min("least").alias("first"))
    reach = reach.join(first, "component").select("node", "first")
    label = classes.join(gains, "node", "left").join(reach, "node", "left")
    label = label.select("h", "v", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component"))
    return rows.join(label, ["h", "v"], "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
