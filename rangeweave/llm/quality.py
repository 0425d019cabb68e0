"""Operator 8, quality: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. A passage is encoded from the
square roots of its byte and hashed byte-pair frequencies and the share of distinct pairs; gated attention
weighs the encodings, and a logistic unit scores their weighted mean. Encoder, attention and
score are trained together from document labels alone, by gradient descent with momentum terms.

The training sample is bounded: ``each`` documents of each label, none over ``longest`` bytes,
chosen by a hash of the id. Classes are equal in the sample; the score is shifted back to the
labels' shares in all training rows. Every row is scored on its whole text.

Defined results: null and empty texts are one passage of no bytes. Rows with a null id are scored.
With no labels of either kind, or of one kind only, every score is that label's share (0.5 with
none). Repeated rows get equal scores. Only id and text, and the labels' id and quality, are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

PASSAGE, PAIRS = 1024, 512
FEATURES = 256 + PAIRS + 2
HIDDEN, GATES = 24, 12
CHUNK = 1 << 20


def passages(text: bytes) -> np.ndarray:
    """(passages, FEATURES) of one text."""
    out = []
    for at in range(0, max(1, len(text)), CHUNK):
        x = np.frombuffer(text[at : at + CHUNK], np.uint8).astype(np.int64)
        n = max(1, -(-len(x) // PASSAGE))
        where = np.arange(len(x)) // PASSAGE
        size = np.maximum(np.bincount(where, minlength=n), 1)[:, None]
        one = np.bincount(where * 256 + x, minlength=n * 256).reshape(n, 256)
        code = ((x[:-1] << 8) | x[1:]) if len(x) else x
        pair = np.bincount(where[:-1] * PAIRS + (code * 40503 >> 7) % PAIRS, minlength=n * PAIRS).reshape(n, PAIRS)
        kinds = (pair > 0).sum(axis=1, keepdims=True) / np.sqrt(size)
        out.append(np.concatenate((np.sqrt(one / size), np.sqrt(pair / size), kinds, np.log1p(size) / 7), axis=1).astype(np.float32))
    return np.concatenate(out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, mean, scale, parameters, shift, constant=None):
        self.mean, self.scale, self.p, self.shift, self.constant = mean, scale, parameters, shift, constant

    def forward(self, x, starts, bag):
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        a, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (a * g) @ p["q"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        e /= np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(h * e[:, None], starts)
        return x, h, a, g, e, z, z @ p["c"] + p["d"][0]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts, bag = _layout(bags)
        return _sigmoid(self.forward(np.concatenate(bags), starts, bag)[-1].astype(float) + self.shift)


def _layout(bags):
    sizes = [len(b) for b in bags]
    return np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(bags)), sizes)


def fit(bags: list[np.ndarray], labels: np.ndarray, prior: float, rounds: int = 40, step: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(None, None, None, 0.0, float(labels[0]) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), 1 / (every.std(axis=0) + 0.01)
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATES), "u": normal(HIDDEN, GATES), "q": normal(GATES), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(mean, scale, p, 0.0)
    first, second, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            own = [bags[i] for i in some]
            starts, bag = _layout(own)
            x, h, a, g, e, z, s = model.forward(np.concatenate(own), starts, bag)
            ds = (_sigmoid(s) - labels[some]) / len(some)
            dz = ds[:, None] * p["c"]
            back = (h * dz[bag]).sum(axis=1)
            de = e * (back - np.add.reduceat(e * back, starts)[bag])
            da, dg = de[:, None] * p["q"] * g * (1 - a * a), de[:, None] * p["q"] * a * g * (1 - g)
            dh = (e[:, None] * dz[bag] + da @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            grads = {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ da, "u": h.T @ dg, "q": (a * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}
            t += 1
            for k, v in grads.items():
                v = v + decay * p[k]
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    even = float(labels.mean())
    model.shift = np.log(prior / (1 - prior)) - np.log(even / (1 - even))
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", each: int = 600, longest: int = 1 << 17) -> Model:
    """A model from ``labels`` (id, label 0 or 1) of ``docs``; see the module's text for the sample."""
    rows = labels.filter(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("i"), F.col(label_column).cast("int").alias("y")).dropDuplicates(["i"])
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(1.5 * (each + 20) / n)) for y, n in counts.items()], F.lit(0.0))
    h = F.xxhash64(F.lit("sample"), "i")
    few = rows.withColumn("h", h).filter(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("r") <= each)

    def run(batches):
        for batch in batches:
            found = [passages(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["y", "h", "f"])

    text = docs.select(F.col(id_column).alias("i"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("t")).filter(F.octet_length("t") <= longest)
    bags = text.join(F.broadcast(few), "i").select("t", "y", "h").mapInArrow(run, "y int, h long, f binary")
    found = sorted(((r["h"], r["y"], bytes(r["f"])) for r in bags.toLocalIterator()), key=lambda x: x)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([np.frombuffer(f, np.float32).reshape(-1, FEATURES) for _, _, f in found], np.array([y for _, y, _ in found], np.float32), prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            found, held, size = [], [], 0
            for x in batch.column(1):
                held.append(passages(x.as_py()))
                size += len(held[-1])
                if size >= 1024:
                    found.append(model.score(held))
                    held, size = [], 0
            if held:
                found.append(model.score(held))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("t"))
    with bounded_batches(docs.sparkSession):
        return written(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double"), "qualities")
