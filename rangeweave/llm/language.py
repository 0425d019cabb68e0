"""Operator 2, language ID: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (n = 1..3) after lower-casing, with everything that ASCII
doesn't count as a letter made one blank. The kernel of two texts is the mean over n of the cosine of
their presence vectors over the grams that any landmark holds. Landmarks and training texts are
a bounded sample of the labelled rows (``sample`` texts in all, spread evenly over languages, none
over ``longest`` bytes, chosen by a hash of the id); the rest covers every row and whole texts.
Scores are products of batches: presence rows by (landmark presence x ridge weights).

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when nothing is
learned (an empty table, no labels). Rows with a null id are scored; as training rows a null id
counts as the empty text. Repeated rows get equal answers. Only id, text and label are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, small, written

ORDERS = (1, 2, 3)
OFFSETS = (0, 1 << 8, (1 << 8) + (1 << 16))
SIZE = (1 << 8) + (1 << 16) + (1 << 24)
PIECE = 1 << 20
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: bytes | None) -> bytes | None:
    """Lower-cased bytes with blanks for non-letters; None if there is no letter."""
    word = (text or b"").decode("utf-8", "replace")
    if not any(c.isalpha() for c in word):
        return None
    return b" " + word.lower().encode("utf-8", "replace").translate(_BLANK) + b" "


def codes(data: bytes):
    """The codes of all n-grams, in pieces."""
    for at in range(0, len(data), PIECE):
        x = np.frombuffer(data[max(0, at - 2) : at + PIECE], np.uint8).astype(np.int32)
        yield x
        two = (x[:-1] << 8) | x[1:]
        yield two + OFFSETS[1]
        yield ((two[:-1] << 8) | x[2:]) + OFFSETS[2]


@dataclass
class Model:
    """grams: sorted codes of the dictionary; weights: (grams, languages); languages in order."""

    grams: np.ndarray
    weights: np.ndarray
    languages: list[str]
    landmarks: int = 0

    def lookup(self) -> np.ndarray:
        table = np.full(SIZE, len(self.grams), np.uint16 if len(self.grams) < 65535 else np.int32)
        table[self.grams] = np.arange(len(self.grams))
        return table

    def blocks(self) -> list[slice]:
        cuts = np.searchsorted(self.grams, [*OFFSETS, SIZE])
        return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def presence(texts: list[bytes], table: np.ndarray, blocks: list[slice], width: int) -> np.ndarray:
    """Rows whose products are kernels: 0/1 by gram, each order scaled to unit length, orders equal in weight."""
    rows = np.zeros((len(texts), width + 1), np.float32)
    for row, text in zip(rows, texts, strict=True):
        for c in codes(text):
            row[table[c]] = 1
    rows = rows[:, :width]
    for block in blocks:
        part = rows[:, block]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(blocks))
    return rows


def fit(texts: list[bytes], labels: list[str], landmarks: int = 160, ridge: float = 0.1) -> Model:
    """Kernel ridge regression on the Nystroem features of evenly spread landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), [])
    order = sorted(range(len(texts)), key=lambda i: labels[i])
    turn: dict[str, int] = {}
    rank = []
    for i in order:
        turn[labels[i]] = turn.get(labels[i], -1) + 1
        rank.append((turn[labels[i]], i))
    chosen = [i for _, i in sorted(rank)[:landmarks]]
    grams = np.unique(np.concatenate([np.unique(c) for i in chosen for c in codes(texts[i])]))
    model = Model(grams, np.zeros((len(grams), len(languages)), np.float32), languages, len(chosen))
    table, blocks = model.lookup(), model.blocks()
    z = presence([texts[i] for i in chosen], table, blocks, len(grams))
    k = np.concatenate([presence(texts[at : at + 64], table, blocks, len(grams)) @ z.T for at in range(0, len(texts), 64)]).astype(float)
    values, vectors = np.linalg.eigh(z.astype(float) @ z.T.astype(float))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    phi = k @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1 / np.sqrt((y > 0).sum(axis=0))[np.argmax(y, axis=1)][:, None]
    a, b = phi * weight, y * weight
    ridged = np.linalg.solve(a.T @ a + ridge * np.mean(weight**2) * np.eye(phi.shape[1]), a.T @ b)
    model.weights = (z.T.astype(float) @ (root @ ridged)).astype(np.float32)
    return model


def train(rows: DataFrame, id_column: str, text_column: str, label_column: str, sample: int = 1200, longest: int = 1 << 18) -> Model:
    """A model from labelled ``rows``; see the module's text for the sample."""
    text = F.col(text_column).cast("binary")
    rows = rows.filter(F.col(label_column).isNotNull()).select(F.col(label_column).alias("label"), text.alias("t"), F.xxhash64(F.lit("sample"), F.col(id_column)).alias("h"))
    rows = rows.filter(F.octet_length("t") <= longest)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = max(1, sizes.count())
    each = max(8, sample // labels)
    near = F.pmod(F.col("h"), F.lit(1 << 20)) * F.col("n") < 1.5 * (each + 20) * (1 << 20)
    few = rows.join(small(sizes), "label").filter(near)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h", "t"))).filter(F.col("r") <= each)
    found = [(letters(bytes(r["t"])), r["label"]) for r in few.orderBy("label", "r").select("t", "label").toLocalIterator()]
    found = [(t, label) for t, label in found if t]
    return fit([t for t, _ in found], [label for _, label in found])


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) and the columns ``keep``, for each row of ``docs``."""

    def run(batches):
        table, blocks = model.lookup(), model.blocks()
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 128):
                texts = [letters(x) for x in batch.column(1).slice(at, 128).to_pylist()]
                own = [t for t in texts if t] if model.languages else []
                if own:
                    found = presence(own, table, blocks, len(model.grams)) @ model.weights
                    best, top = found.argmax(axis=1), np.clip((found.max(axis=1).astype(float) + 1) / 2, 0, 1)
                    answers = iter(zip(best.tolist(), top.tolist(), strict=True))
                for t in texts:
                    i, s = next(answers) if own and t else (None, 0.0)
                    names.append("und" if i is None else model.languages[i])
                    scores.append(s)
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", *keep, "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("t"), *keep)
    fields = [f"id {rows.schema['id'].dataType.simpleString()}", *[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep]]
    with bounded_batches(docs.sparkSession):
        return written(rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"])), "languages")
