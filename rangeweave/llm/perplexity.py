"""Operator 5, LM scoring: a hierarchical Pitman-Yor model seated by Gibbs sampling.

Tokens are lower-cased words and one end a text. The chain of restaurants of a token is: the word before it
(each word of the training texts has a restaurant of its own, however rare, and so has the beginning of texts),
that word's class (its last two bytes, 64 classes), and one restaurant for all; its base is uniform over the
training words and one unknown. A table of a restaurant is a customer of its parent.

The state is the number of tables of each dish in each restaurant. A sweep draws every dish's number from
its conditional given all others (:mod:`.seating`): the seats of all its customers at once, frequent dishes
included. From one sweep to the next the state stays. Dishes of one sweep are drawn side by side, given
the totals of the sweep before. Each draw has a random number of its own, from a hash of sweep, restaurant and
word, so neither partitions nor chunks change a score. Probabilities are averaged over the
sweeps after ``BURN``. Discounts come from counts of counts (at most 0.9), strengths are 1.

Texts send hash buckets of words their distinct (word, word before, text) with frequency, packed. For learning, a
chunk sends its pairs with training and held-out counts only; a bucket counts exactly and keeps its pairs, and what it was
sent goes. In a sweep a bucket reads its pairs, sends shards of names (ranges) its tables' sums for each word before,
packed, and gets back everyone's with its own state; where no dish of a word before has two customers, each has its one
table for good, and the first sums stay. Texts are dealt a second time to be scored; ``docs`` must give the
same rows in the same partitions each time that it is read, as files do. The number of buckets follows from the
bytes of text (``BUCKET``). Words that make more than 1/``HOT_SHARE`` of the tokens of a bounded sample of texts (it decides on
dealing alone, no count or score) are dealt over all buckets by the word before; the driver draws their parents'
tables, at most ``HOT`` words by 64 classes. Words and contexts are told apart by 64 and 40 bits of a hash.

Defined results: null texts have one token, their end. Training rows are those whose crc32 of the id (null:
the empty text) mod ``folds`` is not 0. With no training rows all tokens are unknown. Rows repeated in full
come out repeated, with equal scores, and count as often in training. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, dealt_out, drop_written, give_back, partitions, released, written
from .seating import draw

CLASSES = 64
CHUNK, CHUNK_DOCS = 6 << 20, 60000
#: Bytes of text in a bucket, and the slices of its words that a worker takes one after the other.
BUCKET, SLICES = 16 << 20, 4
HOT, HOT_SHARE, HOT_TEXTS = 512, 1000, 4096
BURN, SAMPLES = 1, 2
STRENGTH = 1.0
END = xxhash.xxh64_intdigest(b"\n")
#: The name of the beginning as the word before.
BEGIN = 1
_NAME = (1 << 40) - 1
_WHITE = b" \t\n\r\x0b\x0c"
NAMES = ["bucket", "chunk", "kind", "data"]
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
TYPE = "bucket int, chunk long, kind int, data binary"
ASK, META, SUMS = 0, 1, 2
#: Rows that a bucket sends: numbers to add up, words with training counts, words before (both to a shard of names, ``u``),
#: hot words' customers, the tables after a sweep, a slice's pairs.
NUMBERS, WORDS, BEFORE, PARENTS, STATE, PAIRS = 0, 1, 2, 3, 4, 5
SENT = "kind int, bucket int, u long, c long, v array<double>, s binary"
#: Rows that come back to a bucket: a state's number, or one of these.
ANSWER, KEPT = -1, -2
BACK = "bucket int, u long, s binary"
#: Buckets for each shard of names.
SHARE = 2


def _packed(*arrays) -> bytes:
    """Arrays of whole numbers, unsigned ones in as few bytes as they need."""
    parts = []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "ui" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        parts += [a.dtype.char.encode(), np.int64(len(a)).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 1].decode()), int(np.frombuffer(raw, np.int64, 1, at + 1)[0])
        out.append(np.frombuffer(raw, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


def _named(names: np.ndarray) -> tuple:
    """Sorted names as the first and the steps from each to the next, for :func:`_packed`."""
    return names[:1], np.diff(names)


def _names(first: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((first, more)).astype(np.int64))


def _batch(names, rows, kinds):
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _mixed(a: np.ndarray, *more) -> np.ndarray:
    x = a.astype(np.uint64)
    for b in (*more, np.uint64(0x9E3779B97F4A7C15)):
        x = (x ^ np.asarray(b).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _uniform(word: np.ndarray, restaurant, sweep: int) -> np.ndarray:
    """A number in (0, 1) for each dish and sweep."""
    return ((_mixed(word, np.asarray(restaurant), np.uint64(sweep)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def pieces(text: bytes):
    """(piece, is last) of a text, cut at white space about every CHUNK bytes."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and text[cut] not in _WHITE:
            cut += 1
        yield text[at:cut], False
        at = cut
    yield text[at:], True


def classes(words: pa.Array) -> np.ndarray:
    """The class of each word, by its last two bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    one = data[ends[1:] - 1].astype(np.uint64)
    two = np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.uint64)
    return 1 + (_mixed(one << np.uint64(8) | two) % np.uint64(CLASSES - 1)).astype(np.int64)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat = split.flatten()
    some = pc.not_equal(flat, "")
    upto = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
    return flat.filter(some), np.diff(upto[ends])


def _chunks(batches):
    """Lists of (text, id, train, row, is last): pieces of rows, ``row`` numbers the partition's rows."""
    held, size, number = [], 0, 0
    for batch in batches:
        for row, train, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for piece, last in pieces(text):
                held.append((piece, row, train, number, last))
                size += len(piece)
                if size >= CHUNK or len(held) >= CHUNK_DOCS:
                    yield held
                    held, size = [], 0
            number += 1
    if held:
        yield held


def asked(docs, name: int, buckets: int, hot: np.ndarray, before: bytes = b"", scoring: bool = True):
    """(rows of messages, last word) for one chunk; ``before`` is the word before its first piece where that goes on with a text.

    Unless ``scoring``, the chunk's held-out and its training texts are sent as if they were one document each.
    """
    words, n_words = tokens(pa.array([d[0] for d in docs], pa.binary()))
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    last = np.array([d[4] for d in docs], np.int64)
    counts = n_words + last
    doc = np.repeat(np.arange(len(docs)), counts)
    ends = np.cumsum(counts)[last > 0] - 1
    ids = np.zeros(int(counts.sum()), np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    ids[inner] = coded.indices.to_numpy() + 1
    del words, inner
    u = np.concatenate(([0], ids[:-1])) if len(ids) else ids
    begins = np.cumsum(counts) - counts
    u[begins[counts > 0]] = 0
    extra = [before] if before else []

    def word_before(k: int) -> int:
        """The word before piece ``k``, which goes on with the text of the piece before it; 0 at a text's beginning."""
        while k and not last[k - 1]:
            k -= 1
            if counts[k]:
                return int(ids[begins[k] + counts[k] - 1])
        return len(vocabulary) + 1 if before and k == 0 else 0

    for k in [0, *(np.flatnonzero(last[:-1] == 0) + 1)]:
        if counts[k]:
            u[begins[k]] = word_before(k)
    end = word_before(len(docs))
    end = (vocabulary + extra)[end - 1] if end else b""
    digest = np.array([END, *[xxhash.xxh64_intdigest(w) for w in vocabulary], *[xxhash.xxh64_intdigest(w) for w in extra]], np.uint64)
    kinds = np.concatenate([np.zeros(1, np.int64), *[classes(x) for x in (coded.dictionary.cast(pa.binary()), pa.array(extra, pa.binary())) if len(x)]])
    names = (digest & np.uint64(_NAME)).astype(np.int64)
    names[0] = BEGIN
    order = np.argsort(digest)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    digest = digest[order]
    train = np.array([d[2] for d in docs], np.uint8)
    folds, n_docs = train, len(docs)
    if not scoring:
        doc, folds, n_docs = train[doc].astype(np.int64), np.array([0, 1], np.uint8), 2
    wide, deep = len(kinds).bit_length(), n_docs.bit_length()
    key, tf = np.unique((rank[ids] << wide | u) << deep | doc, return_counts=True)
    del ids
    pair, doc = key >> deep, key & ((1 << deep) - 1)
    del key
    word, u = pair >> wide, pair & ((1 << wide) - 1)
    bucket = ((digest >> np.uint64(32)).astype(np.int64) * buckets >> 32)[word]
    spread = np.isin(digest, hot)[word]
    bucket[spread] = (_mixed(digest[word[spread]], names[u[spread]]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    if scoring:
        head = _packed(np.array([d[1] is not None for d in docs], np.uint8), np.array([d[1] or 0 for d in docs], np.int64), np.array([d[3] for d in docs], np.int64), counts, last, train)
        rows.append((name % buckets, name, META, head))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        w, v, p = word[at], u[at], pair[at]
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        begins = np.flatnonzero(np.concatenate(([True], w[first][1:] != w[first][:-1])))
        own, which = np.unique(v[first], return_inverse=True)
        sizes = lambda cut, n: np.diff(np.concatenate((cut, [n])))
        name_ = names[own]
        rows.append(
            (int(b), name, ASK, _packed(digest[w[first][begins]], sizes(begins, len(first)), (name_ & 0xFFFFFFFF).astype(np.uint32), (name_ >> 32).astype(np.uint8), kinds[own], which, sizes(first, len(at)), doc[at], tf[at], np.packbits(folds), np.array([n_docs])))
        )
    return rows, end


def _ask(labels: np.ndarray, hot: np.ndarray, scoring: bool):
    buckets = len(labels)

    def run(batches):
        part, before = TaskContext.get().partitionId(), b""
        for number, docs in enumerate(_chunks(batches)):
            rows, before = asked(docs, part << 32 | number, buckets, hot, before, scoring)
            if rows:
                yield _batch(NAMES, [(int(labels[r[0]]), *r[1:]) for r in rows], KINDS)
            del rows, docs
            give_back()

    return run


class Bucket:
    """A bucket's messages with the exact training counts of its pairs (word, word before)."""

    def __init__(self, messages, hot: np.ndarray, part: int = 0, parts: int = 1):
        self.part, self.chunks, self.docs = part, [], []
        digests, names, classes, docs, tfs, pairs, trained = [], [], [], [], [], [], []
        first = 0
        for chunk, data in messages:
            digest, sizes, low, high, kinds, which, entries, doc, tf, train, n = _unpacked(data)
            n = int(n[0])
            if parts > 1:
                mine = (digest >> np.uint64(9)) % np.uint64(parts) == part
                pair = np.repeat(mine, sizes)
                entry = np.repeat(pair, entries)
                digest, sizes, which, entries, doc, tf = digest[mine], sizes[mine], which[pair], entries[pair], doc[entry], tf[entry]
            name = high.astype(np.int64) << 32 | low
            digests.append(np.repeat(digest, sizes))
            names.append(name[which])
            classes.append(kinds[which].astype(np.uint8))
            pairs.append(entries)
            docs.append(doc.astype(np.int32) + np.int32(first))
            tfs.append(tf)
            trained.append(np.unpackbits(train)[:n].astype(bool)[doc])
            self.chunks.append(chunk)
            self.docs.append(n)
            first += n
        digests, names, classes = map(np.concatenate, (digests, names, classes))
        self.digest, w = np.unique(digests, return_inverse=True)
        del digests
        self.name, u = np.unique(names, return_inverse=True)
        kind = np.zeros(len(self.name), np.uint8)
        kind[u] = classes
        wide = len(self.name).bit_length()
        key, at = np.unique(w << wide | u, return_inverse=True)
        self.pair = np.repeat(at.astype(np.int32), np.concatenate(pairs))
        self.doc, self.tf = np.concatenate(docs), np.concatenate(tfs)
        self.word, self.u = key >> wide, key & ((1 << wide) - 1)
        self.c = np.bincount(self.pair, weights=self.tf * np.concatenate(trained), minlength=len(key)).astype(np.int64)
        self._restaurants(kind, hot)

    def _restaurants(self, kind: np.ndarray, hot: np.ndarray) -> None:
        self.kind, self.klass = kind, kind[self.u].astype(np.int64)
        #: dishes of the classes' restaurants
        parents, self.parent = np.unique(self.word * CLASSES + self.klass, return_inverse=True)
        self.parent_word, self.parent_class = np.divmod(parents, CLASSES)
        place = np.searchsorted(hot, self.digest)
        place[place == len(hot)] = 0
        self.hot = np.where(hot[place] == self.digest, place, -1)

    def packed(self) -> bytes:
        """The pairs with their counts, without the documents that they stand in."""
        return _packed(self.digest, *_named(self.name), self.kind, np.bincount(self.word, minlength=len(self.digest)), self.u, self.c)

    @classmethod
    def of_pairs(cls, data: bytes, hot: np.ndarray, part: int) -> Bucket:
        b = cls.__new__(cls)
        b.part = part
        b.digest, first, more, kind, sizes, u, c = _unpacked(data)
        b.name, b.u, b.c = _names(first, more), u.astype(np.int64), c.astype(np.int64)
        b.word = np.repeat(np.arange(len(sizes)), sizes)
        b.digest = b.digest.astype(np.uint64)
        b._restaurants(kind, hot)
        return b

    def word_counts(self):
        return np.bincount(self.word, weights=self.c, minlength=len(self.digest)).astype(np.int64)


def _of_counts(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9)) if n1 + n2 else 0.5


class Totals:
    """What the restaurants share after each sweep: plain numbers, and the hot words' own tables.

    ``customers`` and ``tables`` by class, ``roots`` = (customers, tables) of the one restaurant for all;
    ``hot_c``, ``hot_t`` [word, class] and ``hot_roots`` [word] of hot words.
    """

    def __init__(self, customers, tables, roots, hot_c, hot_t, hot_roots):
        self.customers, self.tables, self.roots = customers, tables, roots
        self.hot_c, self.hot_t, self.hot_roots = hot_c, hot_t, hot_roots


def _root(c, t, total, d: float, words: float):
    """Predictive probabilities of the restaurant for all."""
    return (c - d * t + (STRENGTH + d * total.roots[1]) / (words + 1)) / (STRENGTH + total.roots[0])


def _below(c, t, p, customers, tables, d: float):
    return (c - d * t + (STRENGTH + d * tables) * p) / (STRENGTH + customers)


def moving(customers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which restaurants' tables can change: with a table a dish at first, those where a dish has more customers than one."""
    return customers > first


class Chain:
    """One bucket's restaurants. ``own`` are (name, customers, tables by sweep) of words before."""

    def __init__(self, bucket: Bucket, own, shared: dict):
        self.b, self.shared = bucket, shared
        names, customers, history = own
        at = np.searchsorted(names, bucket.name)
        at[at == len(names)] = 0
        is_own = names[at] == bucket.name if len(names) else np.zeros(len(bucket.name), bool)
        # words before that only held-out texts have are without a restaurant: nobody sits there
        self.place = np.where(is_own, at, -1)[bucket.u]
        self.customers, self.history = customers, history
        some = np.flatnonzero(is_own)
        #: names whose tables can change, and the pairs to draw: a lone customer has one table
        self.moving = some[moving(customers, history[:, 0])[at[some]]]
        self.drawn = np.flatnonzero(bucket.c > 1)
        # the start: every dish at one table, probabilities from plain counts
        self.tables = np.minimum(bucket.c, 1)
        counts = np.where(bucket.hot >= 0, shared["hot_counts"][bucket.hot], bucket.word_counts())
        plain = (counts + 1 / (shared["words"] + 1)) / (shared["tokens"] + 1)
        self.p = plain[bucket.parent_word]
        self.p_root = plain
        self.parent_tables = np.minimum(np.bincount(bucket.parent, weights=bucket.c, minlength=len(bucket.parent_word)), 1).astype(np.int64)
        self.root_tables = np.minimum(counts, 1)

    def sweep(self, k: int, before: Totals) -> None:
        """Draws sweep ``k`` (from 1 on) given the totals before it."""
        b, (d2, d1, d0) = self.b, self.shared["discounts"]
        at = self.drawn
        others = self.history[self.place[at], k - 1] - self.tables[at]
        self.tables[at] = draw(b.c[at], others, STRENGTH, d2, self.p[b.parent[at]], _uniform(b.digest[b.word[at]], b.name[b.u[at]], k))
        self._customers()
        word, kind = b.parent_word, b.parent_class
        self.parent_tables = draw(self.parent_customers, before.tables[kind] - self.parent_tables, STRENGTH, d1, self.p_root[word], _uniform(b.digest[word], kind + 2, k))
        self._customers()
        base = np.full(len(b.digest), 1 / (self.shared["words"] + 1))
        self.root_tables = draw(self.root_customers, before.roots[1] - self.root_tables, STRENGTH, d0, base, _uniform(b.digest, 0, k))

    def sums(self):
        """(customers by class, tables by class, root's customers, root's tables) of words that aren't hot."""
        b = self.b
        cold = b.hot[b.parent_word] < 0
        by = lambda x: np.bincount(b.parent_class[cold], weights=x[cold], minlength=CLASSES)
        return [*by(self.parent_customers), *by(self.parent_tables), self.root_customers[b.hot < 0].sum(), self.root_tables[b.hot < 0].sum()]

    def state(self) -> bytes:
        return _packed(self.tables[self.drawn], self.parent_tables, self.root_tables)

    def restore(self, state: bytes) -> None:
        """The tables as a sweep left them."""
        drawn, parent, root = (x.astype(np.int64) for x in _unpacked(state))
        self.tables[self.drawn], self.parent_tables, self.root_tables = drawn, parent, root
        self._customers()

    def _customers(self) -> None:
        b = self.b
        self.parent_customers = np.bincount(b.parent, weights=self.tables, minlength=len(b.parent_word)).astype(np.int64)
        self.root_customers = np.bincount(b.parent_word, weights=self.parent_tables, minlength=len(b.digest)).astype(np.int64)

    def settle(self, after: Totals) -> None:
        """Probabilities by the totals of the sweep just drawn; hot words' parents are everyone's."""
        b, (_, d1, d0) = self.b, self.shared["discounts"]
        hot = b.hot >= 0
        parents = np.flatnonzero(hot[b.parent_word])
        h, kind = b.hot[b.parent_word[parents]], b.parent_class[parents]
        self.parent_customers[parents], self.parent_tables[parents] = after.hot_c[h, kind], after.hot_t[h, kind]
        self.root_customers[hot], self.root_tables[hot] = after.hot_t.sum(axis=1)[b.hot[hot]], after.hot_roots[b.hot[hot]]
        self.p_root = _root(self.root_customers, self.root_tables, after, d0, self.shared["words"])
        kind = b.parent_class
        self.p = _below(self.parent_customers, self.parent_tables, self.p_root[b.parent_word], after.customers[kind], after.tables[kind], d1)

    def probability(self, k: int) -> np.ndarray:
        """Of each pair, after sweep ``k`` has settled."""
        b, d2 = self.b, self.shared["discounts"][0]
        p = self.p[b.parent]
        at = np.flatnonzero(self.place >= 0)
        who = self.place[at]
        p[at] = _below(b.c[at], self.tables[at], p[at], self.customers[who], self.history[who, k], d2)
        return p


def _messages(table: pa.Table):
    kinds = table.column("kind").to_pylist()
    chunks, data = table.column("chunk").to_pylist(), table.column("data")
    # the same order in each pass and at each dealing
    return sorted((chunks[i], data[i].as_py()) for i, k in enumerate(kinds) if k == ASK)


def _send(rows):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary()]
    names = ["kind", "bucket", "u", "c", "v", "s"]
    return pa.Table.from_batches([pa.record_batch([pa.array(r, k) if not isinstance(r, pa.Array) else r for r, k in zip(part, kinds, strict=True)], names=names) for part in rows])


def _rows(kind, bucket, u, c):
    size = len(u)
    return [pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, bucket, np.int32)), pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(c, np.int64)), pa.nulls(size, pa.list_(pa.float64())), pa.nulls(size, pa.binary())]


def _blobs(kind, bucket, numbered):
    """Rows of packed arrays from (number, bytes)."""
    u, s = zip(*numbered, strict=True) if numbered else ((), ())
    n = len(u)
    return [[kind] * n, [bucket] * n, list(u), [0] * n, [None] * n, list(s)]


def _to_shards(kind, bucket, names: np.ndarray, numbers: np.ndarray, shards: int):
    """Sorted ``names`` with numbers, packed for each shard: a range of names."""
    cuts = np.searchsorted(names, [-(-(i << 40) // shards) for i in range(shards + 1)])
    return _blobs(kind, bucket, [(i, _packed(*_named(names[a:b]), numbers[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])


def _numbers(values):
    return [[NUMBERS], [0], [0], [0], [[float(x) for x in values]], [None]]


def _slices(messages, hot: np.ndarray):
    for part in range(SLICES):
        yield Bucket(messages, hot, part, SLICES)
        give_back()


def _from_pairs(table: pa.Table, hot: np.ndarray):
    rows = dict(zip(table.column("u").to_pylist(), table.column("s"), strict=True))
    for part in sorted(rows):
        yield Bucket.of_pairs(rows[part].as_py(), hot, part)
        give_back()


def _added(parts) -> tuple[np.ndarray, np.ndarray]:
    """(names, sums) of parts of the same shape, each name once."""
    names, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(names, return_inverse=True)
    return names, np.bincount(at, weights=numbers, minlength=len(names)).astype(np.int64)


def counted(bucket: int, slices, shards: int):
    rows, before, words = [], [], []
    for b in slices:
        found, types, loud = _counted(bucket, b)
        rows += [*found, _blobs(PAIRS, bucket, [(b.part, b.packed())])]
        before.append((b.name, types))
        words.append(loud)
    return [*rows, _to_shards(WORDS, bucket, *_added(words), shards), _to_shards(BEFORE, bucket, *_added(before), shards)]


def _counted(bucket: int, b: Bucket):
    counts = b.word_counts()
    cold = b.hot < 0
    by_parent = np.bincount(b.parent, weights=b.c, minlength=len(b.parent_word))
    parent_cold = cold[b.parent_word]
    numbers = [counts.sum(), (counts[cold] > 0).sum(), *[(x == k).sum() for x in (b.c, by_parent[parent_cold], counts[cold]) for k in (1, 2)]]
    numbers += np.bincount(b.parent_class[parent_cold & (by_parent > 0)], minlength=CLASSES).tolist()
    words = np.flatnonzero(cold & (counts > 0))
    hot = np.flatnonzero(~parent_cold)
    types = np.bincount(b.u, weights=b.c > 0, minlength=len(b.name))
    rows = [
        _numbers(numbers),
        _rows(PARENTS, bucket, b.hot[b.parent_word[hot]] * CLASSES + b.parent_class[hot], by_parent[hot]),
    ]
    return rows, types, ((b.digest[words] & np.uint64(_NAME)).astype(np.int64), counts[words])


def _blobs_of(table: pa.Table, kind: int):
    """(bucket, names, numbers) of the blobs of a shard, in a fixed order."""
    table = table.filter(pc.equal(table.column("kind"), kind)).sort_by("bucket")
    for bucket, blob in zip(table.column("bucket").to_pylist(), table.column("s"), strict=True):
        first, more, numbers = _unpacked(blob.as_py())
        yield bucket, _names(first, more), numbers.astype(np.int64)


def _answers(rows) -> pa.Table:
    buckets, blobs = zip(*rows, strict=True) if rows else ((), ())
    return pa.table([pa.array(buckets, pa.int32()), pa.array([ANSWER] * len(rows), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "u", "s"])


def owned(table: pa.Table, loud, shards: int) -> pa.Table:
    """To each bucket those of its words before that training texts have, with customers and all buckets' tables."""
    shard, (names, customers) = table.column("u")[0].as_py(), loud
    mine = names * shards >> 40 == shard
    names, customers = _added([(names[mine], customers[mine]), *[(u, c) for _, u, c in _blobs_of(table, WORDS)]])
    if not len(names):
        return _answers([])
    totals, found = np.zeros(len(names), np.int64), []
    for bucket, u, n in _blobs_of(table, BEFORE):
        at = np.searchsorted(names, u)
        at[at == len(names)] = 0
        some = names[at] == u
        at = at[some]
        totals[at] += n[some]
        found.append((bucket, at))
    return _answers([(b, _packed(*_named(names[at]), customers[at], totals[at])) for b, at in found if len(at)])


def added(table: pa.Table) -> pa.Table:
    """To each bucket the tables that all buckets have of the words before that it sent."""
    names, totals = _added([(u, n) for _, u, n in _blobs_of(table, BEFORE)])
    return _answers([(b, _packed(*_named(u), totals[np.searchsorted(names, u)])) for b, u, _ in _blobs_of(table, BEFORE)])


def _own(table: pa.Table):
    """(names, customers, tables by sweep) sorted by name, and the states by number, from the rows that came back."""
    states, answers, kept = {}, [], None
    for u, s in zip(table.column("u").to_pylist(), table.column("s"), strict=True):
        if u == ANSWER:
            answers.append([x.astype(np.int64) for x in _unpacked(s.as_py())])
        elif u == KEPT:
            kept = [x.astype(np.int64) for x in _unpacked(s.as_py())]
        else:
            states[u] = s.as_py()
    answers = [np.concatenate(x) for x in zip(*[(_names(*x[:2]), *x[2:]) for x in sorted(answers, key=lambda x: x[0][0])], strict=True)]
    if kept is None:
        # the first answers have customers and tables; none come where no text trains
        none = np.zeros(0, np.int64)
        names, customers, first = answers or (none, none, none)
        return (names, customers, first[:, None] if len(names) else np.zeros((0, BURN + SAMPLES + 1), np.int64)), states
    names, first, more = _names(*kept[:2]), *kept[2:4]
    at = np.flatnonzero(moving(first + more, first))
    history = np.repeat(first[:, None], len(kept) - 2, axis=1)
    for k, tables in enumerate((*kept[4:], *answers[1:]), 1):
        history[at, k] = tables
    return (names, first + more, history), states


def _kept(names: np.ndarray, customers: np.ndarray, history: np.ndarray) -> bytes:
    """What :func:`_own` reads, for the next time: tables after a sweep only of names where they can change."""
    first = history[:, 0]
    return _packed(*_named(names), first, customers - first, *history[moving(customers, first), 1:].T)


def swept(bucket: int, slices, own, states, shared, totals, shards: int):
    """Draws the next sweep after those whose totals are known; a state's number is sweep * SLICES + slice."""
    k = len(totals)
    rows, before = [], []
    kept = {j: s for j, s in states.items() if j >= (BURN + 1) * SLICES}
    for b in slices:
        chain = Chain(b, own, shared)
        if k > 1:
            chain.restore(states[(k - 1) * SLICES + b.part])
            chain.settle(totals[k - 1])
        chain.sweep(k, totals[k - 1])
        kept[k * SLICES + b.part] = chain.state()
        parent_hot = b.hot[b.parent_word]
        some = np.flatnonzero(parent_hot >= 0)
        before.append((b.name[chain.moving], np.bincount(b.u, weights=chain.tables, minlength=len(b.name))[chain.moving]))
        rows += [_numbers(chain.sums()), _rows(PARENTS, bucket, parent_hot[some] * CLASSES + b.parent_class[some], chain.parent_customers[some])]
    rows.append(_to_shards(BEFORE, bucket, *_added(before), shards))
    return [*rows, _blobs(STATE, bucket, [*kept.items(), *([(KEPT, _kept(*own))] if len(own[0]) else [])])]


def scored(slices, own, states, shared, totals) -> list:
    """(chunk, packed sums of base, score and known tokens by document) of a bucket."""
    sums = None
    for b in slices:
        chain, mean = Chain(b, own, shared), np.zeros(len(b.c))
        for k in range(BURN + 1, len(totals)):
            chain.restore(states[k * SLICES + b.part])
            chain.settle(totals[k])
            mean += chain.probability(k) / SAMPLES
        counts = np.where(b.hot >= 0, shared["hot_counts"][b.hot], b.word_counts())
        base = np.log10((counts + 0.1) / (shared["tokens"] + 0.1 * (shared["words"] + 1)))[b.word]
        if sums is None:
            sums = np.zeros((3, sum(b.docs)))
        for total, x in zip(sums, (base, np.log10(mean), (counts > 0)[b.word].astype(float)), strict=True):
            total += np.bincount(b.doc, weights=b.tf * x[b.pair], minlength=len(total))
        chunks, docs = b.chunks, b.docs
    out, at = [], 0
    for chunk, n in zip(chunks, docs, strict=True):
        out.append((chunk, _packed(sums[0][at : at + n], sums[1][at : at + n], sums[2][at : at + n].astype(np.int64))))
        at += n
    return out


def hot_totals(customers: np.ndarray, sums: np.ndarray, before: Totals, settled, k: int, shared) -> Totals:
    """The totals after sweep ``k``: the buckets' sums and the hot words, whose parents' tables are drawn here."""
    _, d1, d0 = shared["discounts"]
    hot, words = shared["hot"], shared["words"]
    p_root = settled if settled is not None else (shared["hot_counts"] + 1 / (words + 1)) / (shared["tokens"] + 1)
    kind = np.tile(np.arange(CLASSES), len(hot))
    word = np.repeat(np.arange(len(hot)), CLASSES)
    tables = draw(customers.reshape(-1), before.tables[kind] - before.hot_t.reshape(-1), STRENGTH, d1, p_root[word], _uniform(hot[word], kind + 2, k)).reshape(customers.shape)
    roots = draw(tables.sum(axis=1), before.roots[1] - before.hot_roots, STRENGTH, d0, np.full(len(hot), 1 / (words + 1)), _uniform(hot, 0, k))
    return Totals(
        sums[:CLASSES] + customers.sum(axis=0), sums[CLASSES : 2 * CLASSES] + tables.sum(axis=0),
        (sums[-2] + tables.sum(), sums[-1] + roots.sum()), customers, tables, roots,
    )


def _hot(rows: DataFrame, share: float) -> np.ndarray:
    """Digests of the words that are frequent in a bounded sample, sorted, with the end of texts; only dealing depends on them."""
    sample = rows.sample(share, seed=5).select(F.left("s", F.lit(20000)).alias("s"))
    word = sample.select(F.explode(F.split(F.lower("s"), r"[ \t-\r]+")).alias("w")).filter("w <> ''").groupBy("w").count()
    n = word.agg(F.sum("count")).first()[0] or 0
    words = [r["w"] for r in word.filter(F.col("count") * HOT_SHARE > n).orderBy(F.col("count").desc(), "w").limit(HOT - 1).collect()]
    return np.array(sorted({END, *[xxhash.xxh64_intdigest(w.encode()) for w in words]}), np.uint64)


def _gathered(batches):
    held, now = [], None

    def whole(rows):
        has, ids, number, counts, last, train = _unpacked(next(r[3] for r in rows if r[2] == META))
        sums = [np.zeros(len(ids)) for _ in range(3)]
        for r in sorted(r for r in rows if r[2] == SUMS):
            for total, part in zip(sums, _unpacked(r[3]), strict=True):
                total += part
        part = rows[0][1] >> 32
        return pa.record_batch(
            [pa.array(number.astype(np.int64) + (part << 32)), pa.array(ids.astype(np.int64), mask=has == 0), pa.array(train == 0), pa.array(counts.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
            names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score"],
        )

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[1] != now:
                yield whole(held)
                held = []
            now = row[1]
            held.append(row)
    if held:
        yield whole(held)


def _labels(spark, n: int) -> np.ndarray:
    """Numbers for ``n`` buckets that Spark's hash deals to ``n`` partitions one each."""
    tried = spark.range(30 * n + 300).select(F.col("id").cast("int").alias("i"))
    at = F.pmod(F.hash("i"), F.lit(n)).alias("p")
    found = {r["p"]: r["i"] for r in tried.groupBy(at).agg(F.min("i").alias("i")).collect()}
    # a partition that no number tried lands in goes without a bucket of its own
    return np.array([found.get(p, 30 * n + 300 + p) for p in range(n)], np.int64)


def _summed(sent: DataFrame) -> np.ndarray:
    """The buckets' NUMBERS added up: one row."""
    each = sent.filter(F.col("kind") == NUMBERS).select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(each)], np.float64)


def _of_hot(sent: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n * CLASSES, np.int64)
    for r in sent.filter(F.col("kind") == PARENTS).groupBy("u").agg(F.sum("c").alias("c")).collect():
        out[r["u"]] = r["c"]
    return out.reshape(n, CLASSES)


@dataclass
class Model:
    """The buckets' requests, what came back to them after the last sweep, and what the buckets share; ``tables`` to drop at the end."""

    dealt: DataFrame
    back: DataFrame
    hot: np.ndarray
    shared: dict
    totals: list
    tables: list

    def pairs(self):
        """(requests, answers) of each bucket as Arrow tables, on the driver: for tests on small tables."""
        for (b,) in self.dealt.select("bucket").distinct().collect():
            left, right = (x.filter(F.col("bucket") == b).toArrow() for x in (self.dealt, self.back))
            if left.num_rows:
                yield left, right


def steps(docs: DataFrame, folds: int = 10, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learns from the training rows of ``docs``; the other rows' words are dealt with them."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), (crc_mod(F.col(id_column), folds) != 0).alias("train"), text.alias("s"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("s"))).first()
    buckets = max(12, -(-(size or 0) // BUCKET))
    hot = _hot(rows, min(1.0, HOT_TEXTS / max(n, 1)))
    given = rows.select("id", "train", F.col("s").cast("binary").alias("t"))
    shards = max(4, -(-buckets // SHARE))

    labels = _labels(spark, buckets)

    def dealt(scoring: bool):
        return given.mapInArrow(_ask(labels, hot, scoring), TYPE).repartition(buckets, "bucket")

    def count(key, table):
        return _send(counted(key[0].as_py(), _slices(_messages(table), hot), shards))

    with bounded_batches(spark):
        sent = dealt_out(dealt(False).groupBy("bucket").applyInArrow(count, SENT), buckets, "bucket", "lm-pairs", settled=True)
    released(spark)
    numbers = _summed(sent)
    numbers = numbers if len(numbers) else np.zeros(8 + CLASSES)
    hot_parents = _of_hot(sent, len(hot))
    hot_counts = hot_parents.sum(axis=1)
    for at, x in ((4, hot_parents), (6, hot_counts)):
        numbers[at : at + 2] += [(x == 1).sum(), (x == 2).sum()]
    shared = {
        "hot": hot, "hot_counts": hot_counts, "tokens": float(numbers[0]), "words": float(numbers[1] + (hot_counts > 0).sum()),
        "discounts": (_of_counts(*numbers[2:4]), _of_counts(*numbers[4:6]), _of_counts(*numbers[6:8])),
    }
    # every word's restaurant as a word before has as many customers as the word has tokens; the beginning, as there are ends
    loud = [(int(h) & _NAME if h != END else BEGIN, int(c)) for h, c in zip(hot, hot_counts) if c]
    loud = _added([tuple(np.array(x, np.int64).reshape(-1) for x in zip(*loud))]) if loud else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    to_shards = sent.filter(F.col("kind").isin(WORDS, BEFORE)).select("kind", "bucket", "u", "s")
    back = to_shards.groupBy("u").applyInArrow(lambda table: owned(table, loud, shards), BACK)
    pairs, tables = sent.filter(F.col("kind") == PAIRS).select("bucket", "u", "s"), [sent]
    start = np.minimum(hot_parents, 1)
    totals = [Totals(None, numbers[8:] + start.sum(axis=0), (shared["words"], shared["words"]), hot_parents, start, np.minimum(hot_counts, 1))]
    settled = None

    def sweep(known):
        def run(key, left, right):
            if not left.num_rows:
                return _send([_numbers([0.0] * (2 * CLASSES + 2))])
            return _send(swept(key[0].as_py(), _from_pairs(left, hot), *_own(right), shared, known, shards))

        return run

    for k in range(1, BURN + SAMPLES + 1):
        sent = written(pairs.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(sweep(list(totals)), SENT), "lm-sweep")
        if k > 1:
            drop_written(tables.pop())
        tables.append(sent)
        sums = _summed(sent)
        sums = sums if len(sums) else np.zeros(2 * CLASSES + 2)
        customers = _of_hot(sent, len(hot))
        totals.append(hot_totals(customers, sums, totals[-1], settled, k, shared))
        settled = _root(totals[-1].hot_t.sum(axis=1), totals[-1].hot_roots, totals[-1], shared["discounts"][2], shared["words"])
        to_shards = sent.filter(F.col("kind") == BEFORE).select("kind", "bucket", "u", "s")
        back = to_shards.groupBy("u").applyInArrow(added, BACK).unionByName(sent.filter(F.col("kind") == STATE).select("bucket", "u", "s"))
        released(spark)

    # the pairs are of no use to scoring, which has the most on disk
    drop_written(tables.pop(0))
    return Model(dealt(True), back, hot, shared, totals, tables)


def scores(docs: DataFrame, folds: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10 probabilities."""
    model = steps(docs, folds, id_column, text_column)
    dealt, back, hot, shared, totals = model.dealt, model.back, model.hot, model.shared, model.totals

    def answer(key, left, right):
        messages = _messages(left)
        bucket = key[0].as_py()
        out = [tuple(r.values()) for r in left.filter(pc.equal(left.column("kind"), META)).to_pylist()]
        if messages:
            out += [(bucket, chunk, SUMS, data) for chunk, data in scored(_slices(messages, hot), *_own(right), shared, totals)]
        return pa.Table.from_batches([_batch(NAMES, out, KINDS)] if out else [], pa.schema(list(zip(NAMES, KINDS))))

    found = dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(answer, TYPE)
    found = found.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk")
    parts = found.mapInArrow(_gathered, "row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    with bounded_batches(docs.sparkSession):
        parts = written(parts, "lm-parts")
    for table in model.tables:
        drop_written(table)
    whole = parts.groupBy("row").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(k).alias(k) for k in ("n_tokens", "n_known", "base", "score")])
    return whole.select("id", "held_out", "n_tokens", "n_known", F.lit(int(shared["tokens"])).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
