"""Each stage of the pipeline, on its own input, against the plain rule."""

import os
import sys

import pytest
import xxhash

import corpus_pipeline as pipeline

sys.path.insert(0, os.path.dirname(__file__))
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    found = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    return found


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert set(stages[0].columns) <= set(stages[-1].columns)


def test_each_stage_by_the_plain_rule(spark, stages):
    """Expected rows come from plain Python and SQL, not from the operators; only what discovery adds is taken from it."""
    import re

    import duckdb
    from test_llm import brute_components, lower, plain_spans

    from rangeweave.llm import pii, sql

    got = [{r.doc_id: r for r in s.collect()} for s in stages]
    assert all(any(c.isalpha() for c in r.text or "") == (i in got[1]) for i, r in got[0].items())

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(sh))

    ids = sorted(got[1])
    first = brute_components(ids, [fingerprint(got[1][i].text) for i in ids], 4)
    assert set(got[2]) == {i for i, c in first.items() if i == c}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    for i, r in got[2].items():
        w = words(r.text)
        hits = [(k, n) for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
        items = set().union(*[windows[tuple(w[k : k + n])] for k, n in hits])
        assert (i in got[3]) == (len(items) < 2)
        if i in got[3]:
            gone = {j for k, n in hits for j in range(k, k + n)}
            assert words(got[3][i].text) == [x for j, x in enumerate(w) if j not in gone]
            assert hits or got[3][i].text == r.text

    for r in pii.find(stages[3]).collect():
        text, out, at = got[3][r.id].text, "", 0
        spans = [(int(a), k, int(e)) for k, a, e in (x.split(":") for x in plain_spans(text).split(",") if x)]
        spans += [(s.start, s.kind, s.end) for s in r.spans if not s.base]
        for start, kind, end in sorted(spans, key=lambda s: (s[0], pii.ALL.index(s[1]))):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        assert got[4][r.id].text == out + text[at:]

    connection = duckdb.connect()
    connection.register("documents", stages[4].toArrow())
    taken = {i: t // n for i, n, t in connection.execute(f"SELECT doc_id, size, taken FROM ({sql.ORACLES['op6_mixing']}) WHERE size > 0").fetchall()}
    assert {i: r.copies for i, r in got[5].items() if i in taken} == {i: c for i, c in taken.items() if c}


def test_rows_of_one_id_are_not_lost(spark):
    text = lambda k: " ".join(f"{chr(97 + k)}{j * (k + 3) % 91}" for j in range(120))
    rows = [(5, text(0), "en", "a", 1), (5, text(1), "en", "a", 1), (3, text(1), "en", "a", 1), (7, text(2), "en", "a", 1), (7, text(3), "en", "b", 2), (7, text(3), "en", "a", 2), (None, text(0), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(((r.doc_id or 0), r.text, r.source) for r in pipeline.near_duplicates(spark, docs, DIR).collect())
    assert found == sorted([(0, text(0), "a"), (3, text(1), "a"), (5, text(0), "a"), (7, text(2), "a"), (7, text(3), "a")])


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "one", "en", "a", 3, "x"), (3, "one", "en", "a", 3, "x"), (None, "two words", "en", None, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        for given in (docs, docs.limit(0)):
            stage(spark, given, DIR).collect()
        stage(spark, docs, DIR).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3]


def test_run(spark):
    found = pipeline.run(spark, DIR)
    assert found.count() > 0 and "copies" in found.columns
