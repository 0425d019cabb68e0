"""Operator 4, benchmark decontamination: a broadcast hash set of normalised test windows, DataFrame functions only.

Every ``width`` consecutive words of a benchmark item make a window (an item of fewer words is
one window). Documents are split into words, every position's window hash is probed in the
broadcast set, and hits are verified on the words themselves. The set is broadcast only after
its bytes have been summed and found to be at most ``SET_BYTES``. A larger one is joined by shuffle on
positions and hashes alone, where Spark splits frequent windows; hits then meet their text's words once for
the check. Items are joined to a document's distinct windows at the end, so none is carried by a hit.

Defined results: null and wordless texts have no words, no hits and no items. Items that are
null or wordless have no windows; rows of one item_id are one item, null being an id of its own. Rows repeated in full
come out repeated; rows of one id with different texts are judged apart. Empty tables give empty
results, or no hits. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that isn't lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SET_BYTES = 48 << 20
#: Every document also probes one of so many marks, by which it comes through the join without a hit.
MARKS = 1024


def words(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _hash(hashes, at, width: int):
    return F.xxhash64(F.lit(width), *[F.get(hashes, at + k) for k in range(width)])


def _windows(hashes, width: int):
    """(pos, hash) of each window of ``width`` words; none if there are fewer."""
    last = F.size(hashes) - width
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), _hash(hashes, i, width).alias("wh")))
    ).otherwise(F.array().cast("array<struct<pos:int,wh:bigint>>"))


def _mark(k):
    return F.xxhash64(F.lit("mark"), k.cast("long"))


def windows(benchmark: DataFrame, width: int = 8, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(wh, width, window, item): each distinct window of each item, with its hash."""
    rows = benchmark.select(F.col(id_column).alias("item"), words(F.col(text_column)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    rows = rows.select("item", "w", n.alias("width"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    rows = rows.select("item", "width", F.slice("w", F.col("at") + 1, F.col("width")).alias("w"))
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    wh = F.coalesce(*[F.when(F.col("width") == k, _hash(hashes, F.lit(0), k)) for k in range(1, width + 1)])
    return rows.select(wh.alias("wh"), "width", F.array_join("w", " ").alias("window"), "item").distinct()


def _probed(base: DataFrame, table: DataFrame, every) -> DataFrame:
    """(id, text_hash, n_words, pos, width, wid) by a broadcast ``table``: words are checked where they stand."""
    marks = base.sparkSession.range(MARKS).select(
        _mark(F.col("id")).alias("wh"), F.lit(0).alias("width"), F.lit("").alias("window"), F.lit(None).cast("long").alias("wid")
    )
    mark = F.array(F.struct(F.lit(-1).alias("pos"), _mark(F.pmod(F.xxhash64("id", "text_hash"), F.lit(MARKS))).alias("wh")))
    rows = base.select("id", "text_hash", "w", F.explode(F.concat(mark, *every)).alias("at"))
    rows = rows.select("id", "text_hash", "w", F.col("at.pos").alias("pos"), F.col("at.wh").alias("dwh"))
    seen = F.when(F.col("pos") < 0, F.lit("")).otherwise(F.array_join(F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("width")), " "))
    table = F.broadcast(table.unionByName(marks))
    hits = rows.join(table, (F.col("dwh") == F.col("wh")) & ((F.col("pos") < 0) == (F.col("width") == 0))).filter(seen == F.col("window"))
    return hits.select("id", "text_hash", F.size("w").alias("n_words"), "pos", "width", "wid")


def _joined(base: DataFrame, table: DataFrame, every) -> DataFrame:
    """The same rows by joins: no exploded row carries the words, and each text meets its own hits once."""
    nothing = F.array().cast("array<struct<pos:int,wh:bigint>>")
    rows = base.select("id", "text_hash", F.explode(F.concat(nothing, *every)).alias("at")).select("id", "text_hash", F.col("at.pos").alias("pos"), F.col("at.wh").alias("wh"))
    hits = rows.join(table, "wh").distinct().select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "pos", "width", "window", "wid")
    once = base.select("id", "text_hash", "w").groupBy("id", "text_hash").agg(F.first("w").alias("w"))
    hits = once.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    hits = hits.filter(F.array_join(F.slice("w", F.col("pos") + 1, F.col("width")), " ") == F.col("window"))
    hits = hits.select("id", "text_hash", F.size("w").alias("n_words"), "pos", "width", "wid")
    own = base.select("id", "text_hash", F.size("w").alias("n_words"), F.lit(-1).alias("pos"), F.lit(0).alias("width"), F.lit(None).cast("long").alias("wid"))
    return hits.unionByName(own)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
) -> DataFrame:
    """(id, text_hash, n_words, hits, items): hits are (pos, width) of windows, items the distinct items hit, for each row."""
    held = windows(benchmark, width, item_column, text_column)
    table = held.select("wh", "width", "window").distinct().withColumn("wid", F.monotonically_increasing_id())
    table = written(table, "benchmark-windows")
    sizes = table.groupBy("width").agg(F.sum(F.octet_length("window") + 96).alias("bytes")).collect()
    text_hash = F.xxhash64(text_column)
    base = docs.select(F.col(id_column).alias("id"), text_hash.alias("text_hash"), words(F.col(text_column)).alias("w"))
    base = base.withColumn("hs", F.transform("w", lambda w: F.xxhash64(w)))
    every = [_windows(F.col("hs"), k) for k in sorted(r["width"] for r in sizes)]
    hits = (_probed if sum(r["bytes"] for r in sizes) <= SET_BYTES else _joined)(base, table, every)
    grouped = hits.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos") < 0).alias("_rows"),
        F.array_sort(F.collect_set(F.when(F.col("pos") >= 0, F.struct("pos", "width")))).alias("hits"),
        F.collect_set("wid").alias("wids"),
    )
    grouped = written(grouped, "benchmark-hits")
    # items of each document's distinct windows; a null id is wrapped, for sets leave nulls out
    owners = held.join(table, ["wh", "width", "window"]).select("wid", F.struct("item").alias("item"))
    found = grouped.select("id", "text_hash", F.explode("wids").alias("wid")).join(owners, "wid").groupBy("id", "text_hash").agg(F.collect_set("item").alias("found"))
    found = found.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.transform("found", lambda x: x["item"]).alias("found"))
    grouped = grouped.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    items = F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("items")
    return grouped.select("id", "text_hash", "n_words", "hits", items, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_r")).drop("_r")


def hit_words(hits):
    """How many words lie in any of the windows ``hits``, sorted by position."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        hits,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["upto"], x["pos"] + x["width"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), x["pos"] + x["width"] - F.greatest(acc["upto"], x["pos"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, most_items: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that hold more than ``most_items`` items; from the others, words in windows of an item go.

    Texts without a hit stay as they are. Where words go, so does the run of separators after them.
    """
    found = overlaps(docs.select(id_column, text_column).distinct(), benchmark, width, id_column, text_column).filter(F.size("hits") > 0)
    found = found.select(F.col("id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"), F.col("hits").alias("__hit_spans"), F.size("items").alias("__hit_items"))
    joined = docs.join(
        found, F.col(id_column).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(text_column) == F.col("__hit_hash")), "left"
    ).filter(F.col("__hit_items").isNull() | (F.col("__hit_items") <= most_items))
    own = F.regexp_extract_all(text_column, F.lit(WORDS), F.lit(0))
    joined = joined.withColumns(
        {"__hit_own": F.when(F.col("__hit_items").isNotNull(), own), "__hit_gaps": F.when(F.col("__hit_items").isNotNull(), F.split(text_column, WORDS))}
    )
    covered = lambda i: F.exists("__hit_spans", lambda h: (h["pos"] <= i) & (i < h["pos"] + h["width"]))
    kept = F.transform("__hit_own", lambda w, i: F.when(covered(i), F.lit("")).otherwise(F.concat(w, F.get("__hit_gaps", i + 1))))
    cut = F.concat(F.get("__hit_gaps", F.lit(0)), F.array_join(kept, ""))
    text = F.when(F.col("__hit_items").isNotNull(), cut).otherwise(F.col(text_column))
    return joined.withColumn(text_column, text).select(*docs.columns)
