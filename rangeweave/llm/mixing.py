"""Operator 6, mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Each document gets a hash in [0, 2^60). A source's budget beyond its whole copies is met by the
documents below a hash threshold: sizes are summed by source and the hash's leading digit, the
running sums name the bucket in which the budget ends, and only that boundary bucket is refined
by the next digit, until one hash is left. Thresholds nest as budgets grow, nothing is sorted
by document, and a filter on the threshold makes the mix.

Defined results: a null text has size 0; a null source is a source of its own, last in order.
Rows of one id share a hash and are taken together. A source of size 0 has target 0. An empty
table gives an empty result. Clashing column names are safe: only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small, written

#: The hash has DIGITS digits of BITS bits.
BITS, DIGITS = 12, 5


def word_count(text):
    """Words between ASCII white space; null: 0."""
    parts = F.split(text, f"[{SPACE}]+")
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - ends).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, stopped at ``most`` times a source's size.

    The excess is shared again among the others until none is above: the level at which
    sum(min(most * size, level * weight)) meets the budget, found from the sources' ratios
    of limit to weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("_r", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    rows = ranked.withColumns({"_w": w, "_limit": F.col("source_size") * F.lit(float(most))})
    ratio = Window.orderBy(F.col("_limit") / F.col("_w"), "_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_limit").over(ratio), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(ratio), F.lit(0.0))
    )
    rows = rows.withColumn("_level", level)
    found = F.min(F.when(F.col("_level") <= F.col("_limit") / F.col("_w"), F.struct(F.col("_limit") / F.col("_w"), "_r", "_level"))).over(every)
    return rows.withColumn("_at", found["_level"]).select(
        "source", "source_size", F.coalesce(F.least("_limit", F.col("_at") * F.col("_w")), F.col("_limit")).alias("target")
    )


def _digit(k: int):
    """The k-th leading digit of the hash."""
    return F.shiftright("h", BITS * (DIGITS - 1 - k)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each document."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))
    rows = written(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"),
        ),
        "mix",
    )
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    # whole copies of all, and the words that are still to come from documents taken once more
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # prefix: the digits of the boundary so far; left: budget that the buckets before it leave
    edge = goals.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for k in range(DIGITS):
        at = F.shiftright("h", BITS * (DIGITS - k)) if k else F.lit(0).cast("long")
        e = edge.select(F.col("source").alias("_s"), "prefix", "left")
        inside = rows.join(small(e), rows["source"].eqNullSafe(F.col("_s")) & (at == F.col("prefix")))
        sums = inside.groupBy("source", _digit(k).alias("d")).agg(
            F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("prefix").alias("prefix"), F.first("left").alias("left")
        )
        before = F.sum("n").over(Window.partitionBy("source").orderBy("d")) - F.col("n")
        cut = (
            sums.withColumn("b", before)
            .filter((F.col("b") <= F.col("left")) & (F.col("b") + F.col("n") > F.col("left")))
            .select("source", F.shiftleft("prefix", BITS).bitwiseOR(F.col("d")).alias("prefix"), (F.col("left") - F.col("b")).alias("left"), "n", "h0", "h1")
        )
        edge = written(cut, "mix-edge")
        if k + 1 < DIGITS and edge.filter("h0 < h1").isEmpty():
            break
    last = edge.select(
        F.col("source").alias("_s"),
        F.when(F.col("left") * 2 >= F.col("n"), F.col("h1")).otherwise(F.col("h0") - 1).alias("upto"),
    )
    extra = F.when(F.col("budget") <= 0, False).otherwise(F.col("upto").isNull() | (F.col("h") <= F.col("upto")))
    g = goals.withColumnRenamed("source", "_g")
    return (
        rows.join(small(last), rows["source"].eqNullSafe(F.col("_s")), "left")
        .join(small(g), rows["source"].eqNullSafe(F.col("_g")), "left")
        .withColumn("copies", (F.col("whole") + extra.cast("long")).cast("long"))
        .select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
