"""What the operators share: the cluster's scratch folder, written tables, hot-group cells, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only for a local master without it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("rangeweave.scratch", "")
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rangeweave-')}"
        spark.conf.set("rangeweave.scratch", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/rangeweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder: like :func:`written`, and partitions stay as they are dealt and sorted."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def dealt_out(df: DataFrame, n: int, column: str, name: str, settled: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder in ``n`` buckets of ``column``: groups of it are read without a shuffle.

    ``settled``: each task already holds whole buckets, and ``df`` isn't shuffled for them.

    The catalogue forgets the table at once; what was read from it goes on to know the buckets.
    """
    spark = df.sparkSession
    table = f"rangeweave_{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/rangeweave/{name}-{table}"
    (df if settled else df.repartition(n, column)).write.bucketBy(n, column).option("path", path).option("compression", "none").saveAsTable(table)
    found = spark.table(table)
    found.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return found


def drop_written(df: DataFrame) -> None:
    """Removes the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/rangeweave/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps that are written: they go when the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Free memory of this Python worker goes back to the machine: workers stay between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` to broadcast if it proves to have at most ``most`` rows; else as it is, for a join that Spark deals out."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, most: int = 8 << 20):
    """Arrow batches of at most ``most`` bytes while a table is made: texts differ in length, and 10,000 rows may be gigabytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def cells(df: DataFrame, keys: list[str], limit: int, member: str) -> DataFrame:
    """Adds ``cell``, ``side`` and ``alone`` (the cell is one chunk) so that every pair of rows of a group meets in exactly one cell.

    A group of up to ``limit`` rows is one cell (0, side 0). A larger one is cut by a hash of
    ``member`` into k chunks; cell (i, i) holds chunk i and cell (i, j) holds chunks i (side 0)
    and j (side 1), so no task ever gets more than about 2 * ``limit`` rows of a group.
    """
    sizes = df.groupBy(*keys).count().filter(F.col("count") > limit)
    if sizes.isEmpty():
        return df.withColumns({"cell": F.lit(0).cast("long"), "side": F.lit(0), "alone": F.lit(True)})
    sizes = sizes.select(*keys, F.ceil(F.col("count") / limit).alias("_k"))
    chunk = F.pmod(F.xxhash64(F.lit("cell"), F.col(member)), F.col("_k"))
    many = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_k") - 1),
        lambda j: F.struct(
            (F.least(F.col("_c"), j) * F.col("_k") + F.greatest(F.col("_c"), j)).alias("cell"),
            (F.col("_c") > j).cast("int").alias("side"),
            (F.col("_c") == j).alias("alone"),
        ),
    )
    one = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), F.lit(True).alias("alone")))
    return (
        df.join(sizes, keys, "left")
        .withColumn("_c", chunk)
        .withColumn("_at", F.explode(F.when(F.col("_k").isNull(), one).otherwise(many)))
        .select(*df.columns, F.col("_at.cell").alias("cell"), F.col("_at.side").alias("side"), F.col("_at.alone").alias("alone"))
    )


def clear(spark: SparkSession) -> None:
    """Removes all tables and archives that the operators left in the shared folder, once no result is to be read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/rangeweave")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Forest:
    """Union-find over 0..n-1 by arrays: ``root`` always points straight at the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that undirected ``edges`` (a, b) of longs reach; nodes without edges are absent.

    Large-star and small-star rounds over DataFrames, each written to the shared folder, until
    a round changes nothing. A star's hub meets its neighbours through sums and joins that
    Spark can split; nothing but one count and one checksum per round reaches the driver.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        after = written(small, name)
        drop_written(now)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct())
