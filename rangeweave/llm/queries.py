"""The thin queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .language import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), "doc_id", "text", "lang")
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, listed

    found = find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import hit_words, overlaps

    found = overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import scores

    return scores(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .quality import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 4) != 2)
    found = score(docs, train(docs, labels))
    return found.select(
        F.col("id").alias("doc_id"),
        (crc_mod(F.col("id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    path = archived(_table(spark, sf_dir, "pages"))
    found = spark.read.format("warc").option("payload", "false").load(path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import dedup

    return dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
