"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` (or the caller) writes
as Parquet and reads again as the next stage's ``docs``. All stages but the last return the columns of
their input. Nulls, repeated rows, empty tables and extra columns: as the operators define them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.llm import decontaminate, language, mixing, pii, simhash
from rangeweave.llm.common import crc_mod, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without a letter."""
    model = language.train(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), "doc_id", "text", "lang")
    struct = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = language.identify(struct, model, keep=("row",))
    return found.filter("lang_pred <> 'und'").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest id, then text hash, then other columns; rows with a null id stay."""
    found = simhash.near_duplicates(docs).filter("id is not null").groupBy("group", "id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("group").agg(F.min(F.struct("id", "th", "n")).alias("w")).select(F.col("w.id").alias("__keep_id"), F.col("w.th").alias("__keep_th"), F.col("w.n").alias("__keep_n"))
    kept = docs.join(first, (docs["doc_id"] == F.col("__keep_id")) & (F.xxhash64(docs["text"]) == F.col("__keep_th")))
    one = kept.filter("__keep_n = 1").select(docs.columns)
    several = kept.filter("__keep_n > 1").groupBy("__keep_id", "__keep_th").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(several).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold windows of two benchmark items or more; cuts the words of a single item's windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets."""
    return pii.redact(docs)


#: What the last stage adds; columns of these names in its input give way.
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies and the words taken."""
    found = mixing.mix(docs).select(F.col("id").alias("__mix_id"), F.col("source").alias("__mix_source"), *ADDED).filter("copies > 0").distinct()
    docs = docs.drop(*ADDED)
    same = docs["doc_id"].eqNullSafe(F.col("__mix_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (mixing.word_count(docs["text"]) == F.col("size"))
    return docs.join(found, same).drop("__mix_id", "__mix_source")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Language ID is a trained classifier and SimHash needs XXH64: SQL can't state them. Tests compare stages with plain rules of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch(spark)}/rangeweave/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
