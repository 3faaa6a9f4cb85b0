"""A corpus, from raw documents to shuffled shards: five operators one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from graphloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold. Null and empty texts stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints join, and a similarity of 0.8 or more over five words, one with the smallest doc_id.

    Rows without an id stay. Texts that are not similar all stay, under one doc_id too.
    """
    groups = simhash.near_copies(docs)
    first = groups.groupBy("fp_class", "class").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("_text_hash"))
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = keyed.join(first, ["doc_id", "_text_hash"], "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.passages(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    found = found.select(F.xxhash64("doc_id").alias("_decon_id"), F.col("text_hash").alias("_decon_hash")).distinct()
    keyed = docs.withColumn("_decon_id", F.xxhash64("doc_id")).withColumn("_decon_hash", F.xxhash64("text"))
    return keyed.join(found, ["_decon_id", "_decon_hash"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and with the words, as the mix takes."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shuffled documents, with shard and slot."""
    return sharding.shuffle_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: A trained classifier and seeded shuffles: SQL can't say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
