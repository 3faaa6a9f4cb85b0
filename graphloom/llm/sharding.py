"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash into buckets that one task can hold. Pass two sorts a bucket into a fixed
order and applies a seeded Fisher-Yates shuffle. The buckets one after the other are the shuffled whole; shards are even
cuts of it, so their counts differ by one at most (law `rows`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import shared_folder

SHARDS = 24
#: A bucket's mean bytes and rows in memory.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 4096
LAW = "rows"


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """Places 0..n-1 in a seeded random order; numpy's in-place shuffle is the Fisher-Yates one."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def shuffled(records: DataFrame, key: list[str], size: Column, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """records with shard (0 to shards-1) and slot (from 0, without gaps in its shard).

    key: columns that tell rows apart and fix the order before the shuffle; rows alike in all of them are
    interchangeable. Nulls are values like others. size: a row's bytes. Columns named shard or slot give way to the new ones. Same rows, same result, at any partitioning.
    Whole records move once: a bucket's place in the whole comes to it in a cogroup. Names that begin with _sh_ are taken.
    """
    records = records.drop("shard", "slot")
    total = records.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n = total["n"]
    buckets = max(1, -(-n // BUCKET_ROWS), -(-int(total["b"]) // BUCKET_BYTES))
    scattered = records.withColumn("_sh_h", F.xxhash64(*key, F.lit(seed))).withColumn("_sh_bucket", F.pmod("_sh_h", F.lit(buckets)).cast("int"))
    counts = scattered.groupBy("_sh_bucket").agg(F.count("*").alias("_sh_n"))
    offsets = counts.select("_sh_bucket", (F.sum("_sh_n").over(W.orderBy("_sh_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sh_n")).alias("_sh_offset"))
    schema = T.StructType([*records.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    order = [("_sh_h", "ascending"), *((k, "ascending") for k in key)]

    def shuffle(bucket: pa.Table, offset: pa.Table) -> pa.Table:
        # Sorting moves row numbers, not records.
        sorted_rows = bucket.select([k for k, _ in order]).append_column("_sh_row", pa.array(np.arange(len(bucket)))).sort_by(order)["_sh_row"].to_numpy()
        at = np.empty(len(bucket), dtype=np.int64)
        at[sorted_rows] = fisher_yates(len(bucket), seed * 1_000_003 + bucket["_sh_bucket"][0].as_py()) + offset["_sh_offset"][0].as_py()
        shard = ((at + 1) * shards - 1) // n
        out = bucket.drop_columns(["_sh_h", "_sh_bucket"]).append_column("shard", pa.array(shard.astype(np.int32)))
        return out.append_column("slot", pa.array(at - shard * n // shards))

    return scattered.groupBy("_sh_bucket").cogroup(offsets.groupBy("_sh_bucket")).applyInArrow(shuffle, schema)


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (with shard and slot) as Parquet, a folder a shard, each file by slot; returns what is read back.

    A bucket lies in one shard or two, so that tasks write few files and records need no second exchange.
    """
    records.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return records.sparkSession.read.schema(records.schema).parquet(folder)


def shuffle_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """docs (with doc_id and text, and whatever else) with shard and slot; null texts count as empty in a record's bytes."""
    keyed = docs.withColumn("_sh_text", F.xxhash64("text"))
    return shuffled(keyed, ["doc_id", "_sh_text"], record_bytes(F.col("text")), shards, seed).drop("_sh_text")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Writes all documents into shards and describes what the shards hold: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts have no bytes and the check sum of the empty text. An empty table gives no rows. Other columns are left aside.
    """
    written = write_shards(shuffle_documents(docs.select("doc_id", "text"), shards, seed), shared_folder(docs.sparkSession) + "/shards")
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return written.select("doc_id", record_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
