"""Records that keep arriving: JSON lines in a folder, appended to a table of all records; the graph is rebuilt per batch.

Names are not monotone (a second function of a name renames the first), so a graph can't be appended to. A batch appends
its records under its number, and the graph of all records replaces the published one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import RECORD_SCHEMA, SEQUENCED_SCHEMA
from graphloom.plans.scan import build
from graphloom.sinks import store as sink
from graphloom.sources.records import validated
from graphloom.storage import store


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("mode", "FAILFAST").json(folder)


def numbered(records: DataFrame, base: int) -> DataFrame:
    """records with seq: base, base + 1, ... in the order of their tasks and of the rows in them, which a stored table fixes."""
    placed = store(records.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    row = F.col("_at") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(counts), part == F.col("_part")).withColumn("seq", F.lit(base) + F.col("_before") + row).drop("_at", "_part", "_n", "_before")  # a row a task


def start(spark: SparkSession, source: str, table: str, published: str, state: str, language: str, blacklist=(), excludes=(), config=None, files_per_trigger: int = 1000, once: bool = False):
    """The running query. source: folder of JSON lines; table: all records so far; published: the graph's store; state: the
    query's checkpoint. A batch that runs again overwrites what its first run left."""

    def batch(df: DataFrame, number: int) -> None:
        spark, names = df.sparkSession, [f.name for f in SEQUENCED_SCHEMA]
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        earlier = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        before = spark.read.schema(T.StructType([*SEQUENCED_SCHEMA.fields, T.StructField("batch", T.LongType())])).parquet(table).where(F.col("batch") < number).agg(F.max("seq")).first()[0] if earlier else None
        numbered(validated(df), 0 if before is None else before + 1).select(*names).write.mode("overwrite").parquet(f"{table}/batch={number}")
        every = spark.read.schema(SEQUENCED_SCHEMA).parquet(table).select(*names)
        graph, _ = build(every, language, blacklist, excludes, config)
        sink.write_store(graph, published)

    writer = arriving(spark, source, files_per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
