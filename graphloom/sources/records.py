"""Record streams as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import MANDATORY, NUMBERS, RECORD_SCHEMA

MAX_NUMBER = 2**32 - 1


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with seq, their place: by file, place in the file, and line. Malformed lines and invalid records fail the job.

    Blank lines are no records. Unknown fields are left aside.
    """
    raw = spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)
    return validated(sequenced(raw))


def sequenced(records: DataFrame) -> DataFrame:
    """Spark deals out files by size: a record's place is its file, its split's start, and its number within the task."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("nth"))
    marked = records.select("*", place.alias("_place"))
    starts = marked.groupBy("_place.file", "_place.at").agg(F.min("_place.nth").alias("first"), F.count("*").alias("n"))
    from pyspark.sql import Window as W

    earlier = F.sum("n").over(W.orderBy("file", "at").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    offsets = starts.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "first", earlier.alias("before"))
    joined = marked.join(offsets, (F.col("_place.file") == F.col("_file")) & (F.col("_place.at") == F.col("_at")))
    return joined.select(*records.columns, (F.col("before") + F.col("_place.nth") - F.col("first")).alias("seq"))


def problem_of(prefix: str = ""):
    """What is wrong with a record, or null."""
    missing = F.when(F.col("type").isNull() | ~F.col("type").isin(*MANDATORY), F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("null"))))
    for kind, fields in MANDATORY.items():
        for name in fields:
            missing = missing.when((F.col("type") == kind) & F.col(name).isNull(), f"{kind} without {name}")
    for name in NUMBERS:
        missing = missing.when((F.col(name) < 0) | (F.col(name) > MAX_NUMBER), f"{name} out of range")
    return missing


def validated(records: DataFrame) -> DataFrame:
    """The same rows; a record that is not valid raises when it is read. Missing optional fields get their defaults."""
    problem = problem_of()
    kind = F.when(problem.isNull(), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("bad record: "), problem)).cast("string"))
    defaults = {"params": F.coalesce("params", F.array().cast("array<string>")), "file": F.coalesce("file", F.lit("")), "target_type": F.coalesce("target_type", F.lit(""))}
    defaults["parent"] = F.when(F.col("type") == "file", F.coalesce("parent", F.lit(""))).otherwise(F.col("parent"))
    return records.withColumns({**defaults, "type": kind})
