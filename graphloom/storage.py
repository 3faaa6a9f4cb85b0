"""The shared folder, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes a query's shuffle files when the query has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How many files a task may write at once, without sorting its rows by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Of the graph's slices and tables, which are read a few times at most.
CODEC = "zstd"


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and every executor see; removed when the driver's JVM ends.

    It lies in spark.checkpoint.dir. Where that is unset, a temporary folder stands in on a single machine (master
    local[...]); on a cluster, which would write to as many folders as it has machines, this raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/graphloom-checkpoints"
    fs, path = _path(spark, f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    for folders in _scratch:
        folders.append(path)
    return path.toString()


_scratch: list[list] = []


@contextmanager
def scratch(spark: SparkSession):
    """What is put into shared folders inside is deleted at the end: for tables that nothing reads afterwards."""
    folders: list = []
    _scratch.append(folders)
    try:
        yield
    finally:
        _scratch.remove(folders)
        for path in folders:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a table written in the shared folder: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark) + "/t"
    with settings(spark, **{CLEANUP: "true"}):
        df.write.option("compression", codec).parquet(folder)
    stored = spark.read.schema(df.schema).parquet(folder)
    stored.stored_in = folder
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes tables that store() returned and that nothing reads any more."""
    for table in tables:
        fs, path = _path(table.sparkSession, table.stored_in)
        fs.delete(path.getParent(), True)


class Slices:
    """Rows dealt by the hash of a key into n stored parts. Tables that are dealt by the same key meet part by part, so that
    a join's shuffle files are those of one part at a time."""

    def __init__(self, spark: SparkSession, schema, n: int):
        self.spark, self.schema, self.n = spark, schema, n
        self.folder = shared_folder(spark)
        for j in range(n):
            fs, path = self._part(j)
            fs.mkdirs(path)

    @classmethod
    def of(cls, df: DataFrame, key: str, n: int) -> Slices:
        out = cls(df.sparkSession, df.schema, n)
        out.add(df, key)
        return out

    def _part(self, j: int):
        return _path(self.spark, f"{self.folder}/_slice={j}")

    def add(self, df: DataFrame, key: str) -> None:
        dealt = df.select(*[f.name for f in self.schema.fields], F.pmod(F.xxhash64(key), F.lit(self.n)).alias("_slice"))
        with settings(self.spark, **{CLEANUP: "true", WRITERS: str(self.n)}):
            dealt.write.mode("append").option("compression", CODEC).partitionBy("_slice").parquet(self.folder)

    def __getitem__(self, j: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._part(j)[1].toString())

    def whole(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self._part(j)[1].toString() for j in range(self.n)])

    def drop(self, j: int | None = None) -> None:
        for k in range(self.n) if j is None else [j]:
            fs, path = self._part(k)
            fs.delete(path, True)
