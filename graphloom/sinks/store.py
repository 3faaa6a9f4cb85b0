"""Graphs at rest: Parquet partitioned by kind and by relation, JSON lines, CSV lines; and reading them back."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import csv_field
from graphloom.model import ALLOWED, EDGE_SCHEMA, FILE, FUNCTION, MODULE, NODE_SCHEMA, NODE_TABLES, RELS, STRUCT, UNRESOLVED, UNRESOLVED_CALL, Graph
from graphloom.storage import CLEANUP, Slices, settings

#: JSON line type of each kind and relation.
LINE_TYPES = {MODULE: "module", STRUCT: "struct", FUNCTION: "function", FILE: "file", UNRESOLVED: "unresolved", "Contains": "contains", "Calls": "calls", "Uses": "uses", "UnresolvedCall": "unresolved_call", "UnresolvedUse": "unresolved_use"}


#: Rows of a stored file, about.
FILE_ROWS = 1_000_000
#: The file that names a store's current version.
CURRENT = "_current"


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def replace_folder(spark: SparkSession, staged: str, folder: str) -> None:
    """Puts a fully written folder in another's place. If that fails, the old one is put back. For a moment there is none."""
    (fs, new), (_, old) = _fs(spark, staged), _fs(spark, folder)
    _, aside = _fs(spark, f"{folder}.{uuid.uuid4().hex}.old")
    fs.mkdirs(old.getParent())
    if not fs.exists(new):
        raise FileNotFoundError(staged)
    held, put = fs.exists(old) and fs.rename(old, aside), False
    try:
        put = not fs.exists(old) and fs.rename(new, old)
    finally:
        if held and not put:
            fs.rename(aside, old)
    if not put:
        raise OSError(f"cannot put {staged} at {folder}")
    fs.delete(aside, True)


def _publish(spark: SparkSession, folder: str, version: str) -> None:
    """Lets a store's name of its current version change from one to another, in one step."""
    jvm = spark.sparkContext._jvm
    fs, staged = _fs(spark, f"{folder}/{CURRENT}.{version}")
    _, current = _fs(spark, f"{folder}/{CURRENT}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(current).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    jvm.java.lang.reflect.Array.set(options, 0, kind.getField("OVERWRITE").get(None))
    context.rename(fs.makeQualified(staged), fs.makeQualified(current), options)


def current_version(spark: SparkSession, folder: str) -> str:
    fs, path = _fs(spark, f"{folder}/{CURRENT}")
    data = fs.open(path)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def _parts(df: DataFrame, *keys: str):
    """How many files each value of the keys gets, as a column, and in all."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).collect()
    out, total = F.lit(1), 0
    for r in counts:
        n = -(-r["n"] // FILE_ROWS)
        total += n
        if n > 1:
            out = F.when(reduce(and_, [F.col(k) == r[k] for k in keys]), n).otherwise(out)
    return out, max(1, total)


def filled(nodes: DataFrame) -> DataFrame:
    """Nodes as a store has them: no null path, category or place."""
    return nodes.withColumns({"path": F.coalesce("path", F.lit("")), "category": F.coalesce("category", F.lit("")), **{n: F.coalesce(n, F.lit(0)) for n in ("start", "end", "start_line", "end_line")}})


def write_store(graph: Graph, folder: str) -> None:
    """nodes by kind and edges by relation and kinds, so that a query reads the partitions that it names, in files of FILE_ROWS.

    A store is a folder of versions and a file that names the current one. Readers that have opened a version go on with
    it: the version before the new one stays, older ones go. A write that fails changes nothing.
    """
    spark = graph.nodes.sparkSession
    version = uuid.uuid4().hex
    for df, name, keys, spread in ((filled(graph.nodes), "nodes", ["kind"], "fqn"), (graph.edges, "edges", ["rel", "src_kind", "dst_kind"], "src")):
        parts, total = _parts(df, *keys)
        dealt = df.repartition(total, *keys, F.pmod(F.xxhash64(spread), parts))
        dealt.write.option("compression", "snappy").partitionBy(*keys).parquet(f"{folder}/{version}/{name}")
    fs, path = _fs(spark, folder)
    before = current_version(spark, folder) if fs.exists(_fs(spark, f"{folder}/{CURRENT}")[1]) else None
    _publish(spark, folder, version)
    for status in fs.listStatus(path):
        if status.isDirectory() and status.getPath().getName() not in (version, before):
            fs.delete(status.getPath(), True)


def read_store(spark: SparkSession, folder: str) -> Graph:
    version = current_version(spark, folder)
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/{version}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{folder}/{version}/edges"))


def node_table(graph: Graph, kind: str) -> DataFrame:
    return graph.nodes.where(F.col("kind") == kind).select(*NODE_TABLES[kind])


def edge_table(graph: Graph, rel: str, src_kind: str | None = None, dst_kind: str | None = None) -> DataFrame:
    df = graph.edges.where(F.col("rel") == rel)
    if src_kind:
        df = df.where(F.col("src_kind") == src_kind)
    if dst_kind:
        df = df.where(F.col("dst_kind") == dst_kind)
    more = ["target_type"] if rel == UNRESOLVED_CALL else []
    return df.select(F.col("src").alias("from"), F.col("dst").alias("to"), *more)


def register_views(graph: Graph) -> list[str]:
    """A temporary view for each node and edge table."""
    for kind in NODE_TABLES:
        node_table(graph, kind).createOrReplaceTempView(kind)
    for rel in RELS:
        edge_table(graph, rel).createOrReplaceTempView(rel)
    return [*NODE_TABLES, *RELS]


def edge_pairs() -> list[tuple[str, str, str]]:
    return [(rel, a, b) for rel, pairs in ALLOWED.items() for a, b in pairs]


def json_lines(what: str, table: DataFrame) -> DataFrame:
    """value: a line for each of the nodes or edges, tagged by type, by FQN alone. Fields that a type lacks are left out of its lines."""
    types = F.create_map(*[F.lit(x) for p in LINE_TYPES.items() for x in p])
    kind = F.col("kind")
    located, spanned = kind.isin(STRUCT, FUNCTION, FILE), kind.isin(STRUCT, FUNCTION)
    node = F.struct(
        F.element_at(types, kind).alias("type"), "fqn", F.when(spanned, F.col("path")).alias("path"), F.when(spanned, F.col("start")).alias("start"), F.when(spanned, F.col("end")).alias("end"),
        F.when(located, F.col("start_line")).alias("start_line"), F.when(located, F.col("end_line")).alias("end_line"), F.when(located, F.col("code_type")).alias("code_type"),
        F.when(kind == UNRESOLVED, F.coalesce("category", F.lit(""))).alias("category"),
    )
    edge = F.struct(F.element_at(types, F.col("rel")).alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.when(F.col("rel") == UNRESOLVED_CALL, F.col("target_type")).alias("target_type"))
    return table.select(F.to_json(node if what == "nodes" else edge).alias("value"))


def write_jsonl(graph: Graph, folder: str, compression: str = "none") -> None:
    """The lines in a folder that takes an older one's place when it is fully written; table by table, as the graph has them."""
    staged = f"{folder}.{uuid.uuid4().hex}.new"
    for what, table in graph.tables():
        spark = table.sparkSession
        with settings(spark, **{CLEANUP: "true"}):
            json_lines(what, table).write.mode("append").option("compression", compression).text(staged)
    replace_folder(spark, staged, folder)


def kinds_by_slices(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """with_kinds(edges, nodes), joined in n slices and stored, so that the shuffle files are those of one slice at a time."""
    named, out = Slices.of(nodes.select("fqn", "kind"), "fqn", n), Slices.of(edges, "src", n)
    for end in ("src", "dst"):
        found = None
        for j in range(n):
            met = out[j].join(named[j].select(F.col("fqn").alias(end), F.col("kind").alias(f"{end}_kind")), end)
            found = found or Slices(edges.sparkSession, met.schema, n)
            found.add(met, "dst")
            out.drop(j)
        out = found
    named.drop()
    return out.whole().select(*[f.name for f in EDGE_SCHEMA])


def read_jsonl(spark: SparkSession, folder: str, slices: int | None = None) -> Graph:
    """The graph that write_jsonl left, kinds of edge ends looked up again; by kinds_by_slices, when slices are given."""
    from graphloom.plans.ingest import with_kinds

    schema = "type string, fqn string, path string, start long, `end` long, start_line long, end_line long, code_type string, category string, `from` string, `to` string, target_type string"
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    names = {v: k for k, v in LINE_TYPES.items()}
    label = F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("type"))
    is_file = F.col("type") == "file"
    spans = {n: F.when(is_file, F.lit(0)).otherwise(F.col(n)).cast("long") for n in ("start", "end")}
    nodes = lines.where("fqn IS NOT NULL").withColumn("kind", label).withColumns({"path": F.when(is_file, F.col("fqn")).otherwise(F.col("path")), "code_type": F.coalesce("code_type", F.lit("")), **spans})
    nodes = nodes.select(*[f.name for f in NODE_SCHEMA])
    edges = lines.where("fqn IS NULL").select(F.col("from").alias("src"), F.col("to").alias("dst"), label.alias("rel"), F.coalesce("target_type", F.lit("")).alias("target_type"))
    return Graph(nodes, kinds_by_slices(edges, nodes, slices) if slices else with_kinds(edges, nodes))


def csv_lines(df: DataFrame) -> DataFrame:
    """value: each row as a CSV line; arrays print as [a,b]."""
    def text(name: str, kind: str):
        column = F.col(f"`{name}`")
        return F.concat(F.lit("["), F.array_join(column, ","), F.lit("]")) if kind.startswith("array") else column

    return df.select(F.concat_ws(",", *[csv_field(text(n, k)) for n, k in df.dtypes]).alias("value"))


def csv_header(df: DataFrame) -> str:
    return ",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if any(c in n for c in ',"\n') else n for n in df.columns)
