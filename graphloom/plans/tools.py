"""Ready-made lookups on a graph. Each takes the graph and returns a DataFrame; code_type narrows it where given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import ALLOWED, CALLS, CONTAINS, FILE, FUNCTION, MODULE, STRUCT, UNRESOLVED, UNRESOLVED_CALL, UNRESOLVED_USE, USES, Graph

PLACE = ("fqn", "kind", "path", "start_line", "end_line", "code_type")


def _typed(df: DataFrame, code_type: str | None) -> DataFrame:
    return df.where(F.col("code_type") == code_type) if code_type else df


def _placed(graph: Graph, names: DataFrame, code_type: str | None, *kinds: str) -> DataFrame:
    """names: fqn. What is known of each, of nodes of these kinds."""
    return _typed(graph.nodes_of(*kinds).join(names, "fqn", "left_semi").select(*PLACE), code_type)


def _contained(graph: Graph, parent: str, *kinds: str) -> DataFrame:
    found = [graph.edges_of(CONTAINS, src_kind, k) for src_kind, k in ALLOWED[CONTAINS] if k in kinds]
    return reduce(DataFrame.unionByName, found).where(F.col("src") == parent).select(F.col("dst").alias("fqn"))


def find_symbol(graph: Graph, part: str, code_type: str | None = None) -> DataFrame:
    return _typed(graph.nodes.where(F.col("fqn").contains(part)).select(*PLACE), code_type)


def modules(graph: Graph) -> DataFrame:
    return graph.nodes_of(MODULE).select("fqn")


def module_files(graph: Graph, module: str, code_type: str | None = None) -> DataFrame:
    return _placed(graph, _contained(graph, module, FILE), code_type, FILE)


def module_structs(graph: Graph, module: str, code_type: str | None = None) -> DataFrame:
    """By way of the module's files: no edge leads from a module to a type."""
    files = _contained(graph, module, FILE).withColumnRenamed("fqn", "src")
    inside = graph.edges_of(CONTAINS, FILE, STRUCT)
    return _placed(graph, inside.join(files, "src", "left_semi").select(F.col("dst").alias("fqn")), code_type, STRUCT)


def file_units(graph: Graph, path: str, code_type: str | None = None) -> DataFrame:
    return _placed(graph, _contained(graph, path, STRUCT, FUNCTION), code_type, STRUCT, FUNCTION)


def file_path(graph: Graph, path: str) -> DataFrame:
    """The module that owns a file."""
    return graph.edges_of(CONTAINS, MODULE).where(F.col("dst") == path).select(F.col("src").alias("module"), F.col("dst").alias("path"))


def methods(graph: Graph, type_name: str, code_type: str | None = None) -> DataFrame:
    return _placed(graph, _contained(graph, type_name, FUNCTION), code_type, FUNCTION)


def struct(graph: Graph, type_name: str, code_type: str | None = None) -> DataFrame:
    """The type and the types nested in it."""
    own = graph.nodes_of(STRUCT).where(F.col("fqn") == type_name).select("fqn")
    return _placed(graph, own.unionByName(_contained(graph, type_name, STRUCT)), code_type, STRUCT)


def callers(graph: Graph, function: str, code_type: str | None = None) -> DataFrame:
    return _placed(graph, graph.edges_of(CALLS).where(F.col("dst") == function).select(F.col("src").alias("fqn")), code_type, FUNCTION)


def callees(graph: Graph, function: str, code_type: str | None = None) -> DataFrame:
    return _placed(graph, graph.edges_of(CALLS).where(F.col("src") == function).select(F.col("dst").alias("fqn")), code_type, FUNCTION)


def uses(graph: Graph, unit: str, code_type: str | None = None) -> DataFrame:
    """Uses edges out of and into a unit: direction and the other end."""
    edges = graph.edges_of(USES)
    out = edges.where(F.col("src") == unit).select(F.lit("out").alias("direction"), F.col("dst").alias("fqn"))
    into = edges.where(F.col("dst") == unit).select(F.lit("in").alias("direction"), F.col("src").alias("fqn"))
    return _typed(out.unionByName(into).join(graph.nodes_of(STRUCT, FUNCTION), "fqn").select("direction", *PLACE), code_type)


def unresolved(graph: Graph, unit: str, code_type: str | None = None) -> DataFrame:
    """Unresolved calls and uses of a unit, or of all units of a file."""
    inside = graph.edges_of(CONTAINS, FILE).where(F.col("src") == unit).select(F.col("dst").alias("src"))
    units = inside.unionByName(_typed(graph.nodes.where(F.col("fqn") == unit), code_type).select(F.col("fqn").alias("src"))).distinct()
    if code_type:
        units = units.join(_typed(graph.nodes, code_type).select(F.col("fqn").alias("src")), "src", "left_semi")
    edges = graph.edges_of(UNRESOLVED_CALL).unionByName(graph.edges_of(UNRESOLVED_USE)).join(units, "src", "left_semi")
    return edges.join(graph.nodes_of(UNRESOLVED).select(F.col("fqn").alias("dst"), "category"), "dst").select("src", "rel", "dst", "category", "target_type")


def hunk(graph: Graph, path: str, low: int, high: int, code_type: str | None = None) -> DataFrame:
    """Units of a file that overlap lines low to high, both inclusive."""
    hit = (F.col("path") == path) & (F.col("start_line") <= high) & (F.col("end_line") >= low)
    return _typed(graph.nodes_of(STRUCT, FUNCTION).where(hit).select(*PLACE), code_type)


def hunks(graph: Graph, ranges: DataFrame) -> DataFrame:
    """ranges: path, low, high. All units that overlap each range: an equi-join on path with the rest as its condition."""
    units = graph.nodes_of(STRUCT, FUNCTION).select("path", "fqn", "kind", "start_line", "end_line")
    return ranges.join(units, "path").where((F.col("start_line") <= F.col("high")) & (F.col("end_line") >= F.col("low"))).select("path", "low", "high", "fqn", "kind")
