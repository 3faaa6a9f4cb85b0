"""The graph's schema: record, node and edge tables, and which kinds an edge may join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULE, STRUCT, FUNCTION, FILE, UNRESOLVED = "Module", "Struct", "Function", "File", "UnresolvedTarget"
KINDS = (MODULE, STRUCT, FUNCTION, FILE, UNRESOLVED)
CONTAINS, CALLS, USES, UNRESOLVED_CALL, UNRESOLVED_USE = "Contains", "Calls", "Uses", "UnresolvedCall", "UnresolvedUse"
RELS = (CONTAINS, CALLS, USES, UNRESOLVED_CALL, UNRESOLVED_USE)

#: rel -> (source kind, target kind) pairs that it may join.
ALLOWED = {
    CONTAINS: ((MODULE, MODULE), (MODULE, FILE), (FILE, STRUCT), (FILE, FUNCTION), (STRUCT, STRUCT), (STRUCT, FUNCTION)),
    CALLS: ((FUNCTION, FUNCTION),),
    USES: ((FUNCTION, STRUCT), (STRUCT, STRUCT)),
    UNRESOLVED_CALL: ((FUNCTION, UNRESOLVED),),
    UNRESOLVED_USE: ((FUNCTION, UNRESOLVED), (STRUCT, UNRESOLVED)),
}

#: Record type -> fields that must be there.
MANDATORY = {
    "module": ("fqn",),
    "struct": ("id", "parent", "name", "path", "start", "end", "start_line", "end_line"),
    "function": ("id", "parent", "name", "path", "start", "end", "start_line", "end_line"),
    "file": ("path", "start_line", "end_line"),
    "unresolved": ("fqn",),
    "contains": ("from", "to"),
    "calls": ("from", "to"),
    "uses": ("from", "to"),
    "unresolved_call": ("from", "to"),
    "unresolved_use": ("from", "to"),
}
EDGE_TYPES = {"contains": CONTAINS, "calls": CALLS, "uses": USES, "unresolved_call": UNRESOLVED_CALL, "unresolved_use": UNRESOLVED_USE}
NUMBERS = ("start", "end", "start_line", "end_line")

_text, _long = T.StringType(), T.LongType()
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, _text) for n in ("type", "fqn", "id", "parent", "name")]
    + [T.StructField("params", T.ArrayType(_text)), T.StructField("path", _text), T.StructField("file", _text)]
    + [T.StructField(n, _long) for n in NUMBERS]
    + [T.StructField(n, _text) for n in ("category", "from", "to", "target_type")]
)
#: A record and its place in the stream, which decides what comes first.
SEQUENCED_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("seq", _long)])
NODE_SCHEMA = T.StructType([T.StructField("fqn", _text), T.StructField("kind", _text), T.StructField("path", _text), *[T.StructField(n, _long) for n in NUMBERS], T.StructField("category", _text), T.StructField("code_type", _text)])
EDGE_SCHEMA = T.StructType([T.StructField(n, _text) for n in ("src", "dst", "rel", "src_kind", "dst_kind", "target_type")])

#: Columns of the published node tables.
NODE_TABLES = {
    MODULE: ("fqn",),
    STRUCT: ("fqn", "path", "start", "end", "start_line", "end_line", "code_type"),
    FUNCTION: ("fqn", "path", "start", "end", "start_line", "end_line", "code_type"),
    FILE: ("fqn", "start_line", "end_line", "code_type"),
    UNRESOLVED: ("fqn", "category"),
}


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    #: Whether it is known that the ends of all edges are nodes, and that no two nodes bear one name.
    closed = False

    def tables(self):
        """ "nodes" or "edges" and a table of them, all in turn; a table may be gone when the next one is asked for."""
        yield "nodes", self.nodes
        yield "edges", self.edges

    def nodes_of(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def edges_of(self, rel: str, src_kind: str | None = None, dst_kind: str | None = None) -> DataFrame:
        df = self.edges.where(F.col("rel") == rel)
        for column, kind in (("src_kind", src_kind), ("dst_kind", dst_kind)):
            if kind:
                df = df.where(F.col(column) == kind)
        return df


@dataclass
class IngestOptions:
    language: str = ""
    blacklist: tuple[str, ...] = ()
    config: object | None = None


@dataclass
class CleanupOptions:
    language: str = ""
    excludes: tuple[str, ...] = field(default_factory=tuple)
