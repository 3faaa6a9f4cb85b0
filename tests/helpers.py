"""Records and graphs for small scenarios."""

from graphloom.model import SEQUENCED_SCHEMA, IngestOptions
from graphloom.plans.ingest import Ingest


def module(fqn):
    return {"type": "module", "fqn": fqn}


def struct(id, parent, name, path="/x/A.java", span=(0, 50), lines=(1, 50)):
    return {"type": "struct", "id": id, "parent": parent, "name": name, "path": path, "start": span[0], "end": span[1], "start_line": lines[0], "end_line": lines[1]}


def function(id, parent, name, params=(), path="/x/A.java", file="", span=(0, 50), lines=(1, 50)):
    return {**struct(id, parent, name, path, span, lines), "type": "function", "params": list(params), "file": file}


def file(path, parent="", lines=(1, 50)):
    return {"type": "file", "path": path, "parent": parent, "start_line": lines[0], "end_line": lines[1]}


def unresolved(fqn, category=None):
    return {"type": "unresolved", "fqn": fqn, "category": category}


def edge(kind, src, dst, target_type=""):
    return {"type": kind, "from": src, "to": dst, "target_type": target_type}


def frame(spark, rows):
    names = SEQUENCED_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple({**r, "seq": k}.get(n) for n in names) for k, r in enumerate(rows)], SEQUENCED_SCHEMA)


def ingest(spark, rows, language="java", blacklist=(), config=None):
    return Ingest(frame(spark, rows), IngestOptions(language, tuple(blacklist), config))


def kinds(graph):
    return {r["fqn"]: r["kind"] for r in graph.nodes.collect()}


def links(graph, rel=None):
    return {(r["rel"], r["src"], r["dst"]) for r in graph.edges.collect() if rel in (None, r["rel"])}
