import json

import pytest

from graphloom.model import ALLOWED
from graphloom.plans import tools
from graphloom.plans.cypher import QueryError, query
from graphloom.sinks import store as sink

from .helpers import edge, file, function, ingest, kinds, links, module, struct, unresolved

ROWS = [
    module("m"), module("m.n"), file("/x/a.go", "m"), struct("n1", "m", "A", "/x/a.go"), struct("n5", "m.A", "In", "/x/a.go"), function("n2", "m.A", "f", ["int"], "/x/a.go", lines=(5, 9)), function("n3", "m.A", "f", [], "/x/a.go", lines=(10, 12)),
    unresolved("fmt.P", "stdlib"), edge("contains", "m", "m.n"), edge("contains", "n1", "n2"), edge("contains", "n1", "n3"), edge("contains", "n1", "n5"), edge("calls", "n2", "n3"), edge("uses", "n2", "n1"), edge("uses", "n5", "n1"),
    edge("unresolved_call", "n2", "fmt.P", "func(int)"), edge("unresolved_use", "n1", "fmt.P"), edge("unresolved_use", "n2", "fmt.P"),
]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store") / "graph")
    built = ingest(spark, ROWS, "go").graph
    sink.write_store(built, folder)
    sink.write_store(built, folder)  # replaces what is there
    return sink.read_store(spark, folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_keeps_the_graph(spark, graph):
    want = ingest(spark, ROWS, "go").graph
    assert kinds(graph) == kinds(want) and links(graph) == links(want)
    assert {(r["rel"], r["src_kind"], r["dst_kind"]) for r in graph.edges.collect()} == {(rel, a, b) for rel, pairs in ALLOWED.items() for a, b in pairs}
    row = graph.nodes.where("fqn = 'm.A'").first()
    assert (row["start"], row["end"], row["start_line"], row["end_line"]) == (0, 50, 1, 50)
    assert rows(sink.edge_table(graph, "UnresolvedCall")) == [("m.A.f(int)", "fmt.P", "func(int)")]


def test_pattern_queries(graph):
    assert rows(query(graph, "MATCH (s:Struct) RETURN s.fqn, s.code_type")) == [("m.A", "src"), ("m.A.In", "src")]
    assert rows(query(graph, "MATCH (f:Function)-[:Calls]->(t:Function) RETURN f.fqn, t.fqn;")) == [("m.A.f(int)", "m.A.f()")]
    assert rows(query(graph, "MATCH (m:Module)-[:Contains]->(f:File)-[:Contains]->(n) RETURN m.fqn, count(*)")) == [("m", 4)]
    assert rows(query(graph, "MATCH (n)-[:Contains]->(x:Function) WHERE x.start_line > 5 RETURN n.fqn, x.`end_line`")) == [("/x/a.go", 12), ("m.A", 12)]
    assert rows(query(graph, "MATCH (f)-[:UnresolvedUse]->(u) RETURN u.fqn, count(f) ORDER BY 2 DESC LIMIT 20")) == [("fmt.P", 2)]
    assert rows(query(graph, "MATCH (f:File {fqn: '/x/a.go'})-[:Contains]->(n:Function) RETURN n.fqn AS name")) == [("m.A.f()",), ("m.A.f(int)",)]
    assert [r[0] for r in query(graph, "MATCH (n) WHERE n.fqn = 'm.A' RETURN labels(n)").collect()] == [["Struct"]]
    assert rows(query(graph, "MATCH (s:Struct)<-[r:Uses]-(x) RETURN type(r), x.fqn")) == [("Uses", "m.A.In"), ("Uses", "m.A.f(int)")]
    assert rows(query(graph, "MATCH (a:Function)-[:Calls]->(b), (a)-[:Uses]->(s) RETURN b.fqn, s.fqn")) == [("m.A.f()", "m.A")]
    assert rows(query(graph, "MATCH (n:Function) RETURN DISTINCT n.path ORDER BY n.path")) == [("/x/a.go",)]
    assert query(graph, "MATCH (n:Module) RETURN n.fqn LIMIT 1").columns == ["n.fqn"]
    assert rows(query(graph, "MATCH (n:Function) WHERE n.fqn IN ['x'] OR n.fqn ENDS WITH '()' AND n.path IS NOT NULL RETURN n.fqn GROUP BY n.fqn")) == [("m.A.f()",)]
    assert rows(query(graph, "MATCH (m:Module)-[:Contains*2..3]->(f:Function) RETURN m.fqn, f.fqn, count(*)")) == [("m", "m.A.f()", 2), ("m", "m.A.f(int)", 2)]
    assert query(graph, "MATCH (n)-[:Contains]->(m) RETURN n.fqn ORDER BY m.fqn DESC SKIP 1 LIMIT 2").count() == 2


@pytest.mark.parametrize("text", ["CREATE (n:Module)", "MATCH (n) DELETE n", "MATCH (n:Nope) RETURN n", "MATCH (n) RETURN n.nope", "MATCH (n) RETURN m.fqn", "MATCH (n RETURN n", "MATCH (n:Module) RETURN n.path", "MATCH (n), (m) RETURN n.fqn", "MATCH (n) RETURN n.fqn ORDER BY 2", "MATCH (n) RETURN nope(n)", "MATCH (n)-[:Calls*]->(m) RETURN n.fqn", "MATCH (n)-[:Calls*2..99]->(m) RETURN n.fqn", "MATCH (n)-[:Nope]->(m) RETURN n.fqn"])
def test_bad_queries(graph, text):
    with pytest.raises(QueryError):
        query(graph, text).collect()


def test_patterns_read_the_partitions_they_name(graph):
    plan = query(graph, "MATCH (f:Function)-[:Calls]->(t:Function) RETURN f.fqn, t.fqn")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan


def test_tools(graph):
    fqns = lambda df: sorted(r["fqn"] for r in df.collect())
    assert fqns(tools.find_symbol(graph, "In")) == ["m.A.In"]
    assert fqns(tools.modules(graph)) == ["m", "m.n"]
    assert fqns(tools.module_files(graph, "m")) == ["/x/a.go"] and fqns(tools.module_structs(graph, "m")) == ["m.A", "m.A.In"]
    assert fqns(tools.file_units(graph, "/x/a.go")) == ["m.A", "m.A.In", "m.A.f()", "m.A.f(int)"]
    assert rows(tools.file_path(graph, "/x/a.go")) == [("m", "/x/a.go")]
    assert fqns(tools.methods(graph, "m.A")) == ["m.A.f()", "m.A.f(int)"] and fqns(tools.struct(graph, "m.A")) == ["m.A", "m.A.In"]
    assert fqns(tools.callers(graph, "m.A.f()")) == ["m.A.f(int)"] and fqns(tools.callees(graph, "m.A.f(int)")) == ["m.A.f()"]
    assert {(r["direction"], r["fqn"]) for r in tools.uses(graph, "m.A").collect()} == {("in", "m.A.f(int)"), ("in", "m.A.In")}
    assert {(r["src"], r["rel"]) for r in tools.unresolved(graph, "/x/a.go").collect()} == {("m.A.f(int)", "UnresolvedCall"), ("m.A", "UnresolvedUse"), ("m.A.f(int)", "UnresolvedUse")}
    assert {r["src"] for r in tools.unresolved(graph, "m.A").collect()} == {"m.A"}
    assert fqns(tools.hunk(graph, "/x/a.go", 9, 9)) == ["m.A", "m.A.In", "m.A.f(int)"]
    assert fqns(tools.find_symbol(graph, "m", "test")) == []


def test_export_and_reimport(spark, graph, tmp_path):
    sink.write_jsonl(graph, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == graph.nodes.count() + graph.edges.count() and all("type" in x for x in lines)
    assert {"type": "unresolved", "fqn": "fmt.P", "category": "stdlib"} in lines and {"type": "module", "fqn": "m"} in lines
    assert {"type": "unresolved_call", "from": "m.A.f(int)", "to": "fmt.P", "target_type": "func(int)"} in lines
    again = sink.read_jsonl(spark, str(tmp_path / "out"))
    assert kinds(again) == kinds(graph) and links(again) == links(graph)


def test_views_and_csv(spark, graph):
    assert len(sink.register_views(graph)) == 10
    assert spark.sql("SELECT count(*) AS n FROM Calls").first()["n"] == 1
    df = query(graph, "MATCH (f:Function) RETURN f.fqn, labels(f) ORDER BY 1")
    assert sink.csv_header(df) == "f.fqn,labels(f)"
    assert [r["value"] for r in sink.csv_lines(df).collect()] == ["m.A.f(),[Function]", "m.A.f(int),[Function]"]
