import json
import sys
import time

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import main
from graphloom.operators import resolution
from graphloom.plans.scan import ScanOptions, open_graph, query_csv, scan
from graphloom.sinks import store as sink
from graphloom.sources.command import command_lines
from graphloom.sources.project import Frontends, detect_language, find_workspace, init
from graphloom.sources.records import read_records
from graphloom.streaming import ingest as streaming

from .helpers import edge, file, function, kinds, links, module, struct


def lines(rows):
    return "".join(json.dumps({k: v for k, v in r.items() if v is not None}) + "\n" for r in rows)


ROWS = [module("m"), file("/p/a.go", "m"), struct("n1", "m", "A", "/p/a.go"), function("n2", "m.A", "f", path="/p/a.go"), edge("contains", "n1", "n2")]


def test_records_come_in_order_with_defaults(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"r{k}.jsonl").write_text("\n" + lines([module(f"m{k}.{j}") for j in range(50)]) + '{"type":"file","path":"/p","start_line":1,"end_line":2,"extra":1}\n')
    got = read_records(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["fqn"] for r in got if r["type"] == "module"] == [f"m{k}.{j}" for k in range(4) for j in range(50)]
    assert [r["seq"] for r in got] == list(range(204))
    assert got[50]["parent"] == "" and got[50]["params"] == []


@pytest.mark.parametrize("line", ['{"type":"module"}', '{"type":"nope","fqn":"x"}', "{broken", '{"type":"file","path":"/p","start_line":-1,"end_line":2}', '{"type":"calls","from":"a"}'])
def test_bad_records_fail(spark, tmp_path, line):
    (tmp_path / "r.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match="(?i)bad record|malformed"):
        read_records(spark, str(tmp_path)).collect()


def test_language_detection(tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "A.java").write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "a.go").write_text("")
    assert detect_language(tmp_path) is None
    deep = tmp_path / "a" / "b" / "c" / "d" / "e"
    deep.mkdir(parents=True)
    (deep / "x.rs").write_text("")  # in the sixth level
    (tmp_path / "x.c").write_text("")
    assert detect_language(tmp_path) is None
    (deep.parent / "x.rs").write_text("")
    assert detect_language(tmp_path) == "rust"
    other = tmp_path / "a" / "other"
    other.symlink_to(tmp_path / "a" / "b" / "c" / "d")
    assert detect_language(tmp_path / "a" / "other") == "rust"
    (tmp_path / "x.cc").write_text("")
    assert detect_language(tmp_path) == "cpp" and detect_language(tmp_path, ("rust",)) == "rust"
    assert find_workspace(deep) is None
    init(tmp_path)
    assert find_workspace(deep) == tmp_path / ".graphloom"


def test_scan_runs_a_frontend_and_publishes(spark, tmp_path):
    front, project = tmp_path / "fe", tmp_path / "p"
    front.mkdir(), project.mkdir()
    (project / "a.go").write_text("package a")
    (front / "scan-go.py").write_text(f"import sys\nsys.stdout.write({lines(ROWS)!r})\n")
    report = scan(spark, ScanOptions(str(project), frontends=Frontends([str(front)])))
    assert report["nodes"] == 4 and report["contains"] == 4
    graph = open_graph(spark, project)
    assert kinds(graph) == {"m": "Module", "/p/a.go": "File", "m.A": "Struct", "m.A.f": "Function"}
    assert list(query_csv(spark, "MATCH (s:Struct) RETURN s.fqn", project)) == ["s.fqn", "m.A"]
    (front / "scan-go.py").write_text("import sys\nsys.exit(3)\n")
    with pytest.raises(Exception, match="ended with 3"):
        scan(spark, ScanOptions(str(project), frontends=Frontends([str(front)])))
    assert kinds(open_graph(spark, project)) == kinds(graph)  # the old graph stays


def test_command_lines(spark):
    df = command_lines(spark, [[sys.executable, "-c", "print('a'); print('b')"], [sys.executable, "-c", "print('c')"]])
    assert [r["line"] for r in df.orderBy("seq").collect()] == ["a", "b", "c"]


def test_streaming_rebuilds_the_graph(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = [str(tmp_path / x) for x in ("in", "table", "graph", "state")]
    (source / "1.jsonl").write_text(lines(ROWS))
    streaming.start(spark, *args, "go", once=True).awaitTermination()
    assert "m.A.f" in kinds(sink.read_store(spark, args[2]))
    time.sleep(1)
    (source / "2.jsonl").write_text(lines([function("n3", "m.A", "f", ["int"], path="/p/a.go"), edge("calls", "n3", "n2")]))
    streaming.start(spark, *args, "go", once=True).awaitTermination()
    graph = sink.read_store(spark, args[2])
    assert links(graph, "Calls") == {("Calls", "m.A.f(int)", "m.A.f()")}  # the second f renames the first


def test_streamed_records_are_numbered_in_order_over_many_tasks(spark):
    rows = streaming.numbered(spark.range(0, 600, 1, 200).withColumnRenamed("id", "k"), 50).collect()
    assert sorted((r["k"], r["seq"]) for r in rows) == [(k, 50 + k) for k in range(600)]


def test_a_failed_write_leaves_the_published_store(spark, tmp_path):
    folder, staged = str(tmp_path / "graph"), str(tmp_path / "lines")
    frame = spark.createDataFrame
    good = sink.Graph(frame([("m", "Module")], "fqn string, kind string"), frame([], "src string"))
    names = [f.name for f in sink.NODE_SCHEMA]
    good.nodes = good.nodes.select(*[F.col(n) if n in good.nodes.columns else F.lit(None).cast(sink.NODE_SCHEMA[n].dataType).alias(n) for n in names])
    good.edges = frame([], sink.EDGE_SCHEMA)
    sink.write_store(good, folder)
    before = sink.read_store(spark, folder)
    bad = sink.Graph(good.nodes.withColumn("fqn", F.raise_error(F.lit("broken")).cast("string")), good.edges)
    with pytest.raises(Exception, match="broken"):
        sink.write_store(bad, folder)
    assert kinds(sink.read_store(spark, folder)) == {"m": "Module"}
    sink.write_store(sink.Graph(good.nodes.withColumn("fqn", F.lit("n")), good.edges), folder)
    assert kinds(sink.read_store(spark, folder)) == {"n": "Module"} and kinds(before) == {"m": "Module"}
    sink.write_jsonl(good, staged)
    with pytest.raises(OSError):
        sink.replace_folder(spark, str(tmp_path / "nothing"), staged)
    assert len(sink.read_jsonl(spark, staged).nodes.collect()) == 1


def test_command_line(spark, tmp_path, capsys):
    project = tmp_path / "p"
    (project / "core").mkdir(parents=True)
    (project / "core" / "a.cc").write_text("struct A { int f() { return 1; } };")
    (project / "other").mkdir()
    (project / "other" / "b.cc").write_text("struct B {};")
    assert main(["init", str(project)]) == 0 and find_workspace(project)
    assert main(["scan", str(project), "--language", "cpp", "--module", "core"]) == 0
    assert "nodes: " in capsys.readouterr().out
    assert main(["query", "MATCH (s:Struct) RETURN s.fqn", "--project", str(project)]) == 0
    assert capsys.readouterr().out.split() == ["s.fqn", "core.A"]
    assert main(["scan", str(project), "--language", "cobol"]) == 1 and main(["query", "MATCH", "--project", str(tmp_path)]) == 1


def test_fact_resolution(spark):
    frame = spark.createDataFrame
    owners = frame([("a",), ("a/b",)], "owner string")
    assert {tuple(r) for r in resolution.longest_prefix(frame([("a/b/c",), ("a/bc",), ("z",)], "name string"), owners).collect()} == {("a/b/c", "a/b"), ("a/bc", "a")}
    decls = frame([("n.C.f",), ("f",), ("n.g",)], "fqn string")
    calls = frame([("u", "n.C", "f"), ("u", "n", "f"), ("u", "n.C", "g"), ("u", "n.C", "h")], "unit string, scope string, name string")
    assert {(r["scope"], r["name"], r["fqn"]) for r in resolution.by_scope_chain(calls, decls).collect()} == {("n.C", "f", "n.C.f"), ("n", "f", "f"), ("n.C", "g", "n.g")}
    named = frame([("a.f", "f"), ("b.f", "f"), ("b.g", "g")], "fqn string, name string")
    assert [r["fqn"] for r in resolution.by_unique_name(frame([("u", "f"), ("u", "g")], "unit string, name string"), named).collect()] == ["b.g"]
    got = resolution.by_receiver(
        frame([("u", "v", "m"), ("u", "v", "zz"), ("u", "w", "m")], "unit string, receiver string, name string"), frame([("u", "v", "C")], "unit string, receiver string, class string"),
        frame([("C", "m", "C.m")], "class string, name string, fqn string"), frame([("C",)], "class string"),
    )
    assert {tuple(r) for r in got.collect()} == {("u", "Calls", "C.m"), ("u", "Uses", "C")}
    ids = resolution.numbered(spark.range(100).select(F.format_string("p%03d", F.col("id")).alias("p")), "p").collect()
    assert {r["id"]: r["p"] for r in ids} == {f"n{k + 1}": f"p{k:03d}" for k in range(100)}
