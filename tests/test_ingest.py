import random

import pytest

from graphloom.model import CleanupOptions
from graphloom.operators.identity import FqnCollision
from graphloom.plans.ingest import Cleanup

from .helpers import edge, file, function, ingest, kinds, links, module, struct, unresolved


def names(i):
    return {r["id"]: r["fqn"] for r in i.functions_all.collect()}


def test_unique_function_has_no_suffix(spark):
    assert names(ingest(spark, [function("n1", "pkg", "foo")])) == {"n1": "pkg.foo"}


def test_overloads_are_all_suffixed(spark):
    rows = [function("n1", "pkg.C", "foo", ["int"]), function("n2", "pkg.C", "foo", ["java.lang.String"]), function("n3", "pkg.C", "bar"), function("n4", "pkg.C", "bar", ["int"])]
    assert names(ingest(spark, rows)) == {"n1": "pkg.C.foo(int)", "n2": "pkg.C.foo(java.lang.String)", "n3": "pkg.C.bar()", "n4": "pkg.C.bar(int)"}


def test_go_init_is_named_after_its_file(spark):
    rows = [function("n1", "pkg", "init", file="/x/a.go"), function("n2", "pkg", "init", file="/x/b.go")]
    assert names(ingest(spark, rows, "go")) == {"n1": "pkg.init#a.go", "n2": "pkg.init#b.go"}
    with pytest.raises(FqnCollision):
        ingest(spark, [function("n1", "pkg", "init", file="a.go"), function("n2", "pkg", "init", file="a.go")], "go").check()


def test_struct_collisions_are_fatal(spark):
    with pytest.raises(FqnCollision, match="FQN collision: `pkg.A`"):
        ingest(spark, [struct("n1", "pkg", "A"), struct("n2", "pkg", "A")]).check()
    with pytest.raises(FqnCollision):  # one id, kept twice
        ingest(spark, [struct("n1", "pkg", "A"), struct("n1", "pkg", "A")]).check()
    ingest(spark, [struct("n1", "pkg", "A"), struct("n1", "pkg", "A")], blacklist=["pkg"]).check()
    with pytest.raises(FqnCollision):  # the blacklist does not free a name
        ingest(spark, [struct("n1", "pkg", "A"), struct("n2", "pkg", "A")], blacklist=["pkg"]).check()


def test_module_shadowed_by_type(spark):
    rows = [
        module("org.pkg"), module("org.pkg.A"), module("org.pkg.A.deep"), file("/x/A.java", "org.pkg"), file("/x/B.java", "org.pkg.A.deep"),
        struct("n1", "org.pkg", "A"), struct("n2", "org.pkg.A.deep", "B", path="/x/B.java"),
        edge("contains", "org.pkg", "org.pkg.A"), edge("contains", "org.pkg.A", "org.pkg.A.deep"),
    ]
    i = ingest(spark, rows)
    assert kinds(i.graph)["org.pkg.A"] == "Struct"
    got = links(i.graph)
    assert ("Contains", "org.pkg", "/x/A.java") in got and ("Contains", "/x/A.java", "org.pkg.A") in got
    assert ("Contains", "org.pkg.A", "org.pkg.A.deep") not in got
    report = {r["metric"]: r["n"] for r in i.report.collect()}
    assert report == {"skipped": 0, "shadowed_modules": 1, "shadowed_functions": 0}


def test_function_shadowed_by_struct(spark):
    rows = [
        module("p"), module("p.A"), file("/x/A.java", "p"), struct("n1", "p", "A"), struct("n2", "p.A", "test"), function("n3", "p.A", "test"), function("n4", "p.A", "other"),
        edge("contains", "n1", "n3"), edge("contains", "n1", "n4"), edge("calls", "n3", "n4"), edge("calls", "n4", "n3"),
    ]
    i = ingest(spark, rows)
    assert kinds(i.graph)["p.A.test"] == "Struct" and kinds(i.graph)["p.A.other"] == "Function"
    assert links(i.graph, "Calls") == set()
    assert ("Contains", "p.A", "p.A.other") in links(i.graph)
    report = {r["metric"]: r["n"] for r in i.report.collect()}
    assert report["shadowed_functions"] == 1 and report["shadowed_modules"] == 1


def test_placeholder_gives_way_and_its_edges_go(spark):
    rows = [unresolved("tests", "unknown"), module("tests"), unresolved("p.f"), function("n1", "p", "f"), function("n2", "p", "g"), edge("unresolved_call", "n2", "p.f")]
    i = ingest(spark, rows)
    assert kinds(i.graph) == {"tests": "Module", "p.f": "Function", "p.g": "Function"}
    assert links(i.graph) == set()


def test_resolution_and_file_layer(spark):
    rows = [
        module("m"), file("/x/a.go", "m"), struct("n1", "m", "Store", "/x/a.go"), function("n2", "m", "Compute", path="/x/a.go"), function("n3", "m.Store", "Get", path="/x/a.go"),
        unresolved("fmt.Errorf", "stdlib"), edge("calls", "n3", "n2"), edge("uses", "n2", "n1"), edge("contains", "n1", "n3"), edge("contains", "m", "n1"),
        edge("unresolved_call", "n2", "fmt.Errorf", "func()"), edge("unresolved_call", "n2", "fmt.Errorf"), edge("unresolved_call", "n2", "fmt.Errorf"), edge("calls", "n2", "zz"),
    ]
    i = ingest(spark, rows, "go")
    assert links(i.graph) == {
        ("Contains", "m", "/x/a.go"), ("Contains", "/x/a.go", "m.Store"), ("Contains", "/x/a.go", "m.Compute"), ("Contains", "/x/a.go", "m.Store.Get"), ("Contains", "m.Store", "m.Store.Get"),
        ("Calls", "m.Store.Get", "m.Compute"), ("Uses", "m.Compute", "m.Store"), ("UnresolvedCall", "m.Compute", "fmt.Errorf"),
    }
    assert i.edges.where("rel = 'UnresolvedCall'").count() == 2  # one for each target type
    assert {r["metric"]: r["n"] for r in i.report.collect()}["skipped"] == 0


def test_blacklist_is_a_plain_prefix(spark):
    rows = [module("drop.mod"), module("drop.module"), module("keep"), struct("n1", "drop.mod", "A", "/x/d.go"), file("/x/d.go", "drop.mod"), struct("n2", "keep", "B", "/x/k.go"), file("/x/k.go", "keep"), edge("uses", "n2", "n1"), unresolved("drop.mod.x")]
    i = ingest(spark, rows, "go", ["drop.mod"])
    assert kinds(i.graph) == {"keep": "Module", "keep.B": "Struct", "/x/k.go": "File", "drop.mod.x": "UnresolvedTarget"}
    assert {r["metric"]: r["n"] for r in i.report.collect()}["skipped"] == 5


def test_first_record_wins(spark):
    rows = [module("a"), module("b"), file("/x/f.go", "a"), file("/x/f.go", "b"), unresolved("t", "stdlib"), unresolved("t", "external")]
    i = ingest(spark, rows, "go")
    assert links(i.graph) == {("Contains", "a", "/x/f.go")}
    assert i.nodes.where("fqn = 't'").first()["category"] == "stdlib"


def test_cleanup_excludes_prunes_and_checks_spans(spark):
    rows = [
        module("m"), file("/x/A.java", "m"), file("/x/gen/B.java", "m"), struct("n1", "m", "A", span=(10, 20)), function("n2", "m.A", "inside", span=(20, 22)), function("n3", "m.A", "outside", span=(21, 22)),
        struct("n4", "m", "B", "/x/gen/B.java"), edge("contains", "n1", "n2"), edge("contains", "n1", "n3"), edge("uses", "n2", "n4"),
    ]
    i = ingest(spark, rows)
    c = Cleanup(i.graph, CleanupOptions("java", ("*/gen/*",)))
    assert ("Contains", "m.A", "m.A.inside") in links(c.result) and ("Contains", "m.A", "m.A.outside") not in links(c.result)
    report = {r["metric"]: r["n"] for r in c.report.collect()}
    assert report["nodes_removed"] == 2 and report["span_violations_removed"] == 1 and report["uses_removed"] == 1
    assert report["contains_removed"] == 3  # the file's two and the span's one
    go = Cleanup(i.graph, CleanupOptions("go", ()))
    assert ("Contains", "m.A", "m.A.outside") in links(go.result)


def test_order_of_records_makes_no_difference(spark):
    rows = [module("m"), module("m.A"), file("/x/a.go", "m"), struct("n1", "m", "A", "/x/a.go"), function("n2", "m.A", "f", ["int"], "/x/a.go"), function("n3", "m.A", "f", [], "/x/a.go"), unresolved("u", "stdlib"), edge("calls", "n2", "n3"), edge("unresolved_use", "n1", "u")]
    want = ingest(spark, rows)
    shuffled = rows[:]
    random.Random(4).shuffle(shuffled)
    got = ingest(spark, shuffled)
    assert kinds(got.graph) == kinds(want.graph) and links(got.graph) == links(want.graph)


def test_empty_input(spark):
    i = ingest(spark, [])
    i.check()
    assert i.nodes.count() == 0 and i.edges.count() == 0


def test_modules_are_held_against_all_names_that_may_be_theirs(spark):
    rows = [module(m) for m in ("p", "p.f", "p.f(int)", "p.g", "p.g(int)", "p.S", "p.S.h(a", "p.init#a.go")]
    rows += [function("n1", "p", "f", ["int"]), function("n2", "p", "f", []), function("n3", "p", "g", ["int"]), struct("n4", "p", "S"), function("n5", "p", "S"), function("n6", "p", "init", file="/x/a.go"), function("n7", "q", "f")]
    for language, shadowed in (("java", {"p.f(int)", "p.g", "p.S"}), ("go", {"p.f(int)", "p.g", "p.S", "p.init#a.go"})):
        i = ingest(spark, rows, language)
        assert {r["fqn"] for r in i.modules_shadowed.collect()} == shadowed
        assert {r["fqn"] for r in i.module_nodes.collect()} == {r["fqn"] for r in rows if r["type"] == "module"} - shadowed
        assert {r["fqn"] for r in i.claims.collect()} == {x for x in names(i).values() if x not in ("q.f", "p.init")} | {"p.S"}


def test_edges_are_stored_by_relation(spark, monkeypatch):
    from graphloom.plans import ingest as plans

    rows = [module("m"), file("/x/a.java", "m"), struct("n1", "m", "A", "/x/a.java"), function("n2", "m.A", "f", path="/x/a.java"), function("n3", "m.A", "g", path="/x/a.java", span=(90, 95)), unresolved("u")]
    rows += [edge("contains", "n1", "n2"), edge("contains", "n1", "n3"), edge("calls", "n2", "n3"), edge("uses", "n2", "n1"), edge("unresolved_call", "n2", "u", "func()"), edge("unresolved_use", "n1", "u")]
    i, stored = ingest(spark, rows), []
    keep = plans.store
    monkeypatch.setattr(plans, "store", lambda df: stored.append(keep(df)) or stored[-1])
    cleaned = Cleanup(i.graph, CleanupOptions("java", ()))
    got = links(cleaned.result)
    found = [{r["rel"] for r in df.select("rel").collect()} for df in stored if "rel" in df.columns]
    assert len(found) == 15 and all(len(f) == 1 for f in found)
    calls = {("Calls", "m.A.f", "m.A.g"), ("Uses", "m.A.f", "m.A"), ("UnresolvedCall", "m.A.f", "u"), ("UnresolvedUse", "m.A", "u")}
    inside = {("Contains", "m", "/x/a.java"), ("Contains", "/x/a.java", "m.A"), ("Contains", "/x/a.java", "m.A.f"), ("Contains", "/x/a.java", "m.A.g"), ("Contains", "m.A", "m.A.f")}
    assert got == calls | inside
