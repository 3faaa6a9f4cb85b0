import random

import pytest

from graphloom.model import CleanupOptions, IngestOptions
from graphloom.plans.ingest import Cleanup, Ingest
from graphloom.plans.lean import LeanGraph

from .helpers import edge, file, frame, function, module, struct, unresolved

EXCLUDES = ("*/gen/*",)


def rows(df):
    return sorted(map(str, df.collect()))


def both(spark, records, language, blacklist, slices=3):
    df = frame(spark, records)
    from graphloom.sinks.store import filled

    whole = Cleanup(Ingest(df, IngestOptions(language, blacklist)).graph, CleanupOptions(language, EXCLUDES)).result
    lean = LeanGraph(df, IngestOptions(language, blacklist), CleanupOptions(language, EXCLUDES), slices)
    columns = lean.nodes.columns
    return (rows(lean.nodes), rows(lean.edges)), (rows(filled(whole.nodes).select(*columns)), rows(whole.edges.select(*lean.edges.columns))), lean


def project(seed):
    """Records with overloads, shadowed names, ids that look like names, unknown ids, repeated edges and blacklisted packages."""
    r = random.Random(seed)
    paths = [f"/x/{d}{k}.java" for d in ("", "gen/", "test/") for k in range(3)]
    packages = ["p", "p.q", "drop.z"]
    out = [module(m) for m in (*packages, "p.S1", "p.S1.deep", "p.f1(int)")] + [file(p, r.choice([*packages, ""])) for p in paths]
    out += [unresolved(u, "stdlib") for u in ("java.X", "p.q", "p.S2", "drop.u")]
    types = [f"s{k}" for k in range(8)]
    out += [struct(t, r.choice(packages), f"S{k}", r.choice(paths), (k, k + 30)) for k, t in enumerate(types)]
    out += [struct("s8", "p", "f2(int)", paths[0])]
    units = [f"f{k}" for k in range(14)] + ["p.q.S1"]
    out += [function(f, r.choice(["p", "p.q", "p.S1", "drop.z"]), f"f{k % 3}", r.choice([[], ["int"], ["int", f"T{k}"]]) + [f"U{k}"], r.choice(paths), span=(r.randrange(60), 70)) for k, f in enumerate(units)]
    out += [function("g1", "p.q", "f2", ["int"], paths[1]), function("g2", "p", "S3", [], paths[2])]
    ends = [*types, *units, "g1", "g2", "nobody", "p", "p.q", "p.S1", "p.S1.deep", "p.q.f1", "p.S0", "p.q.S0", "p.q.S1", *paths]
    for kind in ("contains", "calls", "uses"):
        out += [edge(kind, r.choice(ends), r.choice(ends)) for _ in range(150)]
    for kind in ("unresolved_call", "unresolved_use"):
        out += [edge(kind, r.choice(ends), r.choice(["java.X", "p.q", "drop.u", "p.S2"]), r.choice(["", "f()"])) for _ in range(40)]
    return out


@pytest.mark.parametrize("seed, language", [(1, "java"), (2, "go")])
def test_lean_graph_is_the_cleaned_graph(spark, seed, language):
    got, want, lean = both(spark, project(seed), language, ("drop",))
    assert got[0] == want[0] and got[1] == want[1]


def test_lean_graph_with_names_borne_twice(spark):
    more = [struct("t1", "p", "S1", "/x/0.java", (5, 9)), struct("t2", "p", "S1", "/x/1.java", (50, 60)), function("h1", "p.q", "twice", path="/x/0.java", span=(7, 8)), function("h2", "p.q", "twice", path="/x/0.java", span=(55, 56))]
    more += [edge("contains", "t1", "h1"), edge("calls", "h1", "h2"), edge("uses", "h1", "t1")]
    got, want, lean = both(spark, project(3) + more, "java", ("drop",))
    assert not lean.closed and got == want


def test_lean_graph_where_a_file_is_named_as_a_type(spark):
    more = [file("p.odd.java", "p"), struct("o1", "p.odd", "java", "/x/0.java"), function("o2", "p", "f9", path="p.odd.java"), edge("contains", "o1", "o2")]
    got, want, lean = both(spark, project(4) + more, "java", ("drop",))
    assert not lean.closed and got == want


def test_go_functions_of_one_name(spark):
    records = [module("p"), file("/x/a.go", "p"), struct("s1", "p", "init#a.go", "/x/a.go"), function("n1", "p", "init", file="/x/a.go"), function("n2", "p", "init", file="/x/b.go"), function("n3", "p", "f", ["int"]), function("n4", "p", "f", []), edge("calls", "n3", "n2"), edge("calls", "n3", "n1")]
    got, want, _ = both(spark, records, "go", ())
    assert got == want


def test_queries_need_no_whole_graph(spark, tmp_path):
    import __spark_entry__ as entry
    from graphloom.model import RELS
    from graphloom.plans.registry import context

    (tmp_path / "d").symlink_to("/root/testdata/sf0.001")
    folder = str(tmp_path / "d")
    needed = {"t1_find_symbol": [], "k2_store_roundtrip": [], "a9_class_methods": ["Contains"], "t4_module_structs": ["Contains"], "t8_struct": ["Contains"], "c_one_hop": ["Contains", "Calls"], "c_distinct": ["Contains", "Calls", "Uses"], "j9_span_join": list(RELS)}
    for name, rels in needed.items():
        assert entry.queries()[name](spark, folder).count() > 0
        made = vars(context(spark, folder))
        assert "stored_graph" not in made and "ingest" not in made and set(made["lean"]._edges) == set(rels), name


def test_records_of_joined_lines_need_no_shuffle(spark):
    from graphloom.sources.adapter import joined_lines, records

    small = "/root/testdata/sf0.001"
    plain, read = records(spark, small), records(spark, small, joined_lines(spark, small))
    assert rows(read) == rows(plain)
    for kind in ("function", "unresolved_call"):
        lines = read.where(f"type = '{kind}'").select("id", "parent", "from")
        assert "l_orderkey" not in lines._jdf.queryExecution().optimizedPlan().toString(), kind
    assert "Exchange hash" not in read.where("type = 'function'").select("id", "parent")._jdf.queryExecution().executedPlan().toString()


def test_edge_records_of_one_relation_at_a_time(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    (tmp_path / "e").symlink_to("/root/testdata/sf0.001")
    read, raw = [], LeanGraph.raw

    def watched(self, rel):
        assert set(self._raw) <= {rel} and "declared" in vars(self)
        read.append(rel)
        return raw(self, rel)

    monkeypatch.setattr(LeanGraph, "raw", watched)
    assert entry.queries()["c_distinct"](spark, str(tmp_path / "e")).count() > 0 and read == ["Calls", "Uses"]


@pytest.mark.parametrize("more, light", [([], True), ([file("/x/n.java", "p"), edge("contains", "p.q", "/x/n.java"), edge("contains", "/x/n.java", "s1"), struct("t1", "p", "S1", "/x/0.java")], False)])
def test_containment_of_files_needs_no_functions(spark, more, light):
    plain = [r for r in project(5) if r["type"] != "contains" or not {"/x/"} & {r["from"][:3], r["to"][:3]}] + more
    df = frame(spark, plain)
    whole = Cleanup(Ingest(df, IngestOptions("java", ("drop",))).graph, CleanupOptions("java", EXCLUDES)).result
    lean = LeanGraph(df, IngestOptions("java", ("drop",)), CleanupOptions("java", EXCLUDES), 2)
    for kinds in (("Module", "File"), ("File", "Struct")):
        found = lean.edges_of("Contains", *kinds)
        assert rows(found) == rows(whole.edges_of("Contains", *kinds).select(*found.columns)), kinds
    if light:
        assert rows(lean.nodes_of("Struct").select("fqn", "path")) == rows(whole.nodes_of("Struct").select("fqn", "path"))
    assert ("declared" not in vars(lean) and not lean._edges) == light


def test_json_lines_leave_nothing_but_themselves(spark, tmp_path):
    import glob

    import __spark_entry__ as entry
    from graphloom.plans.registry import context

    (tmp_path / "j").symlink_to("/root/testdata/sf0.001")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{base}/*/*"))
    found = entry.queries()["k5_jsonl_edges"](spark, str(tmp_path / "j"))
    # Left are the lines, packed, and the slices of the edges read from them.
    left = [f for d in set(glob.glob(f"{base}/*/*")) - before for f in glob.glob(f"{d}/**/part-*", recursive=True)]
    assert left and all(f.endswith(".txt.gz") or f in {p.removeprefix("file://") for p in found.inputFiles()} for f in left)
    assert "lean" not in vars(context(spark, str(tmp_path / "j"))) and found.count() > 0
