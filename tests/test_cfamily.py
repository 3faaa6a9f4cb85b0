from graphloom.plans.scan import ScanOptions, build, open_graph, scan
from graphloom.sources import cfamily
from graphloom.sources.project import Frontends

from .helpers import kinds, links



def test_a_file_that_fails_does_not_end_the_scan(spark, tmp_path, monkeypatch):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.cc").write_text(f"struct {name.title()} {{}};")
    (tmp_path / "two" / "deep.cc").write_text("struct Deep {};" + "{" * 20 + "}" * 3)
    (tmp_path / "one" / "bad.cc").write_bytes(b"\xff\xfe struct \x00")
    found = cfamily.records(spark, str(tmp_path)).where("type = 'struct'").collect()
    assert {"One", "Two"} <= {r["name"] for r in found}
    only = cfamily.facts(spark, str(tmp_path), (), ["two"]).collect()
    assert {r["module"] for r in only} == {"two"} and all("/two/" in r["path"] for r in only)


SHAPES = """#include <vector>
// class Ghost { };
namespace geo {
class Shape {
public:
    virtual double area() const { return 0; }
    Point origin;
};
struct Point { int x; };
namespace deep { int twist(int k) { return k; } }
class Circle : public Shape {
    double area() const override { const char* s = "class Lie {"; return scale(r_) * pi(); }
    double r_;
};
double scale(double v) { return deep::twist(2) * v; }
}
"""
MAIN = """static int helper(geo::Circle& c, std::string name) {
    Circle local;
    if (c.area() > 1) { local.area(); missing(3); }
    return std::max(1, 2);
}
int main() { return helper(make(), "x"); }
"""


def test_blanking_keeps_places():
    text = 'a "x\\"{" /* } */ b // {\nc R"(})" d'
    clean = cfamily.blanked(text)
    assert len(clean) == len(text) and "{" not in clean and "}" not in clean and clean.count("\n") == 1


def test_parameters():
    assert cfamily.parameters("const std::map<int, A>& m, int* p, unsigned, void") == [("std::map<int,A>&", "m"), ("int*", "p"), ("unsigned", ""), ("void", "")][:3]
    assert cfamily.parameters("void") == [] and cfamily.parameters("") == []


def test_project_to_graph(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "lib").mkdir(parents=True)
    (root / "vendor").mkdir()
    (root / ".git").mkdir()
    (root / "lib" / "shapes.h").write_text(SHAPES)
    (root / "main.cpp").write_text(MAIN)
    (root / "vendor" / "x.cpp").write_text("int vendored() { return 1; }")
    (root / ".git" / "y.cpp").write_text("int hidden() { return 1; }")
    graph, report = build(cfamily.records(spark, str(root), ["/vendor/"]), "cpp")
    got = kinds(graph)
    shapes, main = str(root / "lib" / "shapes.h"), str(root / "main.cpp")
    assert {k: v for k, v in got.items() if v != "UnresolvedTarget"} == {
        "lib": "Module", "proj": "Module", "lib.geo": "Module", "lib.geo.deep": "Module", shapes: "File", main: "File", "lib.geo.Shape": "Struct", "lib.geo.Point": "Struct", "lib.geo.Circle": "Struct",
        "lib.geo.Shape.area": "Function", "lib.geo.Circle.area": "Function", "lib.geo.scale": "Function", "lib.geo.deep.twist": "Function", "proj.helper": "Function", "proj.main": "Function",
    }
    edges = links(graph)
    assert {e[1:] for e in edges if e[0] == "Calls"} == {
        ("lib.geo.Circle.area", "lib.geo.scale"), ("lib.geo.scale", "lib.geo.deep.twist"), ("proj.helper", "lib.geo.Circle.area"), ("proj.main", "proj.helper"),
    }
    assert {("Uses", "lib.geo.Circle", "lib.geo.Shape"), ("Uses", "lib.geo.Shape", "lib.geo.Point"), ("Uses", "proj.helper", "lib.geo.Circle")} <= edges
    assert {("UnresolvedCall", "proj.helper", "missing"), ("UnresolvedCall", "proj.helper", "std.max"), ("UnresolvedCall", "lib.geo.Circle.area", "pi"), ("UnresolvedUse", "proj.helper", "std.string")} <= edges
    assert {("Contains", "lib.geo", "lib.geo.deep"), ("Contains", "lib.geo.Shape", "lib.geo.Shape.area"), ("Contains", shapes, "lib.geo.scale"), ("Contains", "proj", main)} <= edges
    row = graph.nodes.where("fqn = 'lib.geo.Point'").first()
    assert (row["start_line"], row["end_line"]) == (9, 9) and SHAPES.encode()[row["start"] : row["end"]].decode().startswith("struct Point")
    assert graph.nodes.where("fqn = 'std.max'").first()["category"] == "external"


def test_scan_needs_no_frontend(spark, tmp_path):
    (tmp_path / "main.cpp").write_text(MAIN)
    report = scan(spark, ScanOptions(str(tmp_path), frontends=Frontends([])))
    assert report["calls"] == 1 and f"{tmp_path.name}.main" in kinds(open_graph(spark, tmp_path))
