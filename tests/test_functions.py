import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.classify import Config, Rule, code_type, load_config


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["out"] for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_glob_agrees_with_a_regular_expression_where_no_star_is_in_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab/._%\\") for _ in range(rng.randrange(9))) for _ in range(300)]
    for _ in range(6):
        pattern = "".join(rng.choice("ab/*?_%\\") for _ in range(rng.randrange(1, 7)))
        want = [bool(re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), t, re.S)) for t in texts]
        assert column(spark, texts, lambda c: X.glob(c, pattern)) == want


def test_glob_takes_a_star_in_the_text_literally_first(spark):
    matches = lambda pattern, texts: column(spark, texts, lambda c: X.glob(c, pattern))
    assert matches("*", ["*b", "*", "b*", "**", "", "b\n*c"]) == [False, True, True, False, True, True]
    assert matches("**", ["*b", "**", "***"]) == [True, True, False] and matches("*a*b", ["xa*b", "xa*xb", "xa*yab", "*ab"]) == [True, False, True, True]
    assert matches("a*c", ["abbc", "a*c", "a*bc", "ab*c"]) == [True, True, False, True] and matches("a?.(c", ["ac", "a*.(c", "a*x(c"]) == [False, True, False]
    assert column(spark, ["*b", "ab", None], lambda c: X.glob(c, "*b")) == [True, True, None]


def test_names_and_paths(spark):
    assert column(spark, ["/a/b.go", "b.go", "/a/b/", ""], X.basename) == ["b.go", "b.go", "b", ""]
    assert column(spark, ["a.b.c", "x", "/x/a_test.go"], X.simple_name) == ["c", "x", "go"]
    assert column(spark, ["a.b.c", "x"], X.parent_of) == ["a.b", ""]
    assert column(spark, ['..a,"b..c\n.'], X.clean_fqn) == ["ab.c"]
    assert column(spark, ["a::b"], X.dotted) == ["a.b"]
    assert column(spark, ["a\nb", "", "a\n"], X.line_count) == [2, 0, 1]
    assert column(spark, ["a\nb\nc"], lambda c: X.line_of(c, F.lit(2))) == [2]
    assert column(spark, ["é" * 40, "short"], X.truncated) == ["é" * 32 + "…", "short"]
    assert column(spark, ["a,b", 'q"q', "plain", "l\nl", "r\rr", None], X.csv_field) == ['"a,b"', '"q""q"', "plain", '"l\nl"', "r\rr", ""]


@pytest.mark.parametrize(
    ("language", "path", "want"),
    [
        ("go", "/p/a_test.go", "test"), ("go", "/p/tests/a.go", "test"), ("go", "/p/gen/a_TEST.go", "test"), ("go", "/p/a.pb.go", "generated"), ("go", "/p/vendor/a.go", "external"), ("go", "/p/a.go", "src"),
        ("java", "/p/FooTest.java", "test"), ("java", "/p/FooTests.java", "test"), ("java", "/p/generated/Foo.java", "generated"), ("java", "/p/third_party/Foo.java", "external"),
        ("cpp", "/p/test_a.cpp", "test"), ("cpp", "/p/a_test.cc", "test"), ("cpp", "/p/a.pb.h", "generated"), ("cpp", "/p/external/a.h", "external"), ("rust", "/p/a_test.rs", "test"), ("rust", "/p/vendor/a.rs", "external"), ("", "/p/test/a", "src"),
    ],
)
def test_builtin_code_types(spark, language, path, want):
    assert column(spark, [path], lambda c: code_type(c, c, language)) == [want]


def test_config_replaces_the_builtin_rules(spark, tmp_path):
    config = Config("src", [Rule("t", ["**/test/**"], ["Test*"]), Rule("g", ["*.pb.go"])])
    df = spark.createDataFrame([("/p/test/a.go", "m.A"), ("/p/a.go", "m.TestB"), ("/p/a.pb.go", "m.C"), ("/p/a_test.go", "m.D")], "path string, fqn string")
    assert [r[0] for r in df.select(code_type(F.col("path"), F.col("fqn"), "go", config)).collect()] == ["t", "t", "g", "src"]
    assert load_config(tmp_path, ".graphloom") is None
    (tmp_path / ".graphloom").mkdir()
    (tmp_path / ".graphloom" / "config.json").write_text("{broken")
    (tmp_path / "graphloom.json").write_text('{"default": "x", "types": [{"name": "t"}]}')
    assert load_config(tmp_path, ".graphloom").default == "x"


def test_categories(spark):
    assert column(spark, ["", "fmt", "github.com/x", "net/http"], X.category_go) == ["builtin", "stdlib", "external", "stdlib"]
    assert column(spark, ["java.util.List", "org.x"], X.category_java) == ["stdlib", "external"]
    assert column(spark, ["std::string", "int"], X.category_cpp) == ["external", "unknown"]
    assert column(spark, ["core", "serde"], X.category_rust) == ["stdlib", "external"]
