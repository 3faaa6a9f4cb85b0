import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans.registry import CHAIN

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["target", "n"] and entry.entry(spark).count() > 0


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p2_function_fqn", "a5_ingest_report", "a6_graph_report", "j12_hunk", "c_count_group_topk", "k5_jsonl_edges"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[k] for k in order) for r in result.fetchall())))


def test_collisions_are_those_of_all_declarations(spark):
    con = duckdb.connect()
    for path in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    parent = r"regexp_replace(fqn, '\.?[^.]*$', '')"
    sql = f"{CHAIN} SELECT {parent} FROM s_all GROUP BY 1 HAVING count(DISTINCT id) > 1 UNION SELECT {parent} FROM f_cl GROUP BY 1 HAVING count(*) > 1 UNION SELECT {parent} FROM s_ok GROUP BY 1 HAVING count(*) > 1"
    want = sorted(r[0] for r in con.execute(sql).fetchall())
    assert sorted(r["fqn"] for r in entry.queries()["a2_collisions"](spark, DATA).collect()) == want


def test_the_rest_stands_without_the_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "graphloom", copy / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    code = "import sys, __spark_entry__ as e; assert len(e.queries()) > 90 and not any(k.startswith('op') for k in e.queries()); assert not any('llm' in m for m in sys.modules if m.startswith('graphloom'))"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_modules_need_no_stored_graph(spark, tmp_path):
    from graphloom.plans.registry import context

    (tmp_path / "d").symlink_to(DATA)
    folder = str(tmp_path / "d")
    con = duckdb.connect()
    for path in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = sorted(con.execute(entry.oracle_sql()["t2_modules"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["t2_modules"](spark, folder).collect()) == want
    assert "stored_graph" not in vars(context(spark, folder))
    context(spark, folder).stored_graph
    assert sorted(tuple(r) for r in entry.queries()["t2_modules"](spark, folder).collect()) == want
