"""Records made of a star schema (customers, orders, line items), so that every operator runs on data of any size.

A nation is a module under its region, an order a struct, a line item a function of its order, a customer a file, a part
an unresolved target. CTES is SQL that Spark and DuckDB both run; records() gives the same as one record DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.storage import CODEC, store

STAR = ("region", "nation", "customer", "part", "orders", "lineitem")

CTES = """
nat AS (SELECT n_nationkey, lower(replace(r_name, ' ', '_')) AS r, lower(n_name) AS nn, concat(lower(replace(r_name, ' ', '_')), '.', lower(n_name)) AS n
        FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey AS c, r, n,
                concat('/repo/', r, '/', nn, '/', CASE c_mktsegment WHEN 'FURNITURE' THEN 'gen/' WHEN 'HOUSEHOLD' THEN 'vendor/' ELSE '' END, 'c', CAST(c_custkey AS STRING),
                       CASE c_mktsegment WHEN 'BUILDING' THEN '_test.go' WHEN 'MACHINERY' THEN '.pb.go' ELSE '.go' END) AS path
         FROM customer JOIN nat ON c_nationkey = n_nationkey),
ord AS (SELECT o_orderkey AS k, c, r, n, path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders JOIN cust ON o_custkey = c),
filled AS (SELECT c, count(*) AS n_orders FROM ord GROUP BY c),
li AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, concat(l_returnflag, l_linestatus) AS name, l_returnflag AS flag
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice) AS copy FROM lineitem) x
       WHERE copy = 1),
fn AS (SELECT concat('f', CAST(li.k AS STRING), '_', CAST(ln AS STRING), '_', CAST(p AS STRING)) AS id, li.k AS k, ln, p, name, flag, concat(n, '.O', CAST(li.k AS STRING)) AS parent,
              concat(CAST(ln AS STRING), ',', CAST(p AS STRING)) AS params, path,
              (rn - 1) * 1000 + ln * 100 + CASE WHEN p % 97 = 0 THEN 1000000 ELSE 0 END AS s_off, (rn - 1) * 10 + 1 + ln AS s_line
       FROM li JOIN ord ON li.k = ord.k),
nxt AS (SELECT id, k, ln, p, lead(id) OVER (PARTITION BY p ORDER BY k, ln) AS next_id, lead(k) OVER (PARTITION BY p ORDER BY k, ln) AS next_k FROM fn),
tgt AS (SELECT p_partkey AS p, concat(lower(replace(p_brand, '#', '_')), '.', lower(p_type)) AS fqn,
               CASE p_size % 6 WHEN 0 THEN 'builtin' WHEN 1 THEN 'stdlib' WHEN 2 THEN 'external' WHEN 3 THEN 'func-value' WHEN 4 THEN 'interface-method' ELSE 'unknown' END AS category
        FROM part),
module_rec AS (SELECT r AS fqn FROM nat UNION ALL SELECT n FROM nat UNION ALL SELECT concat(n, '.O', CAST(k AS STRING)) FROM ord WHERE k % 500 = 0
               UNION ALL SELECT concat(n, '.O', CAST(k AS STRING), '.deep') FROM ord WHERE k % 500 = 0),
struct_rec AS (SELECT concat('s', CAST(k AS STRING)) AS id, n AS parent, concat('O', CAST(k AS STRING)) AS name, path, (rn - 1) * 1000 AS s_off, (rn - 1) * 1000 + 999 AS e_off, (rn - 1) * 10 + 1 AS s_line, (rn - 1) * 10 + 10 AS e_line FROM ord
               UNION ALL SELECT concat('x', CAST(k AS STRING)), concat(n, '.O', CAST(k AS STRING)), 'AF', path, (rn - 1) * 1000, (rn - 1) * 1000 + 999, (rn - 1) * 10 + 1, (rn - 1) * 10 + 10 FROM ord WHERE k % 25 = 0),
function_rec AS (SELECT id, parent, name, params, path, s_off, s_off + 50 AS e_off, s_line, s_line AS e_line FROM fn),
file_rec AS (SELECT path, CASE WHEN cust.c % 100 = 7 THEN '' ELSE n END AS parent, 10 * coalesce(n_orders, 0) AS e_line, cust.c AS seq FROM cust LEFT JOIN filled ON cust.c = filled.c
             UNION ALL SELECT path, r, 10 * coalesce(n_orders, 0), 1000000000000 + cust.c FROM cust LEFT JOIN filled ON cust.c = filled.c WHERE cust.c % 50 = 0),
unresolved_rec AS (SELECT fqn, category, p AS seq FROM tgt UNION ALL SELECT r, 'unknown', 1000000000000 FROM nat),
edge_rec AS (
  SELECT 'contains' AS type, r AS src, n AS dst, '' AS target_type FROM nat
  UNION ALL SELECT 'contains', n, concat(n, '.O', CAST(k AS STRING)), '' FROM ord WHERE k % 500 = 0
  UNION ALL SELECT 'contains', concat(n, '.O', CAST(k AS STRING)), concat(n, '.O', CAST(k AS STRING), '.deep'), '' FROM ord WHERE k % 500 = 0
  UNION ALL SELECT 'contains', concat('s', CAST(k AS STRING)), id, '' FROM fn
  UNION ALL SELECT 'contains', concat('s', CAST(k AS STRING)), concat('x', CAST(k AS STRING)), '' FROM ord WHERE k % 25 = 0
  UNION ALL SELECT 'calls', id, next_id, '' FROM nxt WHERE next_id IS NOT NULL
  UNION ALL SELECT 'calls', id, concat('zz', id), '' FROM nxt WHERE ln = 7
  UNION ALL SELECT 'uses', id, concat('s', CAST(next_k AS STRING)), '' FROM nxt WHERE next_k IS NOT NULL
  UNION ALL SELECT 'unresolved_call', id, fqn, CASE WHEN flag = 'R' THEN 'func(int)' ELSE '' END FROM fn JOIN tgt ON fn.p = tgt.p
  UNION ALL SELECT 'unresolved_use', concat('s', CAST(k AS STRING)), fqn, '' FROM fn JOIN tgt ON fn.p = tgt.p WHERE ln = 1)
"""

_RECORDS = """
SELECT 'module' AS type, fqn, NULL AS id, NULL AS parent, NULL AS name, NULL AS params, NULL AS path, 0L AS start, 0L AS `end`, 0L AS start_line, 0L AS end_line, NULL AS category, NULL AS `from`, NULL AS `to`, NULL AS target_type, 0L AS seq FROM module_rec
UNION ALL SELECT 'struct', NULL, id, parent, name, NULL, path, CAST(s_off AS BIGINT), CAST(e_off AS BIGINT), CAST(s_line AS BIGINT), CAST(e_line AS BIGINT), NULL, NULL, NULL, NULL, 0L FROM struct_rec
UNION ALL SELECT 'function', NULL, id, parent, name, params, path, CAST(s_off AS BIGINT), CAST(e_off AS BIGINT), CAST(s_line AS BIGINT), CAST(e_line AS BIGINT), NULL, NULL, NULL, NULL, 0L FROM function_rec
UNION ALL SELECT 'file', NULL, NULL, parent, NULL, NULL, path, 0L, 0L, 1L, CAST(e_line AS BIGINT), NULL, NULL, NULL, NULL, CAST(seq AS BIGINT) FROM file_rec
UNION ALL SELECT 'unresolved', fqn, NULL, NULL, NULL, NULL, NULL, 0L, 0L, 0L, 0L, category, NULL, NULL, NULL, CAST(seq AS BIGINT) FROM unresolved_rec
UNION ALL SELECT type, NULL, NULL, NULL, NULL, NULL, NULL, 0L, 0L, 0L, 0L, NULL, src, dst, target_type, 0L FROM edge_rec
"""


#: How CTES joins line items with their orders.
_JOINED = "FROM li JOIN ord ON li.k = ord.k"


def _run(spark: SparkSession, sf_dir: str, body: str, lines: DataFrame | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR}
    # Dealt by order, line items number their copies and meet orders without another shuffle. Of copies, the first in order gives
    # its flag and status, which come before quantity and price there: those two are not carried along.
    few = tables["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    tables["lineitem"] = few.withColumns({c: F.lit(None).cast("double") for c in ("l_quantity", "l_extendedprice")})
    text = f"WITH {CTES} {body}"
    for t in STAR:
        text = _replace_table(text, t, "{" + t + "}")
    if lines is not None:
        text, tables["lines"] = text.replace(_JOINED, "FROM {lines} li"), lines
    return spark.sql(text, **tables)


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders, stored: what functions and most edges are made of, in few bytes. Records that are read
    again from it need neither the join nor the shuffles of both tables."""
    return store(_run(spark, sf_dir, f"SELECT li.k AS k, ln, p, name, flag, n, path, rn {_JOINED}"), CODEC)


def records(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The adapter's records, by SEQUENCED_SCHEMA. A filter on type leaves the branches that it needs, and their columns.

    lines: joined_lines() of the same folder; the records are the same without."""
    from pyspark.sql import functions as F

    from graphloom.model import SEQUENCED_SCHEMA

    df = _run(spark, sf_dir, _RECORDS, lines).withColumn("file", F.lit(None).cast("string")).withColumn("params", F.split("params", ","))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SEQUENCED_SCHEMA.fields])


#: Bytes of line items for which joins are cut into one more slice, and the most slices.
SLICE_BYTES, MOST_SLICES = 200_000_000, 16


def slices_for(spark: SparkSession, sf_dir: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return min(MOST_SLICES, 1 + size // SLICE_BYTES)


def _replace_table(text: str, table: str, by: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {by}", text)
