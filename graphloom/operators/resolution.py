"""From facts to edges: the joins by which a scanner's call sites and type names find their declarations.

Facts are tables: decl(fqn, name, ...), call sites, scopes, local variables. What finds no declaration stays unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefixes(fqn, separator: str = "."):
    """All beginnings of a name that end at a separator, and the name itself."""
    parts = F.split(fqn, f"[{separator}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(names: DataFrame, owners: DataFrame, separator: str = "/") -> DataFrame:
    """names: name; owners: owner. The longest owner that is a whole-segment beginning of each name; a plain equi-join on beginnings."""
    tries = names.select("name", F.explode(prefixes(F.col("name"), separator)).alias("owner"))
    hits = tries.join(owners.select("owner").distinct(), "owner")
    return hits.groupBy("name").agg(F.max_by("owner", F.length("owner")).alias("owner"))


def in_project(names: DataFrame, owners: DataFrame, separator: str = "/") -> DataFrame:
    """Names that some owner is a whole-segment beginning of."""
    return longest_prefix(names, owners, separator).select("name")


def by_key(calls: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls: unit, key; declarations: key, fqn. (unit, fqn) of calls that find a declaration; (unit, key) of the others."""
    keyed = declarations.select("key", "fqn")
    return calls.join(keyed, "key").select("unit", "fqn"), calls.join(keyed.select("key").distinct(), "key", "left_anti").select("unit", "key")


def by_scope_chain(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """calls: unit, scope, name; declarations: fqn. The declaration of `name` in the innermost enclosing scope, or at top level."""
    scopes = F.concat(F.array(F.lit("")), prefixes(F.col("scope")))
    tries = calls.distinct().select("unit", "scope", "name", F.posexplode(scopes).alias("depth", "prefix"))
    tries = tries.withColumn("fqn", F.when(F.col("prefix") == "", F.col("name")).otherwise(F.concat_ws(".", "prefix", "name")))
    hits = tries.join(declarations.select("fqn").distinct(), "fqn")
    return hits.groupBy("unit", "scope", "name").agg(F.max_by("fqn", "depth").alias("fqn"))


def by_unique_name(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """calls: unit, name; declarations: fqn, name. Only names that one declaration has."""
    single = declarations.groupBy("name").agg(F.count_distinct("fqn").alias("n"), F.min("fqn").alias("fqn")).where("n = 1")
    return calls.distinct().join(single.select("name", "fqn"), "name").select("unit", "name", "fqn")


def by_receiver(calls: DataFrame, variables: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """calls: unit, receiver, name; variables: unit, receiver, class; methods: class, name, fqn; classes: class.

    rel Calls to the method of the receiver's class; where the class has no such method, rel Uses of the class.
    """
    typed = calls.join(variables, ["unit", "receiver"]).join(classes.select("class").distinct(), "class", "left_semi")
    found = typed.join(methods.groupBy("class", "name").agg(F.min("fqn").alias("fqn")), ["class", "name"], "left")
    return found.select("unit", F.when(F.col("fqn").isNull(), "Uses").otherwise("Calls").alias("rel"), F.coalesce("fqn", "class").alias("fqn")).distinct()


def class_methods(edges: DataFrame) -> DataFrame:
    """class, n, methods in order, from Struct to Function containment."""
    inside = edges.where("rel = 'Contains' AND src_kind = 'Struct' AND dst_kind = 'Function'")
    return inside.groupBy(F.col("src").alias("class")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("methods"))


def numbered(declarations: DataFrame, *order: str) -> DataFrame:
    """declarations with ids n1, n2, ... in a total order, without one task for all rows: a range exchange sorts, and each
    partition's rows are numbered after the rows of those before it."""
    # rank within (partition of the range) + rows in earlier partitions
    placed = declarations.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from graphloom.storage import store

    placed = store(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    ranked = placed.withColumn("_rank", rank).join(before, "_part")
    return ranked.withColumn("id", F.concat(F.lit("n"), (F.col("_rank") + F.col("_before")).cast("string"))).drop("_part", "_n", "_before", "_rank")
