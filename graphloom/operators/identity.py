"""Who is who: FQNs of declarations, precedence between equal FQNs, and collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import basename, joined_params
from graphloom.operators.resolution import prefixes
from graphloom.storage import store

SPAN = ("path", "start", "end", "start_line", "end_line")


class FqnCollision(ValueError):
    pass


def struct_fqns(records: DataFrame) -> DataFrame:
    """id, fqn and span of all struct declarations."""
    return records.where("type = 'struct'").select("id", F.concat_ws(".", "parent", "name").alias("fqn"), *SPAN, "seq")


def function_fqns(records: DataFrame, language: str) -> DataFrame:
    """id, fqn and span of all function declarations.

    A function alone under its parent and name is parent.name; each of several is parent.name(params). A Go init is named
    after its file, alone or not.
    """
    functions = records.where("type = 'function'")
    several = overload_groups(records).select(F.col("parent").alias("_parent"), F.col("name").alias("_name"), "n")
    base = F.concat_ws(".", "parent", "name")
    params = joined_params(F.coalesce("params", F.array().cast("array<string>")))
    fqn = F.when(F.col("n").isNotNull(), F.concat(base, F.lit("("), params, F.lit(")"))).otherwise(base)
    if language == "go":
        fqn = F.when(F.col("name") == "init", F.concat("parent", F.lit(".init#"), basename(F.coalesce("file", F.lit(""))))).otherwise(fqn)
    counted = functions.join(several, F.col("parent").eqNullSafe(F.col("_parent")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    return counted.select("id", fqn.alias("fqn"), *SPAN, "seq")


def overload_groups(records: DataFrame) -> DataFrame:
    """(parent, name) groups of several functions, and how many."""
    return records.where("type = 'function'").groupBy("parent", "name").agg(F.count("*").alias("n")).where("n > 1")


def first_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The row of the smallest seq for each key; partial aggregation, no sort."""
    picked = df.groupBy(key).agg(F.min_by(F.struct(*columns), "seq").alias("_first"))
    return picked.select(key, *[F.col("_first")[c].alias(c) for c in columns])


def shadowed_functions(functions: DataFrame, structs: DataFrame) -> DataFrame:
    return functions.join(structs.select("fqn").distinct(), "fqn", "left_semi")


def claimed_functions(functions: DataFrame, structs: DataFrame) -> DataFrame:
    return functions.join(structs.select("fqn").distinct(), "fqn", "left_anti")


def claims_on(names: DataFrame, records: DataFrame, language: str) -> DataFrame:
    """fqn of declarations, among them all that claim one of names (fqn); functions that a struct shadows too, under the struct's name.

    A function's FQN is parent.name, alone or with its parameters in brackets: those whose parent.name is no beginning of a
    name are left out before FQNs are made. Whole groups of (parent, name) stay or go, so that overloads count as in all.
    """
    bases = names.select(F.explode(prefixes(F.col("fqn"), "(")).alias("_base")).distinct()
    functions = records.where("type = 'function'").withColumn("_base", F.concat_ws(".", "parent", "name"))
    parts = ("type", "parent", "name", "params", "file")
    near = functions.join(bases, "_base", "left_semi").select(*parts)
    if language == "go":
        near = near.where("NOT name <=> 'init'").unionByName(records.where("type = 'function' AND name = 'init'").select(*parts))
    near = store(near)  # few, and read twice
    near = near.withColumns({f.name: F.lit(None).cast(f.dataType) for f in records.schema if f.name not in parts})
    return struct_fqns(records).select("fqn").unionByName(function_fqns(near, language).select("fqn"))


def collisions(structs: DataFrame, functions: DataFrame, kept_structs: DataFrame) -> DataFrame:
    """FQNs that two struct ids claim, that kept structs repeat, or that functions repeat: fqn, ids."""
    by_id = structs.groupBy("fqn").agg(F.count_distinct("id").alias("n"), F.array_sort(F.slice(F.collect_set("id"), 1, 2)).alias("ids")).where("n > 1")
    repeats = [d.groupBy("fqn").agg(F.count("*").alias("n"), F.array_sort(F.array(F.min("id"), F.max("id"))).alias("ids")).where("n > 1") for d in (kept_structs, functions)]
    return by_id.select("fqn", "ids").unionByName(repeats[0].select("fqn", "ids")).unionByName(repeats[1].select("fqn", "ids")).distinct()


def assert_no_collisions(found: DataFrame) -> None:
    rows = found.orderBy("fqn").limit(3).collect()
    if rows:
        raise FqnCollision("; ".join(f"FQN collision: `{r['fqn']}` claimed by both `{r['ids'][0]}` and `{r['ids'][-1]}`" for r in rows))
