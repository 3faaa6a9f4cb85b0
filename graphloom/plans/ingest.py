"""Records to graph: names, precedence, containment, edge resolution and integrity as one chain of DataFrames.

Each stage is an attribute, computed when something asks for it, so that a query over one stage plans that stage alone.
Declarations, nodes and edges are used by many later stages: they are written once and read from there.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import any_of, path_glob, prefixed
from graphloom.model import ALLOWED, CALLS, CONTAINS, EDGE_TYPES, FILE, FUNCTION, MODULE, RELS, STRUCT, UNRESOLVED, UNRESOLVED_CALL, UNRESOLVED_USE, USES, CleanupOptions, Graph, IngestOptions
from graphloom.operators import identity
from graphloom.operators.classify import code_type
from graphloom.storage import store


def kind_pair_allowed():
    tests = []
    for rel, pairs in ALLOWED.items():
        tests += [(F.col("rel") == rel) & (F.col("src_kind") == a) & (F.col("dst_kind") == b) for a, b in pairs]
    return any_of(tests)


def by_relation(edges: DataFrame) -> DataFrame:
    """The edges, of RELS alone, as a stored table of each relation: the shuffle files of one are gone when the next is made."""
    return reduce(DataFrame.unionByName, [store(edges.where(F.col("rel") == r)) for r in RELS])


def bare(df: DataFrame, kind: str, category) -> DataFrame:
    """Nodes without a place."""
    empty = [F.lit(None).cast("string").alias("path"), *[F.lit(None).cast("long").alias(n) for n in identity.SPAN[1:]]]
    return df.select("fqn", F.lit(kind).alias("kind"), *empty, category.alias("category"), F.lit("").alias("code_type"))


class Ingest:
    """records: SEQUENCED_SCHEMA."""

    def __init__(self, records: DataFrame, options: IngestOptions | None = None):
        self.records, self.options = records, options or IngestOptions()

    def blacklisted(self, column: str):
        return prefixed(F.col(column), self.options.blacklist)

    # Declarations. Blacklisted structs still claim their names and resolve edges.

    @cached_property
    def structs_all(self) -> DataFrame:
        return store(identity.struct_fqns(self.records))

    @cached_property
    def structs(self) -> DataFrame:
        return self.structs_all.where(~self.blacklisted("fqn"))

    @cached_property
    def functions_all(self) -> DataFrame:
        return store(identity.function_fqns(self.records, self.options.language))

    @cached_property
    def functions_claimed(self) -> DataFrame:
        return store(identity.claimed_functions(self.functions_all, self.structs_all))

    @cached_property
    def functions_shadowed(self) -> DataFrame:
        return identity.shadowed_functions(self.functions_all, self.structs_all)

    @cached_property
    def functions(self) -> DataFrame:
        return self.functions_claimed.where(~self.blacklisted("fqn"))

    @cached_property
    def ids(self) -> DataFrame:
        return self.structs_all.select("id", "fqn").unionByName(self.functions_claimed.select("id", "fqn"))

    @cached_property
    def claims(self) -> DataFrame:
        """fqn of declarations, among them all that bear a module's name."""
        return identity.claims_on(self.modules_all, self.records, self.options.language)

    @cached_property
    def modules_all(self) -> DataFrame:
        return store(self.records.where("type = 'module'").where(~self.blacklisted("fqn")).select("fqn").distinct())

    @cached_property
    def modules_shadowed(self) -> DataFrame:
        return self.modules_all.join(self.claims, "fqn", "left_semi")

    @cached_property
    def modules(self) -> DataFrame:
        return self.modules_all.join(self.claims, "fqn", "left_anti")

    @cached_property
    def files(self) -> DataFrame:
        """path, parent, start_line, end_line of each path's first record whose parent is not blacklisted."""
        found = self.records.where("type = 'file'").withColumn("parent", F.coalesce("parent", F.lit(""))).where(~self.blacklisted("parent"))
        return store(identity.first_by(found, "path", "parent", "start_line", "end_line"))

    @cached_property
    def unresolved(self) -> DataFrame:
        """fqn, category of each target's first record, where nothing in the project has that name."""
        first = identity.first_by(self.records.where("type = 'unresolved'"), "fqn", "category")
        declared = self.structs.select("fqn").unionByName(self.functions.select("fqn")).unionByName(self.modules).unionByName(self.files.select(F.col("path").alias("fqn")))
        return first.join(declared.distinct(), "fqn", "left_anti")

    @cached_property
    def module_nodes(self) -> DataFrame:
        """Of all declarations' names, only those that may be a module's are needed."""
        return bare(self.modules, MODULE, F.lit(None).cast("string"))

    @cached_property
    def nodes(self) -> DataFrame:
        language, config = self.options.language, self.options.config
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

        def located(df: DataFrame, kind: str) -> DataFrame:
            return df.select("fqn", F.lit(kind).alias("kind"), *identity.SPAN, none.alias("category"), code_type(F.col("path"), F.col("fqn"), language, config).alias("code_type"))

        files = self.files.select(F.col("path").alias("fqn"), "path", zero.alias("start"), zero.alias("end"), "start_line", "end_line")
        return store(
            located(self.structs, STRUCT).unionByName(located(self.functions, FUNCTION)).unionByName(located(files, FILE))
            .unionByName(self.module_nodes).unionByName(bare(self.unresolved, UNRESOLVED, F.col("category")))
        )

    # Edges.

    @cached_property
    def module_files(self) -> DataFrame:
        """Module to File, from each file's parent."""
        parents = self.modules.select(F.col("fqn").alias("parent"))
        return self.files.where("parent <> ''").join(parents, "parent", "left_semi").select(F.col("parent").alias("src"), F.col("path").alias("dst"))

    @cached_property
    def file_units(self) -> DataFrame:
        """File to Struct and Function, from each unit's path."""
        units = self.structs.select("path", "fqn").unionByName(self.functions.select("path", "fqn"))
        return units.join(self.files.select("path"), "path", "left_semi").select(F.col("path").alias("src"), F.col("fqn").alias("dst"))

    @cached_property
    def raw_edges(self) -> DataFrame:
        rel = F.element_at(F.create_map(*[F.lit(x) for pair in EDGE_TYPES.items() for x in pair]), F.col("type"))
        kept = self.records.where(F.col("type").isin(*EDGE_TYPES))
        return kept.select(rel.alias("rel"), F.col("from").alias("from"), F.col("to").alias("to"), F.when(F.col("type") == "unresolved_call", F.coalesce("target_type", F.lit(""))).otherwise("").alias("target_type"))

    @cached_property
    def rooted_edges(self) -> DataFrame:
        """Without containment under a shadowed module: a type of the same name contains nothing of it."""
        shadowed = self.modules_shadowed.select(F.col("fqn").alias("from"), F.lit(CONTAINS).alias("rel"))
        return self.raw_edges.join(shadowed, ["from", "rel"], "left_anti").select("rel", "from", "to", "target_type")

    @cached_property
    def resolved_edges(self) -> DataFrame:
        """Ids turned into FQNs; what is no id stays as it is. Targets of unresolved edges are names already."""
        source = self.ids.select(F.col("id").alias("from"), F.col("fqn").alias("src_fqn"))
        target = self.ids.select(F.col("id").alias("to"), F.col("fqn").alias("dst_fqn"))
        both = self.rooted_edges.join(source, "from", "left").withColumn("src", F.coalesce("src_fqn", "from"))
        named = F.col("rel").isin(UNRESOLVED_CALL, UNRESOLVED_USE)
        inner = both.where(~named).join(target, "to", "left").select("rel", "src", F.coalesce("dst_fqn", "to").alias("dst"), "target_type")
        return by_relation(inner.unionByName(both.where(named).select("rel", "src", F.col("to").alias("dst"), "target_type")))

    def _edge_blacklisted(self):
        named = F.col("rel").isin(UNRESOLVED_CALL, UNRESOLVED_USE)
        return self.blacklisted("src") | (~named & self.blacklisted("dst"))

    @cached_property
    def allowed_edges(self) -> DataFrame:
        return self.resolved_edges.where(~self._edge_blacklisted()).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """Edges whose ends exist and are of kinds that the relation may join."""
        wired = self.module_files.unionByName(self.file_units).select(F.lit(CONTAINS).alias("rel"), "src", "dst", F.lit("").alias("target_type"))
        return by_relation(with_kinds(self.allowed_edges.unionByName(wired).distinct(), self.nodes).where(kind_pair_allowed()))

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    # Checks and counts.

    def check(self) -> None:
        """Fails on an FQN that two declarations claim."""
        identity.assert_no_collisions(identity.collisions(self.structs_all, self.functions_claimed, self.structs))

    @cached_property
    def report(self) -> DataFrame:
        """metric, n: records left out by the blacklist, shadowed modules, shadowed functions."""
        records = self.records
        module = records.where("type = 'module'").where(self.blacklisted("fqn"))
        files = records.where("type = 'file'").withColumn("parent", F.coalesce("parent", F.lit(""))).where(self.blacklisted("parent"))
        parts = [module, self.structs_all.where(self.blacklisted("fqn")), files, self.functions_claimed.where(self.blacklisted("fqn")), self.resolved_edges.where(self._edge_blacklisted())]
        counts = [p.agg(F.lit("skipped").alias("metric"), F.count("*").alias("n")) for p in parts]
        counts += [df.agg(F.lit(name).alias("metric"), F.count("*").alias("n")) for name, df in (("shadowed_modules", self.modules_shadowed), ("shadowed_functions", self.functions_shadowed))]
        every = counts[0]
        for c in counts[1:]:
            every = every.unionByName(c)
        return every.groupBy("metric").agg(F.sum("n").alias("n"))


def with_kinds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    source = nodes.select(F.col("fqn").alias("src"), F.col("kind").alias("src_kind"))
    target = nodes.select(F.col("fqn").alias("dst"), F.col("kind").alias("dst_kind"))
    return edges.join(source, "src").join(target, "dst").select("src", "dst", "rel", "src_kind", "dst_kind", "target_type")


class Cleanup:
    """Excludes by path, then edges whose ends are gone, then (Java) methods outside their type's span."""

    def __init__(self, graph: Graph, options: CleanupOptions):
        self.graph, self.options = graph, options

    def _excluded(self):
        located = F.col("kind").isin(STRUCT, FUNCTION, FILE)
        return located & any_of([path_glob(F.col("path"), e) for e in self.options.excludes])

    @cached_property
    def nodes(self) -> DataFrame:
        return self.graph.nodes.where(~self._excluded()) if self.options.excludes else self.graph.nodes

    @cached_property
    def pruned_edges(self) -> DataFrame:
        here = self.nodes.select("fqn")
        edges = self.graph.edges
        return by_relation(edges.join(here.withColumnRenamed("fqn", "src"), "src", "left_semi").join(here.withColumnRenamed("fqn", "dst"), "dst", "left_semi").select(*edges.columns))

    @cached_property
    def span_violations(self) -> DataFrame:
        method = (F.col("rel") == CONTAINS) & (F.col("src_kind") == STRUCT) & (F.col("dst_kind") == FUNCTION)
        outer = self.nodes.where(F.col("kind") == STRUCT).select(F.col("fqn").alias("src"), F.col("start").alias("a"), F.col("end").alias("b"))
        inner = self.nodes.where(F.col("kind") == FUNCTION).select(F.col("fqn").alias("dst"), F.col("start").alias("at"))
        return self.pruned_edges.where(method).join(outer, "src").join(inner, "dst").where((F.col("at") < F.col("a")) | (F.col("at") > F.col("b"))).select("src", "dst", "rel")

    @cached_property
    def edges(self) -> DataFrame:
        if self.options.language != "java":
            return self.pruned_edges
        inside, columns = F.col("rel") == CONTAINS, self.graph.edges.columns
        kept = self.pruned_edges.where(inside).join(self.span_violations, ["src", "dst", "rel"], "left_anti").select(*columns)
        return kept.unionByName(self.pruned_edges.where(~inside).select(*columns))

    @cached_property
    def result(self) -> Graph:
        return Graph(self.nodes, self.edges)

    @cached_property
    def report(self) -> DataFrame:
        """metric, n: nodes removed, edges removed by relation, span violations."""
        by = lambda df, sign: df.groupBy("rel").agg((F.count("*") * sign).alias("n"))
        removed = by(self.graph.edges, 1).unionByName(by(self.edges, -1)).groupBy("rel").agg(F.sum("n").alias("n"))
        names = {CONTAINS: "contains_removed", CALLS: "calls_removed", USES: "uses_removed", UNRESOLVED_CALL: "unresolved_calls_removed", UNRESOLVED_USE: "unresolved_uses_removed"}
        renamed = removed.select(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("rel")).alias("metric"), "n")
        gone = self.graph.nodes.where(self._excluded()) if self.options.excludes else self.graph.nodes.limit(0)
        nodes = gone.agg(F.lit("nodes_removed").alias("metric"), F.count("*").alias("n"))
        spans = (self.span_violations if self.options.language == "java" else self.graph.edges.limit(0)).agg(F.lit("span_violations_removed").alias("metric"), F.count("*").alias("n"))
        return renamed.unionByName(nodes).unionByName(spans)


def graph_sizes(graph: Graph) -> DataFrame:
    """metric, n: nodes, and edges by relation."""
    nodes = graph.nodes.agg(F.lit("nodes").alias("metric"), F.count("*").alias("n"))
    return nodes.unionByName(graph.edges.groupBy(F.lower("rel").alias("metric")).agg(F.count("*").alias("n")))
