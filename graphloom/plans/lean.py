"""The cleaned graph by kind and relation, each made when something asks for it, with few bytes on disk at a time.

It holds what Cleanup(Ingest(records).graph).result holds. Names are given, and ends of edges looked up, in slices by the hash
of the join's key (storage.Slices); what is blacklisted or excluded goes before the next join, and of the declarations one
table is stored. Records are read again rather than stored.
"""

from __future__ import annotations

from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import any_of, basename, joined_params, path_glob
from graphloom.model import ALLOWED, CONTAINS, EDGE_TYPES, FILE, FUNCTION, KINDS, MODULE, RELS, STRUCT, UNRESOLVED, UNRESOLVED_CALL, UNRESOLVED_USE, CleanupOptions, Graph, IngestOptions
from graphloom.operators import identity
from graphloom.operators.classify import code_type
from graphloom.operators.resolution import prefixes
from graphloom.plans.ingest import Cleanup, Ingest, bare, kind_pair_allowed
from graphloom.sinks.store import filled
from graphloom.storage import CODEC, Slices, discard
from graphloom.storage import store as stored

EDGE = ("src", "dst", "rel", "src_kind", "dst_kind", "target_type")
store = partial(stored, codec=CODEC)

#: Where an end of containment starts and ends: of several nodes of a name, the outermost values.
BOUNDS = ("start", "last_start", "end")


class _Names(Ingest):
    """Modules, files and targets of records, held against declarations that are stored already."""

    def __init__(self, records: DataFrame, options: IngestOptions, declared, made):
        super().__init__(records, options)
        self.declared, self.made = declared, made

    def _taken(self, names: DataFrame) -> DataFrame:
        """Those of a few names that declarations bear; the few are the side to be sent about."""
        return self.declared().select("fqn").join(names.select("fqn"), "fqn", "left_semi").distinct()

    @cached_property
    def claims(self) -> DataFrame:
        """Where no declarations are stored yet, those that may bear a module's name are named for it alone."""
        return store(self._taken(self.modules_all) if self.made() else identity.claims_on(self.modules_all, self.records, self.options.language).join(self.modules_all, "fqn", "left_semi").distinct())

    @cached_property
    def unresolved(self) -> DataFrame:
        first = store(identity.first_by(self.records.where("type = 'unresolved'"), "fqn", "category"))
        others = self.modules.select("fqn").unionByName(self.files.select(F.col("path").alias("fqn")))
        taken = self._taken(first).unionByName(others.join(first.select("fqn"), "fqn", "left_semi"))
        return store(first.join(taken.distinct(), "fqn", "left_anti"))


class LeanGraph(Graph):
    """records: SEQUENCED_SCHEMA. slices: into how many parts joins are cut; no result depends on it. passing: read once, by tables()."""

    def __init__(self, records: DataFrame, ingest: IngestOptions, cleanup: CleanupOptions, slices: int = 1, passing: bool = False):
        self.passing = passing
        self.records, self.options, self.cleanup, self.n = records, ingest, cleanup, slices
        self.names = _Names(records, ingest, lambda: self.declared.whole().where("fqn IS NOT NULL"), lambda: self._made)
        self._raw, self._edges = {}, {}

    @property
    def _made(self) -> bool:
        return "declared" in vars(self)

    def _excluded(self, path: str):
        return F.coalesce(any_of([path_glob(F.col(path), e) for e in self.cleanup.excludes]), F.lit(False))

    # Declarations.

    def _declaration(self, df: DataFrame, kind: str, *copies_by: str) -> DataFrame:
        """Of blacklisted declarations the id alone is kept: they resolve edges, to nothing. kept: not excluded; copies: kept ones of this name."""
        kept = ~self.names.blacklisted("fqn") & ~self._excluded("path")
        marked = df.select("id", "fqn", F.lit(kind).alias("kind"), *identity.SPAN, kept.alias("kept"), F.sum(kept.cast("int")).over(W.partitionBy(*copies_by)).alias("copies"))
        blank = {c: F.when(~self.names.blacklisted("fqn"), F.col(c)) for c in ("fqn", *identity.SPAN)}
        return marked.withColumns(blank)

    @cached_property
    def declared(self) -> Slices:
        """id, fqn, kind, span, kept, copies of structs and of functions that no struct shadows, by id.

        A function's FQN begins with parent.name: functions, and structs by all beginnings of their names, are dealt by that.
        """
        go, name = self.options.language == "go", F.concat_ws(".", "parent", "name")
        tail = F.when(F.col("name") == "init", F.concat(F.lit("#"), basename(F.coalesce("file", F.lit(""))))) if go else F.lit(None).cast("string")
        listed = joined_params(F.coalesce("params", F.array().cast("array<string>")))
        # With parent.name, the lengths of both tell which parent and name it is.
        functions = self.records.where("type = 'function'").select(name.alias("base"), F.length("parent").alias("at"), F.length("name").alias("long"), tail.alias("tail"), listed.alias("params"), "id", *identity.SPAN)
        functions = Slices.of(functions, "base", self.n)
        structs = store(identity.struct_fqns(self.records))
        begins = F.array_union(prefixes(F.col("fqn"), "("), prefixes(F.col("fqn"), "#")) if go else prefixes(F.col("fqn"), "(")
        claims = Slices.of(structs.select("fqn", F.explode(F.array_distinct(begins)).alias("base")), "base", self.n)
        out = None
        for j in range(self.n):
            several = F.count("*").over(W.partitionBy("base", "at", "long")) > 1
            taken = claims[j].groupBy("base").agg(F.collect_set("fqn").alias("taken"))
            counted = functions[j].repartition("base").withColumn("several", several).join(taken, "base", "left")
            plain = F.when(F.col("several"), F.concat("base", F.lit("("), "params", F.lit(")"))).otherwise(F.col("base"))
            named = counted.withColumn("fqn", F.when(F.col("tail").isNotNull(), F.concat("base", "tail")).otherwise(plain))
            free = named.where(~F.coalesce(F.array_contains("taken", F.col("fqn")), F.lit(False)))
            found = self._declaration(free, FUNCTION, "base", "fqn")
            out = out or Slices(self.records.sparkSession, found.schema, self.n)
            out.add(found, "id")
            functions.drop(j), claims.drop(j)
        out.add(self._declaration(structs, STRUCT, "fqn"), "id")
        discard(structs)
        return out

    @cached_property
    def _structs(self) -> DataFrame:
        """Kept structs alone: they need no functions."""
        return store(identity.struct_fqns(self.records).where(~self.names.blacklisted("fqn") & ~self._excluded("path")).drop("seq"))

    def _units(self, kind: str) -> DataFrame:
        """Kept declarations of a kind."""
        return self._structs if kind == STRUCT and not self._made else self.declared.whole().where(F.col("kept") & (F.col("kind") == kind))

    # Nodes.

    def nodes_of(self, *kinds: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._nodes(k) for k in kinds])

    def _nodes(self, kind: str) -> DataFrame:
        empty = F.lit(None).cast("string").alias("category")
        if kind in (STRUCT, FUNCTION):
            nodes = self._units(kind).select("fqn", F.lit(kind).alias("kind"), *identity.SPAN, empty, code_type(F.col("path"), F.col("fqn"), self.options.language, self.options.config).alias("code_type"))
        elif kind == FILE:
            zero, kept = F.lit(0).cast("long"), self.names.files.where(~self._excluded("path"))
            kinds = code_type(F.col("path"), F.col("path"), self.options.language, self.options.config).alias("code_type")
            nodes = kept.select(F.col("path").alias("fqn"), F.lit(FILE).alias("kind"), "path", zero.alias("start"), zero.alias("end"), "start_line", "end_line", empty, kinds)
        elif kind == MODULE:
            nodes = self.names.module_nodes
        else:
            nodes = bare(self.names.unresolved, UNRESOLVED, F.col("category"))
        return filled(nodes)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.nodes_of(*KINDS)

    @cached_property
    def _may_be_homonyms(self) -> bool:
        """Whether a declaration, kept or not, or a module may bear a file's path as its name. A function's name begins with parent.name."""
        paths = self.names.files.select(F.col("path").alias("fqn"))
        begins = store(paths.select(F.substring("fqn", 1, 3).alias("first")).distinct())
        base = F.concat_ws(".", "parent", "name")
        first = F.substring(base, 1, 3).alias("first")
        functions = self.records.where("type = 'function'")
        if not functions.where(F.length(base) < 3).unionByName(functions.select("*", first).join(begins, "first", "left_semi").select(*functions.columns)).isEmpty():
            return True
        names = self.names.modules_all.select("fqn").unionByName(identity.struct_fqns(self.records).select("fqn"))
        near = store(names.withColumn("first", F.substring("fqn", 1, 3)).join(begins, "first", "left_semi").select("fqn"))
        return not near.join(paths, "fqn", "left_semi").isEmpty()

    @cached_property
    def _file_edges(self) -> DataFrame:
        """Ends of containment records that are files' paths. Few names begin as paths do."""
        paths = self.names.files.select("path")
        begins = store(paths.select(F.substring("path", 1, 3).alias("first")).distinct())
        ends = self.records.where("type = 'contains'").select(F.explode(F.array("from", "to")).alias("path"))
        near = store(ends.withColumn("first", F.substring("path", 1, 3)).join(begins, "first", "left_semi").select("path"))
        return store(near.join(paths, "path", "left_semi"))

    @cached_property
    def homonyms(self) -> DataFrame:
        """Files' paths that modules or declarations bear as names. Few declarations end as paths do."""
        files = self.names.files.select(F.col("path").alias("fqn"))
        ends = store(files.select(F.substring("fqn", -3, 3).alias("last")).distinct())
        near = self.declared.whole().where("kept").select("fqn", F.substring("fqn", -3, 3).alias("last")).join(ends, "last", "left_semi").select("fqn")
        near = store(near.unionByName(self.names.modules.select("fqn")))
        return store(near.join(files, "fqn", "left_semi"))

    @cached_property
    def closed(self) -> bool:
        return self._several.isEmpty() and self.homonyms.isEmpty()

    # Edges.

    def raw(self, rel: str) -> Slices:
        """from, to, target_type of a relation's records, by from."""
        if rel not in self._raw:
            kind = next(t for t, r in EDGE_TYPES.items() if r == rel)
            target = F.coalesce("target_type", F.lit("")) if rel == UNRESOLVED_CALL else F.lit("")
            self._raw[rel] = Slices.of(self.records.where(F.col("type") == kind).select("from", "to", target.alias("target_type")), "from", self.n)
        return self._raw[rel]

    def _bounds(self, rel: str) -> dict:
        """What is carried of both ends' places, where places decide: name -> column of a declaration."""
        return dict(zip(BOUNDS, ("start", "start", "end"))) if rel == CONTAINS and self.cleanup.language == "java" else {}

    def _ends(self, j: int, end: str, bounds: dict) -> DataFrame:
        """The declarations that an id names: key, whether it is kept, and what it is."""
        places = [F.col(c).alias(f"{end}_{b}") for b, c in bounds.items()]
        return self.declared[j].select(F.col("id").alias("key"), "kept", F.col("fqn").alias(f"{end}_fqn"), F.col("kind").alias(f"{end}_kind"), *places)

    def _looked_up(self, edges: DataFrame, j: int, column: str, end: str, bounds: dict) -> DataFrame:
        """Ids turned into FQNs. Edges of ids that are not kept go; what is no id stays as it is, without a kind."""
        met = edges.join(self._ends(j, end, bounds), F.col(column) == F.col("key"), "left").where(F.col("key").isNull() | F.col("kept"))
        return met.withColumn(end, F.coalesce(f"{end}_fqn", column)).drop("key", "kept", f"{end}_fqn", column)

    def _named(self, edges: DataFrame, end: str, kinds, bounds: dict) -> DataFrame:
        """Ends that are names get the kinds of the nodes of that name."""
        spans = [F.col(c).alias(f"{end}_{b}") for b, c in bounds.items()]
        nodes = self.nodes_of(*kinds).select(F.col("fqn").alias(end), F.col("kind").alias(f"{end}_kind"), *spans)
        return edges.drop(f"{end}_kind", *[f"{end}_{b}" for b in bounds]).join(nodes, end)

    def _repeated(self, *kinds: str) -> DataFrame:
        """_several, of these kinds at least. Structs need no other declarations for that."""
        if self._made or FUNCTION in kinds:
            return self._several
        return self._structs_repeated

    @cached_property
    def _structs_repeated(self) -> DataFrame:
        counted = self._structs.groupBy("fqn").agg(F.count("*").alias("n"))
        return store(counted.where("n > 1").withColumn("kind", F.lit(STRUCT)))

    @cached_property
    def _several(self) -> DataFrame:
        """Names that several kept declarations of a kind bear."""
        d = self.declared.whole().where("kept AND copies > 1")
        return store(d.groupBy("fqn", "kind").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("start").alias("last_start"), F.min("end").alias("end")))

    def _resolved(self, rel: str) -> DataFrame:
        """The relation's records as edges between nodes, not yet distinct, with the places of both ends."""
        self.declared  # before the relation's records are stored
        raw, named = self.raw(rel), rel in (UNRESOLVED_CALL, UNRESOLVED_USE)
        src_kinds, dst_kinds = ({p[k] for p in ALLOWED[rel]} for k in (0, 1))
        spark, half, bounds = self.records.sparkSession, None, self._bounds(rel)
        for j in range(self.n):
            edges = raw[j]
            if rel == CONTAINS:  # a type of a shadowed module's name contains nothing of it
                edges = edges.join(self.names.modules_shadowed.select(F.col("fqn").alias("from")), "from", "left_anti")
            if named:  # targets are names
                edges = edges.join(self.names.unresolved.select(F.col("fqn").alias("to")).distinct(), "to", "left_semi")
            edges = self._looked_up(edges, j, "from", "src", bounds).where(F.col("src_kind").isNull() | F.col("src_kind").isin(*src_kinds))
            half = half or Slices(spark, edges.schema, self.n)
            half.add(edges, "to")
            raw.drop(j)
        del self._raw[rel]
        out = None
        for j in range(self.n):
            if named:
                edges = half[j].select("*", F.col("to").alias("dst"), F.lit(UNRESOLVED).alias("dst_kind")).drop("to")
            else:
                edges = self._looked_up(half[j], j, "to", "dst", bounds).where(F.col("dst_kind").isNull() | F.col("dst_kind").isin(*dst_kinds))
            out = out or Slices(spark, edges.schema, self.n)
            out.add(edges, "dst")
            half.drop(j)
        known, unknown = out.whole().where("src_kind IS NOT NULL AND dst_kind IS NOT NULL"), out.whole().where("src_kind IS NULL OR dst_kind IS NULL")
        columns = out.schema.fieldNames()
        for end, kinds in (("src", src_kinds), ("dst", dst_kinds)):
            lost = unknown.where(F.col(f"{end}_kind").isNull())
            if not lost.isEmpty():
                unknown = unknown.where(F.col(f"{end}_kind").isNotNull()).select(*columns).unionByName(self._named(lost, end, [k for k in KINDS if k in kinds], bounds).select(*columns))
        found = known.unionByName(unknown.where("src_kind IS NOT NULL AND dst_kind IS NOT NULL").select(*columns)).withColumn("rel", F.lit(rel))
        barred = self.names.blacklisted("src") if named else self.names.blacklisted("src") | self.names.blacklisted("dst")
        found = found.where(~barred & kind_pair_allowed())
        found.slices = out
        return found

    def _wired(self, src_kind: str, dst_kind: str) -> DataFrame | None:
        """Containment that needs no edge record: of files in modules, and of units in files."""
        files = self.names.files.where(~self._excluded("path"))
        if (src_kind, dst_kind) == (MODULE, FILE):
            found = files.where("parent <> ''").join(self.names.modules.select(F.col("fqn").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("src"), F.col("path").alias("dst"))
        elif src_kind == FILE and dst_kind in (STRUCT, FUNCTION):
            units = self._units(dst_kind).select(F.col("path").alias("src"), F.col("fqn").alias("dst"))
            found = units.join(files.select(F.col("path").alias("src")), "src", "left_semi")
        else:
            return None
        return found.select("src", "dst", F.lit(CONTAINS).alias("rel"), F.lit(src_kind).alias("src_kind"), F.lit(dst_kind).alias("dst_kind"), F.lit("").alias("target_type"))

    def _recorded(self, rel: str) -> DataFrame:
        """The relation's edges that records tell of, once each, without those (Java) to methods outside their type's span."""
        if rel not in self._edges:
            found = self._resolved(rel)
            edges, slices = found, found.slices
            if rel == CONTAINS and self.cleanup.language == "java":
                if not self._several.isEmpty():
                    edges = self._outermost(self._outermost(edges, "src"), "dst")
                method = (F.col("src_kind") == STRUCT) & (F.col("dst_kind") == FUNCTION)
                outside = (F.col("dst_start") < F.col("src_last_start")) | (F.col("dst_last_start") > F.col("src_end"))
                edges = edges.where(~F.coalesce(method & outside, F.lit(False)))
            self._edges[rel] = store(edges.select(*EDGE).distinct())
            slices.drop()
        return self._edges[rel]

    def _outermost(self, edges: DataFrame, end: str) -> DataFrame:
        named = self._several.select(F.col("fqn").alias(end), F.col("kind").alias(f"{end}_kind"), *[F.col(b).alias(f"_{b}") for b in BOUNDS])
        met = edges.join(named, [end, f"{end}_kind"], "left")
        return met.withColumns({f"{end}_{b}": F.coalesce(f"_{b}", f"{end}_{b}") for b in BOUNDS}).drop(*[f"_{b}" for b in BOUNDS])

    def edges_of(self, rel: str, src_kind: str | None = None, dst_kind: str | None = None) -> DataFrame:
        pairs = [(a, b) for a, b in ALLOWED[rel] if src_kind in (None, a) and dst_kind in (None, b)]
        kinds = {k for p in pairs for k in p}
        of_files = rel == CONTAINS and bool(pairs) and all(FILE in p for p in pairs)
        # Files' containment is of their records and paths: edge records are resolved for it where one has a file for an end.
        if not of_files or FUNCTION in kinds or self._may_be_homonyms:
            self.declared
        if self._made and not self.homonyms.isEmpty():  # an edge may join more kinds than those by which its ends were found
            return Graph(None, self._all.edges).edges_of(rel, src_kind, dst_kind)
        recorded, parts = None if of_files and self._file_edges.isEmpty() else self._recorded(rel), []
        repeated = self._repeated(*kinds)
        for a, b in pairs:
            wired = self._wired(a, b) if rel == CONTAINS else None
            if recorded is None:
                edges = wired if b == FILE or repeated.isEmpty() else wired.distinct()
            else:
                edges = recorded.where((F.col("src_kind") == a) & (F.col("dst_kind") == b))
                if wired is not None:
                    edges = wired if edges.isEmpty() and (b == FILE or repeated.isEmpty()) else edges.unionByName(wired).distinct()
            parts.append(edges)
        if not parts:
            return recorded.limit(0)
        edges = reduce(DataFrame.unionByName, parts)
        if not repeated.isEmpty():  # an edge for each pair of nodes
            for end in ("src", "dst"):
                times = repeated.select(F.col("fqn").alias(end), F.col("kind").alias(f"{end}_kind"), "n")
                edges = edges.join(times, [end, f"{end}_kind"], "left").withColumn("n", F.explode(F.array_repeat(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))).select(*EDGE)
        return edges

    def tables(self):
        """Kind by kind and relation by relation. A passing graph drops a relation's edges when the next is asked for."""
        for kind in KINDS:
            yield "nodes", self.nodes_of(kind)
        for rel in RELS:
            yield "edges", self.edges_of(rel)
            if self.passing and rel in self._edges:
                discard(self._edges.pop(rel))

    @cached_property
    def _all(self) -> Graph:
        return Cleanup(Ingest(store(self.records), self.options).graph, self.cleanup).result

    @cached_property
    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.edges_of(rel) for rel in RELS])
