"""Read-only pattern queries, compiled to DataFrames.

MATCH pattern, ... [WHERE expression] RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n] [;]
A pattern is (var:Label {prop: literal})-[var:Type]->(...), with <-[...]- for the other direction and [:Type*low..high] for
paths of so many steps, a row a path, nodes visited again included. Expressions have =, <>,
<, <=, >, >=, AND, OR, NOT, IN, CONTAINS, STARTS WITH, ENDS WITH, IS [NOT] NULL. Items are var.prop, labels(var), type(rel),
count(*), count([DISTINCT] x), min, max, sum, avg, collect; what is no aggregate groups. ORDER BY takes names or ordinals. A GROUP BY tail may repeat what is
implied. Two variables may be bound to the same node; nulls sort first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import KINDS, NODE_TABLES, RELS, Graph

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<tick>`[^`]+`)|(?P<name>[^\W\d]\w*)|(?P<op><>|<=|>=|->|<-|[-()\[\]{}:,.=<>;*]))")
_WRITES = {"CREATE", "MERGE", "SET", "DELETE", "REMOVE", "DETACH", "DROP", "COPY", "ALTER", "INSERT", "CALL", "LOAD", "INSTALL"}
_AGGREGATES = {"count", "min", "max", "sum", "avg", "collect"}
#: Longest path of a pattern; each step is a join.
MOST_STEPS = 12
NODE_PROPERTIES = ("fqn", "path", "start", "end", "start_line", "end_line", "category", "code_type")
EDGE_PROPERTIES = ("target_type",)


class QueryError(ValueError):
    pass


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Hop:
    var: str
    rel: str | None
    forward: bool
    low: int = 1
    high: int = 1


@dataclass
class Query:
    patterns: list
    where: object
    items: list
    distinct: bool
    order: list
    skip: int | None
    limit: int | None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at:at + 10]!r} at {at}")
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.unnamed = tokens(text), 0, 0

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def is_word(self, *words: str) -> bool:
        return self.now[0] == "name" and self.now[1].upper() in words

    def is_op(self, op: str) -> bool:
        return self.now == ("op", op)

    def take(self, value: str | None = None) -> str:
        kind, got = self.now
        if value is not None and (got.upper() if kind == "name" else got) != value:
            raise QueryError(f"expected {value}, found {got or 'the end'}")
        self.at += 1
        return got

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def op(self, op: str) -> bool:
        if self.is_op(op):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        kind, got = self.now
        if kind not in ("name", "tick"):
            raise QueryError(f"expected a name, found {got or 'the end'}")
        self.at += 1
        return got.strip("`")

    def literal(self):
        kind, got = self.now
        self.at += 1
        if kind == "num":
            return float(got) if "." in got else int(got)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", got[1:-1])
        if kind == "op" and got == "-":
            return -self.literal()
        if kind == "name" and got.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[got.upper()]
        raise QueryError(f"expected a literal, found {got or 'the end'}")

    def fresh(self) -> str:
        self.unnamed += 1
        return f"_{self.unnamed}"

    def query(self) -> Query:
        if self.is_word(*_WRITES):
            raise QueryError(f"read-only: {self.now[1]}")
        self.take("MATCH")
        patterns = [self.pattern()]
        while self.op(","):
            patterns.append(self.pattern())
        where = self.either() if self.word("WHERE") else None
        if self.is_word(*_WRITES):
            raise QueryError(f"read-only: {self.now[1]}")
        self.take("RETURN")
        distinct = self.word("DISTINCT")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        if self.word("GROUP"):
            self.take("BY")
            self.item()
            while self.op(","):
                self.item()
        order = []
        if self.word("ORDER"):
            self.take("BY")
            while True:
                what = self.literal() if self.now[0] == "num" else self.item()
                down = self.word("DESC", "DESCENDING")
                if not down:
                    self.word("ASC", "ASCENDING")
                order.append((what, down))
                if not self.op(","):
                    break
        skip = self.literal() if self.word("SKIP") else None
        limit = self.literal() if self.word("LIMIT") else None
        self.op(";")
        if self.now[0] != "end":
            raise QueryError(f"unexpected {self.now[1]!r}")
        return Query(patterns, where, items, distinct, order, skip, limit)

    def pattern(self) -> list:
        parts = [self.node()]
        while self.is_op("-") or self.is_op("<-"):
            parts += [self.hop(), self.node()]
        return parts

    def node(self) -> Node:
        self.take("(")
        var = self.name() if self.now[0] in ("name", "tick") else self.fresh()
        label = self.name() if self.op(":") else None
        if label is not None and label not in KINDS:
            raise QueryError(f"no label {label}")
        props = {}
        if self.op("{"):
            while True:
                key = self.name()
                self.take(":")
                props[key] = self.literal()
                if not self.op(","):
                    break
            self.take("}")
        self.take(")")
        return Node(var, label, props)

    def hop(self) -> Hop:
        forward = not self.op("<-")
        if forward:
            self.take("-")
        self.take("[")
        var = self.name() if self.now[0] in ("name", "tick") else self.fresh()
        rel = self.name() if self.op(":") else None
        if rel is not None and rel not in RELS:
            raise QueryError(f"no relation {rel}")
        low = high = 1
        if self.op("*"):
            low = high = self.steps()
            if self.op("."):
                self.take(".")
                high = self.steps()
            if not 1 <= low <= high <= MOST_STEPS:
                raise QueryError(f"paths have 1 to {MOST_STEPS} steps")
        self.take("]")
        self.take("->" if forward else "-")
        return Hop(var, rel, forward, low, high)

    def steps(self) -> int:
        kind, got = self.now
        if kind != "num" or "." in got:
            raise QueryError("a path needs its number of steps")
        self.at += 1
        return int(got)

    def item(self):
        at = self.at
        expr = self.operand()
        shown = self._text(at)
        alias = self.name() if self.word("AS") else shown
        return expr, alias

    def _text(self, at: int) -> str:
        words = [v for _, v in self.tokens[at : self.at]]
        return "".join(w + (" " if w.upper() == "DISTINCT" else "") for w in words).replace("`", "")

    def either(self):
        left = self.both()
        while self.word("OR"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.word("AND"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        if self.word("NOT"):
            return ("not", self.negated())
        if self.op("("):
            inner = self.either()
            self.take(")")
            return inner
        return self.comparison()

    def comparison(self):
        left = self.operand()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.op(op):
                return (op, left, self.operand())
        if self.word("CONTAINS"):
            return ("contains", left, self.operand())
        if self.word("STARTS"):
            self.take("WITH")
            return ("starts", left, self.operand())
        if self.word("ENDS"):
            self.take("WITH")
            return ("ends", left, self.operand())
        if self.word("IN"):
            self.take("[")
            values = [] if self.is_op("]") else [self.literal()]
            while self.op(","):
                values.append(self.literal())
            self.take("]")
            return ("in", left, values)
        if self.word("IS"):
            no = self.word("NOT")
            self.take("NULL")
            return ("not", ("null", left)) if no else ("null", left)
        raise QueryError(f"expected a comparison, found {self.now[1] or 'the end'}")

    def operand(self):
        kind, got = self.now
        if kind in ("num", "str") or (kind == "op" and got == "-") or self.is_word("TRUE", "FALSE", "NULL"):
            return ("literal", self.literal())
        name = self.name()
        if self.op("("):
            if self.op("*"):
                self.take(")")
                return ("call", name.lower(), None, False)
            distinct = self.word("DISTINCT")
            inner = self.operand()
            self.take(")")
            return ("call", name.lower(), inner, distinct)
        if self.op("."):
            return ("prop", name, self.name())
        return ("var", name)


class Planner:
    def __init__(self, graph: Graph, query: Query):
        self.graph, self.query = graph, query
        self.nodes: dict[str, Node] = {}
        self.hops: dict[str, Hop] = {}

    def node_frame(self, node: Node) -> DataFrame:
        df = self.graph.nodes_of(node.label) if node.label else self.graph.nodes
        for key, value in node.props.items():
            if key not in NODE_PROPERTIES:
                raise QueryError(f"no property {key}")
            df = df.where(F.col(key) == value)
        return df.select(*[F.col(c).alias(f"{node.var}.{c}") for c in df.columns])

    def edge_frame(self, hop: Hop, source: Node, target: Node) -> DataFrame:
        """The filters on relation and kinds are the partitions that a stored graph is read by."""
        if hop.high > 1:
            df = self.paths(self.graph.edges_of(hop.rel) if hop.rel else self.graph.edges, hop)
        else:
            df = self.graph.edges_of(hop.rel, source.label, target.label) if hop.rel else self.graph.edges
        if hop.high > 1 or not hop.rel:
            for node, kind in ((source, "src_kind"), (target, "dst_kind")):
                if node.label:
                    df = df.where(F.col(kind) == node.label)
        return df.select(*[F.col(c).alias(f"{hop.var}.{c}") for c in ("src", "dst", "rel", "target_type", "src_kind", "dst_kind")])

    def paths(self, edges: DataFrame, hop: Hop) -> DataFrame:
        """Ends of the paths of low to high steps, as edges. The kinds of both ends are kept, those between are free."""
        step = edges.select(F.col("src").alias("_mid"), F.col("dst").alias("_to"), F.col("dst_kind").alias("_kind"))
        walked = edges.select("src", "dst", "src_kind", "dst_kind")
        out = walked if hop.low == 1 else None
        for k in range(2, hop.high + 1):
            walked = walked.join(step, walked["dst"] == step["_mid"]).select("src", F.col("_to").alias("dst"), "src_kind", F.col("_kind").alias("dst_kind"))
            if k >= hop.low:
                out = walked if out is None else out.unionByName(walked)
        return out.select("src", "dst", "src_kind", "dst_kind", F.lit(hop.rel).cast("string").alias("rel"), F.lit(None).cast("string").alias("target_type"))

    def match(self) -> DataFrame:
        merged: dict[str, Node] = {}
        for pattern in self.query.patterns:
            for node in pattern[::2]:
                old = merged.setdefault(node.var, Node(node.var, node.label, dict(node.props)))
                if node.label and old.label and node.label != old.label:
                    raise QueryError(f"{node.var} has two labels")
                old.label = old.label or node.label
                old.props.update(node.props)
        self.nodes = merged
        bound: set[str] = set()
        out: DataFrame | None = None
        self.plain = {v for v, n in merged.items() if not n.props and self.used(v) <= {"fqn"}} if self.graph.closed else set()
        waiting = list(self.query.patterns)
        while waiting:  # patterns that share a variable with what is bound come first
            pattern = next((p for p in waiting if any(n.var in bound for n in p[::2])), waiting[0])
            waiting.remove(pattern)
            out = self.add_pattern(out, pattern, bound)
        return out

    def used(self, var: str) -> set[str]:
        """The properties of a node that the query names; its kind counts as one."""
        found = set()

        def walk(x):
            if isinstance(x, (tuple, list)):
                if len(x) == 3 and x[0] == "prop" and x[1] == var:
                    found.add(x[2])
                elif len(x) == 4 and x[0] == "call" and x[1] in ("labels", "label") and x[2] == ("var", var):
                    found.add("kind")
                else:
                    for y in x:
                        walk(y)

        walk([self.query.where, self.query.items, self.query.order])
        return found

    def add_pattern(self, out: DataFrame | None, pattern: list, bound: set[str]) -> DataFrame:
        nodes, hops = pattern[::2], pattern[1::2]
        if out is not None and not any(n.var in bound for n in nodes):
            raise QueryError("patterns must share a variable")
        start = next((k for k, n in enumerate(nodes) if n.var in bound), 0)
        if nodes[start].var not in bound:
            bound.add(nodes[start].var)
            if not hops or nodes[start].var not in self.plain:
                out = self.node_frame(self.nodes[nodes[start].var])
            else:
                out = None  # a node of which the name alone is asked for is the end of an edge
        steps = [(k, k, k + 1) for k in range(start, len(hops))] + [(k, k + 1, k) for k in range(start - 1, -1, -1)]
        for k, near, far in steps:
            out = self.add_hop(out, hops[k], nodes[k].var, nodes[k + 1].var, nodes[near].var, nodes[far].var, bound)
        return out

    def add_hop(self, out: DataFrame, hop: Hop, left: str, right: str, near: str, far: str, bound: set[str]) -> DataFrame:
        if hop.var in self.hops:
            raise QueryError(f"{hop.var} is bound twice")
        self.hops[hop.var] = hop
        source, target = (left, right) if hop.forward else (right, left)
        edges = self.edge_frame(hop, self.nodes[source], self.nodes[target])
        here, there = ("src", "dst") if source == near else ("dst", "src")
        if out is None:
            out = edges.withColumn(f"{near}.fqn", F.col(f"`{hop.var}.{here}`"))
        else:
            out = out.join(edges, out[f"`{near}.fqn`"] == edges[f"`{hop.var}.{here}`"])
        if far in bound:
            return out.where(F.col(f"`{far}.fqn`") == F.col(f"`{hop.var}.{there}`"))
        bound.add(far)
        if far in self.plain:
            return out.withColumn(f"{far}.fqn", F.col(f"`{hop.var}.{there}`"))
        nodes = self.node_frame(self.nodes[far])
        return out.join(nodes, out[f"`{hop.var}.{there}`"] == nodes[f"`{far}.fqn`"])

    def column(self, expr) -> Column:
        kind = expr[0]
        if kind == "literal":
            return F.lit(expr[1])
        if kind == "prop":
            var, prop = expr[1:]
            if var in self.nodes:
                label = self.nodes[var].label
                if prop not in NODE_PROPERTIES or (label and prop not in NODE_TABLES[label]):
                    raise QueryError(f"no property {prop}" + (f" on {label}" if label else ""))
            elif var not in self.hops:
                raise QueryError(f"no variable {var}")
            elif prop not in EDGE_PROPERTIES:
                raise QueryError(f"no property {prop} on a relation")
            return F.col(f"`{var}.{prop}`")
        if kind == "var":
            if expr[1] in self.nodes:
                return F.col(f"`{expr[1]}.fqn`")
            if expr[1] in self.hops:
                return F.struct(*[F.col(f"`{expr[1]}.{c}`").alias(c) for c in ("src", "rel", "dst", "target_type")])
            raise QueryError(f"no variable {expr[1]}")
        if kind == "call":
            return self.call(*expr[1:])
        raise QueryError(f"no operand {kind}")

    def call(self, name: str, inner, distinct: bool) -> Column:
        if name in ("labels", "label") and inner[0] == "var" and inner[1] in self.nodes:
            kind = F.col(f"`{inner[1]}.kind`")
            return F.array(kind) if name == "labels" else kind
        if name == "type" and inner[0] == "var" and inner[1] in self.hops:
            return F.col(f"`{inner[1]}.rel`")
        if name not in _AGGREGATES:
            raise QueryError(f"no function {name}")
        if inner is None:
            return F.count(F.lit(1))
        column = self.column(inner)
        if name == "count":
            return F.count_distinct(column) if distinct else F.count(column)
        if name == "collect":
            return F.array_sort(F.collect_set(column) if distinct else F.collect_list(column))
        return {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[name](column)

    def condition(self, expr) -> Column:
        op = expr[0]
        if op in ("and", "or"):
            a, b = self.condition(expr[1]), self.condition(expr[2])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.condition(expr[1])
        left = self.column(expr[1])
        if op == "null":
            return left.isNull()
        if op == "in":
            return left.isin(*expr[2]) if expr[2] else F.lit(False)
        right = self.column(expr[2])
        return {
            "=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right,
            ">=": lambda: left >= right, "contains": lambda: F.contains(left, right), "starts": lambda: F.startswith(left, right), "ends": lambda: F.endswith(left, right),
        }[op]()

    def run(self) -> DataFrame:
        out = self.match()
        if self.query.where is not None:
            out = out.where(self.condition(self.query.where))
        items = self.query.items
        names = [alias for _, alias in items]
        if len(set(names)) < len(names):
            raise QueryError("two items have one name")
        grouped = any(e[0] == "call" and e[1] in _AGGREGATES for e, _ in items)
        hidden: list[tuple] = []
        order = []
        for what, down in self.query.order:
            if isinstance(what, int):
                if not 1 <= what <= len(items):
                    raise QueryError(f"no item {what}")
                key = names[what - 1]
            else:
                expr, shown = what
                key = next((a for e, a in items if e == expr or a == shown), None)
                if key is None:
                    if grouped or self.query.distinct:
                        raise QueryError(f"{shown} is not returned")
                    key = f"_order{len(hidden)}"
                    hidden.append((expr, key))
            order.append(F.col(f"`{key}`").desc() if down else F.col(f"`{key}`").asc())
        if grouped:
            keys = [(e, a) for e, a in items if not (e[0] == "call" and e[1] in _AGGREGATES)]
            made = out.groupBy(*[self.column(e).alias(a) for e, a in keys]).agg(*[self.column(e).alias(a) for e, a in items if (e, a) not in keys])
            out = made.select(*[F.col(f"`{n}`") for n in names])
        else:
            out = out.select(*[self.column(e).alias(a) for e, a in [*items, *hidden]])
        if self.query.distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*order)
        if self.query.skip:
            out = out.offset(self.query.skip)
        if self.query.limit is not None:
            out = out.limit(self.query.limit)
        return out.select(*[F.col(f"`{n}`") for n in names])


def query(graph: Graph, text: str, plain_names: bool = False) -> DataFrame:
    """The rows of a query. Columns are named as written (s.fqn); with plain_names, dots and brackets turn into underscores."""
    out = Planner(graph, Parser(text).query()).run()
    if plain_names:
        out = reduce(lambda d, c: d.withColumnRenamed(c, re.sub(r"\W+", "_", c).strip("_")), out.columns, out)
    return out
