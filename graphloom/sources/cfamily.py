"""A heuristic scanner of C and C++ sources: facts by file in Python, everything between files as joins.

A file is read alone: comments and strings are blanked, braces matched, and what stands before a brace tells a namespace,
a type or a function. The facts are declarations, call sites, local variables and type names. Which declaration a call
means is decided by graphloom.operators.resolution over all files' facts; what none fits becomes an unresolved edge.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import any_of, below_any, category_cpp, dotted, without_parts
from graphloom.model import SEQUENCED_SCHEMA
from graphloom.operators import resolution
from graphloom.storage import store

ENDS = (".cpp", ".cc", ".cxx", ".c", ".hpp", ".hh", ".hxx", ".h")
#: Words before a parenthesis that call nothing, and words that are no type's name.
NO_CALL = {"if", "for", "while", "switch", "return", "sizeof", "catch", "alignof", "decltype", "defined", "new", "delete", "throw", "else", "do", "case", "static_assert", "noexcept", "alignas", "typeid", "co_await", "co_return", "co_yield", "static_cast", "dynamic_cast", "const_cast", "reinterpret_cast", "operator", "template", "using", "typedef", "explicit"}
NO_TYPE = {"return", "else", "delete", "new", "throw", "goto", "case", "public", "private", "protected", "using", "typedef", "typename", "friend", "break", "continue", "default", "operator", "struct", "class", "enum", "union", "namespace", "template", "if", "for", "while", "do", "switch", "const", "static", "inline", "virtual", "constexpr", "extern", "mutable", "volatile", "unsigned", "signed", "auto", "this", "sizeof", "not", "and", "or"}

_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|R"([^\s()\\]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*#(?:[^\n\\]|\\.)*', re.S | re.M)
_TYPE = re.compile(r"\b(class|struct|union|enum)\s+(?:class\s+|struct\s+)?(?:\[\[[^\]]*\]\]\s*)?(?:[A-Z_]{3,}\s+)?([A-Za-z_]\w*)\s*(?:final\s*)?(?::(?!:)\s*([^{]*))?$")
_SPACE = re.compile(r"\bnamespace\s+([A-Za-z_][\w:]*)?\s*$")
_FUNCTION = re.compile(r"((?:[A-Za-z_]\w*\s*::\s*)*~?[A-Za-z_]\w*|operator\s*[^\s\w(]{1,3}|operator\s*\(\s*\))\s*\(([^{}]*)\)\s*(?:const|noexcept(?:\([^)]*\))?|override|final|mutable|&&?|->\s*[\w:<>,\s*&]+|\s)*(?::(?!:)[^{}]*)?$", re.S)
_CALL = re.compile(r"(?:([A-Za-z_]\w*)\s*(\.|->)\s*)?((?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)\s*\(")
_LOCAL = re.compile(r"(?:^|[;{}(])\s*(?:const\s+|static\s+)*((?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)(?:\s*<[^;{}()]*>)?\s*[*&]*\s+[*&]*([A-Za-z_]\w*)\s*(?=[;=({\[,)])")

FACT_SCHEMA = "path string, module string, fact string, fqn string, parent string, name string, params string, start long, `end` long, start_line long, end_line long, receiver string, target string"


def blanked(text: str) -> str:
    """The same length, with comments, literals and directives as spaces; line feeds stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def parameters(text: str) -> list[tuple[str, str]]:
    """(type, name) of each parameter."""
    depth, parts, now = 0, [], ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth <= 0:
            parts.append(now)
            now = ""
        else:
            now += c
    out = []
    for part in [*parts, now]:
        words = re.sub(r"=.*", "", part, flags=re.S).split()
        words = [w for w in " ".join(words).replace("*", " * ").replace("&", " & ").split() if w not in ("const", "struct", "class", "enum", "volatile")]
        if not words or words == ["void"]:
            continue
        named = len([w for w in words if w not in "*&"]) > 1 and re.fullmatch(r"[A-Za-z_]\w*", words[-1])
        out.append(("".join(words[:-1] if named else words), words[-1] if named else ""))
    return out


def type_name(text: str) -> str:
    return re.sub(r"<.*|[*&\s]|\[\]", "", text, flags=re.S)


def facts_of(path: str, module: str, text: str) -> list[tuple]:
    """Rows of FACT_SCHEMA for one file."""
    clean, rows = blanked(text), []
    # Offsets in bytes, as records have them.
    byte = [0]
    for c in text:
        byte.append(byte[-1] + len(c.encode()))
    lines = [0, *[m.end() for m in re.finditer("\n", text)]]

    def line(at: int) -> int:
        low, high = 0, len(lines)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if lines[mid] <= at else (low, mid)
        return low

    def put(fact, fqn="", parent="", name="", params="", a=0, b=0, receiver="", target=""):
        rows.append((path, module, fact, fqn, parent, name, params, byte[a], byte[b], line(a), line(max(a, b - 1)), receiver, target))

    rows.append((path, module, "file", path, module, "", "", 0, 0, 1, max(1, len(lines) - (1 if text.endswith("\n") and len(lines) > 1 else 0)), "", ""))
    stack: list[tuple[str, str, int, tuple]] = []  # (kind, fqn, start, details)
    last = 0

    def scope() -> str:
        return next((f for k, f, _, _ in reversed(stack) if k != "block"), module)

    for m in re.finditer(r"[{};]", clean):
        at, mark = m.start(), m[0]
        if mark == "}":
            if stack:
                kind, fqn, begun, details = stack.pop()
                if kind in ("struct", "function"):
                    parent, name, params, body = details
                    put(kind, fqn, parent, name, params, begun, at + 1)
                    if kind == "function":
                        body_facts(clean, fqn, parent, params, body, at, put)
            last = at + 1
            continue
        head = clean[last:at]
        if mark == ";":
            inside = next((x for x in reversed(stack) if x[0] != "block"), None)
            if inside and inside[0] == "struct" and "(" not in head:
                field = re.match(r"\s*(?:const\s+|static\s+|mutable\s+)*((?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)(?:\s*<[^;]*>)?[\s*&]+[A-Za-z_]\w*", re.sub(r"^\s*(?:public|private|protected)\s*:", "", head))
                if field and field[1] not in NO_TYPE:
                    put("type", inside[1], receiver="field", target=type_name(field[1]))
            last = at + 1
            continue
        begun = last + len(head) - len(head.lstrip())
        inside_function = any(k == "function" for k, _, _, _ in stack)
        if (found := _SPACE.search(head)) and not inside_function:
            fqn = ".".join([scope(), *(found[1] or "").split("::")]).rstrip(".")
            if found[1]:
                put("namespace", fqn, scope())
            stack.append(("namespace", fqn, begun, ()))
        elif (found := _TYPE.search(head)) and "(" not in head[found.start() :]:
            fqn = f"{scope()}.{found[2]}"
            for base in re.split(r",", found[3] or "") if found[1] != "enum" else []:
                name = type_name(re.sub(r"\b(public|private|protected|virtual)\b", "", base))
                if name:
                    put("type", fqn, receiver="base", target=name)
            stack.append(("struct", fqn, begun, (scope(), found[2], "", at)))
        elif not inside_function and (found := _FUNCTION.search(head)) and found[1].split("::")[-1].strip() not in NO_CALL:
            names = [x.strip() for x in found[1].split("::")]
            parent = ".".join([scope(), *names[:-1]])
            stack.append(("function", f"{parent}.{names[-1]}", begun, (parent, names[-1], found[2], at)))
        else:
            stack.append(("block", "", begun, ()))
        last = at + 1
    return rows


def body_facts(clean: str, fqn: str, parent: str, params: str, start: int, end: int, put) -> None:
    body = clean[start:end]
    for kind, name in parameters(params):
        put("type", fqn, receiver="parameter", target=type_name(kind))
        if name:
            put("variable", fqn, name=name, target=type_name(kind))
    for m in _LOCAL.finditer(body):
        if m[1] not in NO_TYPE and m[2] not in NO_TYPE:
            put("variable", fqn, name=m[2], target=type_name(m[1]))
            put("type", fqn, receiver="local", target=type_name(m[1]))
    for m in _CALL.finditer(body):
        name = re.sub(r"\s", "", m[3])
        if name not in NO_CALL:
            put("call", fqn, parent, name, receiver=m[1] or "", target="member" if m[1] else "qualified" if "::" in name else "bare")


def facts(spark: SparkSession, root: str, excludes=(), modules=()) -> DataFrame:
    """Facts of all sources below root; a file's module is its first folder below root, or root itself.

    modules: folders, absolute or below root (`.`: root itself), to which the scan is restricted; a file's module is the
    innermost of them. A file that can't be read is left out, one that can't be parsed has no declarations.
    """
    folders = sorted({str(PurePosixPath(root, m)) for m in modules}, key=len, reverse=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    local = F.regexp_replace("path", "^file:/+", "/")
    kept = any_of([F.lower(local).endswith(e) for e in ENDS]) & without_parts(local, excludes) & below_any(local, folders) & ~local.rlike(r"/\.[^/]+(/|$)")
    base = root.rstrip("/")

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                below = PurePosixPath(path).relative_to(base).parts
                module = next((PurePosixPath(f).name for f in folders if path.startswith(f.rstrip("/") + "/")), below[0] if len(below) > 1 else PurePosixPath(base).name)
                try:
                    rows += facts_of(path, module, bytes(content).decode("utf-8", "replace"))
                except (ValueError, IndexError, KeyError, RecursionError):
                    rows += facts_of(path, module, "")
            yield pd.DataFrame(rows, columns=[c.strip("` ").split(" ")[0].strip("`") for c in FACT_SCHEMA.split(", ")])

    return files.select(local.alias("path"), "content").where(kept).mapInPandas(run, FACT_SCHEMA)


def records(spark: SparkSession, root: str, excludes=(), modules=()) -> DataFrame:
    """SEQUENCED_SCHEMA records of a C or C++ project. The first declaration of a name counts, by path and place."""
    found = store(facts(spark, root, excludes, modules))
    order = F.struct("path", "start")
    first = lambda kind, keys: found.where(F.col("fact") == kind).groupBy(*keys).agg(F.min_by(F.struct("path", "name", "parent", "params", "start", "end", "start_line", "end_line", "module"), order).alias("d")).select(*keys, "d.*")
    structs, functions = first("struct", ["fqn"]), first("function", ["fqn"])
    functions = functions.join(structs.select("fqn"), "fqn", "left_anti")
    declared = structs.withColumn("kind", F.lit("struct")).unionByName(functions.withColumn("kind", F.lit("function")))
    declared = store(resolution.numbered(declared, "path", "start", "fqn"))
    names = declared.select("id", "fqn", "kind")
    is_struct, is_function = F.col("kind") == "struct", F.col("kind") == "function"
    class_of = lambda column: F.element_at(F.split(column, "[.]"), -1)

    def by_id(edges: DataFrame) -> DataFrame:
        """from and to, given by FQN, as ids."""
        own = names.select(F.col("fqn").alias("from"), F.col("id").alias("from_id"))
        other = names.select(F.col("fqn").alias("to"), F.col("id").alias("to_id"))
        return edges.join(own, "from").join(other, "to").select("type", F.col("from_id").alias("from"), F.col("to_id").alias("to"))

    # Calls: a member of a local variable's type; else the innermost scope that has the name; else the only one of that name.
    calls = store(found.where("fact = 'call'").select(F.col("fqn").alias("unit"), F.col("parent").alias("scope"), dotted(F.col("name")).alias("name"), "receiver", F.col("target").alias("shape"), "module").distinct())
    typed = found.where("fact = 'variable'").select(F.col("fqn").alias("unit"), F.col("name").alias("receiver"), class_of(dotted(F.col("target"))).alias("simple")).distinct()
    single = names.where(is_struct).groupBy(class_of(F.col("fqn")).alias("simple")).agg(F.min("fqn").alias("class"), F.count("*").alias("n")).where("n = 1").select("simple", "class")
    methods = names.where(is_function).select(F.regexp_replace("fqn", r"[.][^.]*$", "").alias("class"), class_of(F.col("fqn")).alias("name"), "fqn")
    members = calls.where("shape = 'member'")
    received = resolution.by_receiver(members.select("unit", "receiver", "name"), typed.join(single, "simple").select("unit", "receiver", "class"), methods, single.select("class"))
    reached = members.join(typed.join(single, "simple").select("unit", "receiver").distinct(), ["unit", "receiver"], "left_semi")
    plain = calls.where("shape <> 'member'")
    scoped = resolution.by_scope_chain(plain.select("unit", "scope", "name"), names)
    rest = plain.join(scoped, ["unit", "scope", "name"], "left_anti").where("shape = 'bare'").unionByName(members.join(reached, members.columns, "left_anti"))
    unique = resolution.by_unique_name(rest.select("unit", "name"), names.where(is_function).select("fqn", class_of(F.col("fqn")).alias("name")))
    lost = rest.unionByName(plain.where("shape = 'qualified'").join(scoped, ["unit", "scope", "name"], "left_anti")).join(unique, ["unit", "name"], "left_anti")
    targets = received.select("rel", F.col("unit").alias("from"), F.col("fqn").alias("to")).unionByName(scoped.select(F.lit("Calls").alias("rel"), F.col("unit").alias("from"), F.col("fqn").alias("to"))).unionByName(unique.select(F.lit("Calls").alias("rel"), F.col("unit").alias("from"), F.col("fqn").alias("to")))
    targets = targets.join(names.select(F.col("fqn").alias("to"), "kind"), "to").select(F.when(is_struct, "uses").otherwise("calls").alias("type"), "from", "to")
    # Types: by scope, else the only one of that name, else unresolved.
    types = store(found.where("fact = 'type' AND target <> ''").select(F.col("fqn").alias("unit"), F.col("fqn").alias("scope"), dotted(F.col("target")).alias("name")).distinct())
    by_scope = resolution.by_scope_chain(types, names.where(is_struct))
    open_types = types.join(by_scope, ["unit", "scope", "name"], "left_anti")
    by_name = resolution.by_unique_name(open_types.select("unit", "name"), names.where(is_struct).select("fqn", class_of(F.col("fqn")).alias("name")))
    used = by_scope.select("unit", "fqn").unionByName(by_name.select("unit", "fqn")).where("unit <> fqn").distinct()
    lost_types = open_types.join(by_name, ["unit", "name"], "left_anti")
    inside = declared.join(names.where(is_struct).select(F.col("fqn").alias("parent")), "parent", "left_semi").select(F.lit("contains").alias("type"), F.col("parent").alias("from"), F.col("fqn").alias("to"))
    edges = by_id(targets.unionByName(used.select(F.lit("uses").alias("type"), F.col("unit").alias("from"), F.col("fqn").alias("to"))).unionByName(inside))

    def unresolved(df: DataFrame, kind: str) -> DataFrame:
        own = names.select(F.col("fqn").alias("unit"), "id")
        return df.join(own, "unit").select(F.lit(kind).alias("type"), F.col("id").alias("from"), F.col("name").alias("to"))

    lost_edges = unresolved(lost, "unresolved_call").unionByName(unresolved(lost_types, "unresolved_use")).distinct()
    category = category_cpp(F.replace("to", F.lit("."), F.lit("::")))
    modules = found.where("fact = 'file'").select(F.col("module").alias("fqn")).unionByName(found.where("fact = 'namespace'").select("fqn")).distinct()
    nested = found.where("fact = 'namespace'").select(F.lit("contains").alias("type"), F.col("parent").alias("from"), F.col("fqn").alias("to")).distinct()
    params = F.transform(F.split(F.regexp_replace("params", r"<[^<>]*>", ""), ","), lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"=.*|\b(const|struct|class|enum|volatile)\b|[A-Za-z_]\w*\s*$", "")), r"\s+", ""))
    parts = [
        modules.select(F.lit("module").alias("type"), "fqn"),
        found.where("fact = 'file'").select(F.lit("file").alias("type"), "path", F.col("module").alias("parent"), "start_line", "end_line"),
        declared.where(is_struct).select(F.lit("struct").alias("type"), "id", "parent", "name", "path", "start", "end", "start_line", "end_line"),
        declared.where(is_function).select(F.lit("function").alias("type"), "id", "parent", "name", F.filter(params, lambda p: p != "").alias("params"), "path", "start", "end", "start_line", "end_line"),
        lost_edges.select(F.lit("unresolved").alias("type"), F.col("to").alias("fqn"), category.alias("category")).distinct(),
        nested, edges, lost_edges,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    for f in SEQUENCED_SCHEMA:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit("" if f.name in ("file", "target_type") else None).cast(f.dataType))
    return out.withColumn("seq", F.lit(0).cast("long")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SEQUENCED_SCHEMA])
