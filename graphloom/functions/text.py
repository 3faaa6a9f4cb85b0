"""Scalar functions on paths and names, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def like_pattern(glob: str) -> str:
    escaped = "".join("\\" + c if c in "%_\\" else c for c in glob)
    return escaped.replace("*", "%").replace("?", "_")


def star_pattern(glob: str) -> str:
    """A regular expression for the texts that hold a literal star: a star of the glob that meets one is that star and nothing
    else; one that meets any other character, or the end, is any run."""
    parts = {"*": r"(?:\*|(?!\*).*?)", "?": "."}
    return r"(?s)\A" + "".join(parts.get(c) or (c if c.isalnum() else f"\\x{{{ord(c):x}}}") for c in glob) + r"\z"


def glob(column: Column, pattern: str) -> Column:
    """Whole-text match; `*` is any run, `?` one character. LIKE does it, but for texts that hold a star themselves."""
    return F.when(F.instr(column, "*") == 0, column.like(like_pattern(pattern))).otherwise(column.rlike(star_pattern(pattern)))


def path_glob(column: Column, pattern: str) -> Column:
    """glob() for file paths, JVM only: a star in a path is taken for any other character."""
    return column.like(like_pattern(pattern))


def prefixed(column: Column, prefixes) -> Column:
    """Starts with one of prefixes, as plain text without segment bounds."""
    return any_of([column.startswith(p) for p in prefixes])


def without_parts(path: Column, excludes) -> Column:
    """A scanner's excludes: none of these texts is anywhere in the path."""
    return ~any_of([F.contains(path, F.lit(e)) for e in excludes])


def below_any(path: Column, folders) -> Column:
    """A scanner's restriction to module folders: the path lies below one of them. No folders: no restriction."""
    return any_of([path.startswith(f.rstrip("/") + "/") for f in folders]) if folders else F.lit(True)


def basename(column: Column) -> Column:
    trimmed = F.regexp_replace(column, "/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.when((trimmed == "") | last.isin("..", "."), column).otherwise(last)


def simple_name(column: Column) -> Column:
    return F.element_at(F.split(column, "[.]"), -1)


def parent_of(column: Column) -> Column:
    return F.regexp_replace(column, r"\.?[^.]*$", "")


def clean_fqn(column: Column) -> Column:
    kept = F.regexp_replace(column, '[,\r\n"]', "")
    return F.regexp_replace(F.regexp_replace(kept, r"\.{2,}", "."), r"^\.+|\.+$", "")


def dotted(column: Column) -> Column:
    return F.replace(column, F.lit("::"), F.lit("."))


def has_segment(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def csv_field(column: Column) -> Column:
    """Quoted only around a comma, a quote or a line feed; null is empty."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)


def truncated(text: Column, most: int = 64) -> Column:
    """Texts of more than `most` bytes are cut at a character's bound and get an ellipsis."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, most), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("…"))).otherwise(text)


def joined_params(params: Column) -> Column:
    return F.array_join(params, ",")


# Categories of targets outside the project. What each language's standard names begin with.
JAVA_STANDARD = ("java.", "javax.", "jdk.", "com.sun.", "sun.")
RUST_STANDARD = ("std", "core", "alloc", "proc_macro", "test")


def category_go(package: Column) -> Column:
    """No package: builtin. A dot in the first path segment is a host's: external."""
    return F.when(package.isNull() | (package == ""), "builtin").when(F.element_at(F.split(package, "/"), 1).contains("."), "external").otherwise("stdlib")


def category_java(owner: Column) -> Column:
    return F.when(prefixed(owner, JAVA_STANDARD), "stdlib").otherwise("external")


def category_cpp(name: Column) -> Column:
    """Qualified names are external, bare ones unknown."""
    return F.when(name.contains("::"), "external").otherwise("unknown")


def category_rust(crate: Column) -> Column:
    return F.when(crate.isin(*RUST_STANDARD), "stdlib").otherwise("external")
