"""code_type of nodes: a project's rules, or the built-in ones of its language."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import any_of, file_name, glob, has_segment, simple_name

#: Fixed values. language -> (code type, file name ends, file name begins, path segments), in order of precedence.
BUILTIN = {
    "go": (
        ("test", ("_test.go",), (), ("test", "tests")),
        ("generated", (".pb.go",), (), ("gen", "generated")),
        ("external", (), (), ("vendor",)),
    ),
    "java": (
        ("test", ("test.java", "tests.java"), (), ("test", "tests")),
        ("generated", (), (), ("gen", "generated")),
        ("external", (), (), ("vendor", "third_party", "thirdparty")),
    ),
    "cpp": (
        ("test", ("_test.cpp", "_test.cc", "_test.c"), ("test_",), ("test", "tests")),
        ("generated", (".pb.cc", ".pb.h"), (), ("gen", "generated")),
        ("external", (), (), ("vendor", "third_party", "thirdparty", "external")),
    ),
    "rust": (
        ("test", ("_test.rs",), (), ("test", "tests")),
        ("generated", (), (), ("gen", "generated")),
        ("external", (), (), ("vendor",)),
    ),
}
DEFAULT = "src"


@dataclass
class Rule:
    name: str
    globs: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


@dataclass
class Config:
    default: str = DEFAULT
    types: list[Rule] = field(default_factory=list)


def load_config(project: str | Path, folder: str, places: tuple[str, ...] = ("config.json",)) -> Config | None:
    """The first of folder/places (or plain project files) that is readable and well formed; None if there is none."""
    root = Path(project)
    for place in (*(root / folder / p for p in places), root / (folder.strip(".") + ".json")):
        try:
            raw = json.loads(place.read_text())
            return Config(raw.get("default", DEFAULT), [Rule(r["name"], r.get("globs", []), r.get("names", [])) for r in raw.get("types", [])])
        except (OSError, ValueError, KeyError, AttributeError, TypeError):
            continue
    return None


def builtin_code_type(path: Column, language: str) -> Column:
    name, out = file_name(path), F.lit(DEFAULT)
    for kind, ends, begins, segments in reversed(BUILTIN.get(language, ())):
        tests = [name.endswith(e) for e in ends] + [name.startswith(b) for b in begins] + [has_segment(path, segments)]
        out = F.when(any_of(tests), F.lit(kind)).otherwise(out)
    return out


def code_type(path: Column, fqn: Column, language: str, config: Config | None = None) -> Column:
    """A config replaces the built-in rules: its first rule with a glob for the path, or one for the simple name or FQN, else its default."""
    if config is None:
        return builtin_code_type(path, language)
    out = F.lit(config.default)
    for rule in reversed(config.types):
        tests = [glob(path, g) for g in rule.globs] + [t for n in rule.names for t in (glob(simple_name(fqn), n), glob(fqn, n))]
        out = F.when(any_of(tests), F.lit(rule.name)).otherwise(out)
    return out
