"""Scan a project from end to end: records, graph, cleanup, store, export, report."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.model import CleanupOptions, Graph, IngestOptions
from graphloom.operators.classify import load_config
from graphloom.plans.cypher import query
from graphloom.plans.ingest import Cleanup, Ingest, graph_sizes
from graphloom.sinks import store as sink
from graphloom.sources import cfamily
from graphloom.sources.command import command_records
from graphloom.sources.project import WORKSPACE, Frontends, detect_language, find_or_create_workspace, find_workspace
from graphloom.storage import store


#: Scanners that need no external command.
BUILT_IN = {"cpp": cfamily.records}


@dataclass
class ScanOptions:
    project: str = "."
    language: str | None = None
    excludes: list[str] = field(default_factory=list)
    modules: list[str] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    frontends: Frontends = field(default_factory=Frontends)


def build(records: DataFrame, language: str, blacklist=(), excludes=(), config=None) -> tuple[Graph, DataFrame]:
    """The cleaned graph and its report (metric, n). Fails on an FQN collision."""
    ingest = Ingest(store(records), IngestOptions(language, tuple(blacklist), config))
    ingest.check()
    cleanup = Cleanup(ingest.graph, CleanupOptions(language, tuple(excludes)))
    graph = cleanup.result
    return graph, ingest.report.unionByName(cleanup.report).unionByName(graph_sizes(graph))


def publish(graph: Graph, workspace: str | Path) -> None:
    sink.write_store(graph, f"{workspace}/graph")
    sink.write_jsonl(graph, f"{workspace}/graph.jsonl")


def scan(spark: SparkSession, options: ScanOptions) -> dict[str, int]:
    """Runs the language's scanner on the project and publishes its graph in the workspace; the report as metric -> n."""
    workspace = find_or_create_workspace(options.project)
    available = list(dict.fromkeys([*options.frontends.available(), *BUILT_IN]))
    language = options.language or detect_language(options.project, tuple(available)) or available[0]
    command = options.frontends.command(language)
    if command is None and language not in BUILT_IN:
        raise LookupError(f"no scanner for {language}")
    arguments = [str(Path(options.project).resolve()), *[x for e in options.excludes for x in ("--exclude", e)], *[x for m in options.modules for x in ("--module", m)]]
    if command:
        records = command_records(spark, [[*command, *arguments]], log=str(workspace / "scan.log"))
    else:
        records = BUILT_IN[language](spark, str(Path(options.project).resolve()), options.excludes, options.modules)
    config = load_config(workspace.parent, WORKSPACE)
    graph, report = build(records, language, options.blacklist, options.excludes, config)
    publish(graph, workspace)
    return {r["metric"]: r["n"] for r in report.collect()}


def open_graph(spark: SparkSession, start: str | Path = ".") -> Graph:
    workspace = find_workspace(start)
    if workspace is None:
        raise FileNotFoundError(f"no {WORKSPACE} at or above {start}")
    return sink.read_store(spark, f"{workspace}/graph")


def query_csv(spark: SparkSession, text: str, start: str | Path = "."):
    """A query's result as CSV lines, the header first; rows are fetched one partition at a time."""
    df = query(open_graph(spark, start), text)
    yield sink.csv_header(df)
    for row in sink.csv_lines(df).toLocalIterator():
        yield row["value"]
