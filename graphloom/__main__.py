"""Command line: python -m graphloom scan | query | init."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="Program graphs on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="scan a project and publish its graph in its workspace")
    scan.add_argument("project", nargs="?", default=".")
    scan.add_argument("--language")
    scan.add_argument("--exclude", action="append", default=[], metavar="GLOB")
    scan.add_argument("--module", action="append", default=[], metavar="FOLDER")
    scan.add_argument("--blacklist", action="append", default=[], metavar="PREFIX")
    scan.add_argument("--frontends", action="append", default=[], metavar="FOLDER", help="where scanner commands lie")
    query = commands.add_parser("query", help="run a pattern query and print CSV")
    query.add_argument("text")
    query.add_argument("--project", default=".", help="a folder in the project")
    commands.add_parser("init", help="make a workspace with a default config").add_argument("project", nargs="?", default=".")
    return top


def main(arguments: list[str] | None = None) -> int:
    options = parser().parse_args(arguments)
    from graphloom.sources import project

    if options.command == "init":
        print(project.init(options.project))
        return 0
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from graphloom.operators.identity import FqnCollision
    from graphloom.plans import scan as plan

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        if options.command == "scan":
            report = plan.scan(spark, plan.ScanOptions(options.project, options.language, options.exclude, options.module, options.blacklist, project.Frontends(options.frontends)))
            for metric, n in sorted(report.items()):
                print(f"{metric}: {n}")
        else:
            for line in plan.query_csv(spark, options.text, options.project):
                print(line)
    except (FqnCollision, LookupError, OSError, ValueError, PySparkException) as error:
        print(f"graphloom: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
