"""The output of a scanner process as a Spark data source: format `command_lines`, a row a line of its standard output."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.model import RECORD_SCHEMA
from graphloom.sources.records import validated

LINE_SCHEMA = "seq long, line string"


class CommandFailed(RuntimeError):
    pass


class CommandReader(DataSourceReader):
    """One partition a command: a process is one stream. A process that fails, fails the read, before anything is published."""

    def __init__(self, commands: list[list[str]], cwd: str | None, log: str | None):
        self.commands, self.cwd, self.log = commands, cwd, log

    def partitions(self):
        return [InputPartition(k) for k in range(len(self.commands))]

    def read(self, partition):
        k = partition.value
        log = open(self.log, "ab") if self.log else subprocess.DEVNULL
        run = subprocess.Popen(self.commands[k], cwd=self.cwd, stdout=subprocess.PIPE, stderr=log)
        try:
            for n, line in enumerate(run.stdout):
                yield (k << 40) + n, line.decode("utf-8", "replace").rstrip("\r\n")
            if code := run.wait():
                raise CommandFailed(f"{self.commands[k][0]} ended with {code}")
        finally:
            if run.poll() is None:
                run.kill()
            if self.log:
                log.close()


class CommandSource(DataSource):
    """Options: commands, a JSON list of argument lists; cwd; log, a file for the standard error."""

    @classmethod
    def name(cls):
        return "command_lines"

    def schema(self):
        return LINE_SCHEMA

    def reader(self, schema):
        return CommandReader(json.loads(self.options["commands"]), self.options.get("cwd"), self.options.get("log"))


def command_lines(spark: SparkSession, commands: list[list[str]], cwd: str | None = None, log: str | None = None) -> DataFrame:
    spark.dataSource.register(CommandSource)
    reader = spark.read.format("command_lines").option("commands", json.dumps(commands))
    for key, value in (("cwd", cwd), ("log", log)):
        if value:
            reader = reader.option(key, value)
    return reader.load()


def command_records(spark: SparkSession, commands: list[list[str]], cwd: str | None = None, log: str | None = None) -> DataFrame:
    """Records from the JSON lines that the commands print; a line that is no record fails the read."""
    parsed = command_lines(spark, commands, cwd, log).select("seq", F.from_json("line", RECORD_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    return validated(parsed.select("r.*", "seq"))
