"""A line client: ``python -m tidemark.client FOLDER`` over a folder of Parquet tables.

    sql SELECT ...;      runs a query         explain SELECT ...;   its plan
    file PATH;           runs a file's query  set mode NAME;        a scan mode (results don't change)
    quit; or exit;
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import SparkSession

from tidemark import report
from tidemark.plans.sqltext import spark_sql
from tidemark.sources.modes import Mode
from tidemark.sources.tables import views


class Client:
    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...] | None = None):
        self.spark, self.mode = spark, Mode.PUSHDOWN_ONLY
        views(spark, folder, *((names,) if names else ()))
        self.names = names

    def sql(self, text: str):
        return self.spark.sql(spark_sql(text))

    def run(self, command: str) -> str | None:
        """The answer to a command without its semicolon; None ends the session."""
        verb, _, rest = command.strip().partition(" ")
        verb, rest = verb.lower(), rest.strip()
        if verb in ("quit", "exit"):
            return None
        if verb == "sql":
            return report.show(self.sql(rest))
        if verb == "explain":
            return report.plan(self.sql(rest))
        if verb == "file":
            with open(rest) as f:
                return report.show(self.sql(f.read().strip().rstrip(";")))
        if verb == "set" and rest.lower().startswith("mode "):
            self.mode = Mode(rest[5:].strip().lower())
            for name in [t.name for t in self.spark.catalog.listTables() if t.isTemporary]:
                keep = self.mode in (Mode.CACHING_ONLY, Mode.HYBRID)
                (self.spark.catalog.cacheTable if keep else self.spark.catalog.uncacheTable)(name)
            return f"mode {self.mode.value}"
        return f"no command {verb!r}"


def commands(stream: TextIO) -> Iterator[str]:
    held = ""
    for line in stream:
        held += line
        while ";" in held:
            one, _, held = held.partition(";")
            if one.strip():
                yield one


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    client = Client(spark, sys.argv[1])
    for command in commands(sys.stdin):
        try:
            answer = client.run(command)
        except Exception as e:  # a wrong query doesn't end the session
            answer = str(e)
        if answer is None:
            break
        print(answer, flush=True)


if __name__ == "__main__":
    main()
