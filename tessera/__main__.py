"""A shell: statements end with a semicolon, commands begin with a dot."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import EngineError

HELP = """.tables            names of tables
.schema [TABLE]    columns and types
.stats TABLE       nulls, distinct values, least and greatest value of each column
.read FILE         run a file of statements
.timer on|off      show how long statements take
.maxrows N         rows to show
.threads N         partitions of shuffles
.help              this text
.quit              leave"""


class Shell:
    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out, self.timer, self.rows = engine, out, False, 40

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, sql: str) -> bool:
        """Run statements and show their results; False after an error."""
        begun = time.perf_counter()
        try:
            for df in self.engine.query_all(sql):
                if df.columns:
                    self.show(df)
        except EngineError as e:
            self.say(e.pointed(sql))
            return False
        except Exception as e:
            self.say(f"Execution: {str(e).strip().splitlines()[0]}")
            return False
        if self.timer:
            self.say(f"({time.perf_counter() - begun:.3f} s)")
        return True

    def show(self, df) -> None:
        rows = df.limit(self.rows + 1).collect()
        text = [["NULL" if v is None else repr(v) if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in rows[: self.rows]]
        wide = [max(map(len, c)) for c in zip(df.columns, *text)]
        line = lambda cells: " " + " | ".join(c.ljust(w) for c, w in zip(cells, wide))
        self.say("\n".join([line(df.columns), "-" + "-+-".join("-" * w for w in wide) + "-", *map(line, text)]))
        self.say("..." if len(rows) > self.rows else f"({len(rows)} row{'s' * (len(rows) != 1)})")

    def command(self, line: str) -> bool:
        """Run a dot command; False to leave."""
        name, *args = line.split()
        tables = self.engine.tables
        if name == ".quit":
            return False
        try:
            if name == ".tables":
                self.say("\n".join(tables.names()))
            elif name == ".schema":
                for t in args or tables.names():
                    columns = tables.frame(t).schema.fields
                    self.say(f"{t} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in columns)})")
            elif name == ".stats":
                self.show(self.engine.stats(args[0]))
            elif name == ".read":
                with open(args[0]) as f:
                    self.run(f.read())
            elif name == ".timer":
                self.timer = args[0] == "on"
            elif name == ".maxrows":
                self.rows = int(args[0])
            elif name == ".threads":
                self.engine.spark.conf.set("spark.sql.shuffle.partitions", int(args[0]))
            else:
                self.say(HELP)
        except (IndexError, ValueError, OSError, EngineError) as e:
            self.say(str(e) or HELP)
        return True

    def loop(self, lines) -> None:
        pending = ""
        for line in lines:
            if not pending and line.strip().startswith("."):
                if not self.command(line.strip()):
                    return
                continue
            pending += line
            if pending.rstrip().endswith(";"):
                self.run(pending)
                pending = ""
        if pending.strip():
            self.run(pending)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("-c", help="run these statements")
    parser.add_argument("-f", help="run this file")
    parser.add_argument("--db", help="folder of the tables")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shell = Shell(Engine(spark, given.db))
    if given.c is not None:
        return 0 if shell.run(given.c) else 1
    if given.f is not None:
        with open(given.f) as f:
            return 0 if shell.run(f.read()) else 1
    shell.loop(sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
