"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Tables
from .errors import EngineError, from_spark
from .frontend import ast
from .frontend.binder import Binder, Bound, Context, Query, cast
from .frontend.parser import parse
from .frontend.types import SPARK
from .plans import explain
from .semantics.recipes import DOUBLE_TEXT, literal
from .sources import csv
from .sources.shared import shared_path
from .sources.store import Store


def double_text(x: pd.Series) -> pd.Series:
    """The shortest text that reads back as the same double. Nulls arrive as NaN; the cast around the call keeps them out."""
    return x.map(lambda v: repr(float(v)))


class Engine:
    """Runs statements over one set of tables, kept at ``path`` or, without one, as long as the session.

    Queries are lazy: errors of the statement are raised at once, errors of
    the data when the result is computed. ``exact_sums`` makes sums and averages of
    doubles independent of the order of rows, at the cost of holding each group's values.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, exact_sums: bool = False):
        self.spark, self.exact_sums = spark, exact_sums
        self.tables = Tables(spark, Store(spark, path or shared_path(spark, "tables")))
        spark.udf.register(DOUBLE_TEXT, F.pandas_udf(double_text, "string"))

    def attach(self, name: str, source: DataFrame | str, dates: tuple[str, ...] = ()) -> Engine:
        """Make a DataFrame, or the Parquet files at a path, a table that can be read."""
        self.tables.attach(name, self.spark.read.parquet(source) if isinstance(source, str) else source, dates)
        return self

    def query(self, sql: str) -> DataFrame:
        """The result of a single statement."""
        found = self.query_all(sql)
        if len(found) != 1:
            raise EngineError("Syntax", f"expected one statement but found {len(found)}")
        return found[0]

    def query_all(self, sql: str) -> list[DataFrame]:
        """Results of all statements of a script, run one after the other, up to the first error."""
        return [self._run(s) for s in parse(sql)]

    def bound(self, sql: str) -> Query:
        """The Spark SQL of a SELECT, with its columns' names and types."""
        [statement] = parse(sql)
        return Binder(self.tables, self.exact_sums).query(statement)

    def _run(self, s) -> DataFrame:
        match s:
            case ast.Select():
                return self._select(Binder(self.tables, self.exact_sums).query(s))
            case ast.Explain():
                return self._one("explain_value", "string", self._explain(s))
            case ast.Insert():
                return self._one("Count", "bigint", self._insert(s))
            case ast.Copy():
                t = self._stored(s.table, s.at)
                return self._one("Count", "bigint", self._append(s.table, csv.read(self.spark, s.path, t.columns, s.delimiter, s.header)))
            case ast.CreateTable():
                self._create(s)
            case ast.DropTable():
                self._drop(s)
            case ast.Checkpoint():
                self.tables.store.checkpoint()
        return self.spark.createDataFrame([], "")

    def _select(self, q: Query) -> DataFrame:
        try:
            return self.spark.sql(q.sql).toDF(*q.names)
        except PySparkException as e:
            raise from_spark(e) from e

    def _one(self, name: str, kind: str, value: object) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"`{name}` {kind}")

    def _explain(self, s: ast.Explain) -> str:
        begun = time.perf_counter()
        if not isinstance(s.inner, ast.Select):
            if s.analyze:
                raise EngineError("NotImplemented", "EXPLAIN ANALYZE is only supported for SELECT", s.at)
            if isinstance(s.inner, ast.Insert) and s.inner.query:
                return f"INSERT {s.inner.table}\n" + explain.plan(self._select(Binder(self.tables).query(s.inner.query)))
            return type(s.inner).__name__.upper()
        df = self._select(Binder(self.tables, self.exact_sums).query(s.inner))
        if not s.analyze:
            return explain.plan(df)
        try:
            return explain.measured(df, time.perf_counter() - begun)
        except Exception as e:
            raise from_spark(e) from e

    # -- changes

    def _create(self, s: ast.CreateTable) -> None:
        if self.tables.exists(s.name):
            if s.if_not_exists:
                return
            raise EngineError("Catalog", f'table "{s.name}" already exists', s.at)
        names = [c[0] for c in s.columns]
        if len(set(names)) < len(names):
            raise EngineError("Catalog", "a column name is used twice", s.at)
        self.tables.store.create(s.name, s.columns)

    def _drop(self, s: ast.DropTable) -> None:
        if s.name in self.tables.store.tables:
            self.tables.store.drop(s.name)
        elif s.name in self.tables.attached:
            del self.tables.attached[s.name]
        elif not s.if_exists:
            raise EngineError("Catalog", f'table "{s.name}" does not exist', s.at)

    def _stored(self, name: str, at: int):
        t = self.tables.store.tables.get(name)
        if t is None:
            what = "can only be read" if name in self.tables.attached else "does not exist"
            raise EngineError("Catalog", f'table "{name}" {what}', at)
        return t

    def _insert(self, s: ast.Insert) -> int:
        t, binder = self._stored(s.table, s.at), Binder(self.tables, self.exact_sums)
        kinds = {n: kind for n, kind, _ in t.columns}
        names = s.columns or list(kinds)
        for n in names:
            if n not in kinds:
                raise EngineError("Binder", f'table "{s.table}" has no column "{n}"', s.at)
        if len(set(names)) < len(names):
            raise EngineError("Binder", "a column is named twice", s.at)
        wrong = EngineError("Binder", f"{len(names)} values are needed", s.at)
        if s.query:
            q = binder.query(s.query)
            if len(q.names) != len(names):
                raise wrong
            given = {n: cast(Bound(f"c{i}", None if q.untyped[i] else q.types[i], "column"), kinds[n], s.at).sql for i, n in enumerate(names)}
            source = f"({q.sql}) AS s"
        else:
            rows = []
            for row in s.rows:
                if len(row) != len(names):
                    raise wrong
                rows.append("(" + ", ".join(cast(binder.expr(e, Context([], queries=False)), kinds[n], e.at).sql for e, n in zip(row, names)) + ")")
            given = {n: f"c{i}" for i, n in enumerate(names)}
            source = f"VALUES {', '.join(rows)} AS s({', '.join(given.values())})"
        items = ", ".join(f"{given.get(n, literal(None, kind))} AS `{n}`" for n, kind in kinds.items())
        try:
            return self._append(s.table, self.spark.sql(f"SELECT {items} FROM {source}"))
        except PySparkException as e:
            raise from_spark(e) from e

    def _append(self, name: str, rows: DataFrame) -> int:
        """Check NOT NULL on the way into the files; all rows come in, or none."""
        checked = []
        for n, kind, required in self.tables.store.tables[name].columns:
            c = F.col(f"`{n}`").cast(SPARK[kind])
            if required:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"NOT NULL constraint failed: {name}.{n}")).cast(SPARK[kind])).otherwise(c)
            checked.append(c.alias(n))
        try:
            return self.tables.store.append(name, rows.select(*checked))
        except EngineError:
            raise
        except Exception as e:
            raise from_spark(e) from e

    # -- facts

    def stats(self, name: str) -> DataFrame:
        """Of each column: nulls, estimated distinct values, least and greatest value as text. One pass."""
        df = self.tables.frame(name)
        facts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in df.columns]
        return df.agg(F.array(*facts).alias("x")).select(F.inline("x"))

