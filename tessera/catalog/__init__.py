"""Names of tables, and the views that queries read them by."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..frontend.binder import Relation
from ..frontend.types import SPARK
from ..sources.store import Store

_KINDS = {T.BooleanType: "BOOLEAN", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.StringType: "VARCHAR"}
#: Types that Spark has besides, and what they are read as.
_WIDENED = {T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.FloatType: "DOUBLE", T.DecimalType: "DOUBLE"}
_engines = itertools.count(1)


class Tables:
    """Stored tables, which statements change, and attached ones, which they only read."""

    def __init__(self, spark: SparkSession, store: Store):
        self.spark, self.store = spark, store
        self.prefix = f"tessera_{next(_engines)}"
        self.attached: dict[str, Relation] = {}
        self.views: dict[str, tuple[list[str], Relation]] = {}

    def attach(self, name: str, df: DataFrame, dates: tuple[str, ...] = ()) -> None:
        """Make ``df`` a table. Timestamps named in ``dates`` count as dates; columns of types the dialect lacks are an error, so drop them first."""
        name, out, columns, strange = name.lower(), [], [], []
        if name in self.store.tables:
            raise EngineError("Catalog", f'table "{name}" already exists')
        for f in df.schema.fields:
            kind = _KINDS.get(type(f.dataType)) or _WIDENED.get(type(f.dataType))
            stamp = isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) and f.name in dates
            if not kind and not stamp:
                strange.append(f"{f.name} {f.dataType.simpleString()}")
                continue
            c = df[f.name] if type(f.dataType) in _KINDS else df[f.name].cast("timestamp_ntz" if stamp else SPARK[kind])
            out.append(c.alias(f.name.lower()))
            columns.append((f.name.lower(), kind or "DATE", stamp))
        if strange:
            raise EngineError("Catalog", f'table "{name}" has columns of types that the dialect lacks: {", ".join(strange)}')
        view = f"{self.prefix}_{name}"
        df.select(*out).createOrReplaceTempView(f"`{view}`")
        self.attached[name] = Relation(f"`{view}`", columns)

    def relation(self, name: str) -> Relation | None:
        if name in self.attached:
            return self.attached[name]
        t = self.store.tables.get(name)
        if t is None:
            return None
        known = self.views.get(name)
        if known is None or known[0] != t.parts or [c[:2] for c in t.columns] != [c[:2] for c in known[1].columns]:
            view = f"{self.prefix}_{name}_{self.store.version}"
            self.store.read(name).createOrReplaceTempView(f"`{view}`")
            known = self.views[name] = (t.parts, Relation(f"`{view}`", [(n, kind, False) for n, kind, _ in t.columns]))
        return known[1]

    def names(self) -> list[str]:
        return sorted([*self.attached, *self.store.tables])

    def exists(self, name: str) -> bool:
        return name in self.attached or name in self.store.tables

    def frame(self, name: str) -> DataFrame:
        t = self.relation(name.lower())
        if t is None:
            raise EngineError("Catalog", f'table "{name}" does not exist')
        return self.spark.table(t.view).select(*[(F.col(n).cast("date") if stamp else F.col(n)).alias(n) for n, _, stamp in t.columns])
