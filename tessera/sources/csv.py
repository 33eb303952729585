"""CSV records as typed rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..semantics import recipes as r


#: Stands for a quoted empty field while records are read.
_EMPTY = "\x00\x01"


def read(spark: SparkSession, path: str, columns: list[tuple[str, str, bool]], delimiter: str, header: bool) -> DataFrame:
    """Records as rows of ``columns``.

    An empty field without quotes is NULL, as is a quoted one unless the
    column is text. Fields convert as casts do. One delimiter may follow the last
    field. Another number of fields, or a field that doesn't convert, is an error.
    """
    n = len(columns)
    names = [f"f{i}" for i in range(n)]
    schema = ", ".join(f"{c} string" for c in [*names, "_extra", "_record"])
    reader = spark.read.schema(schema).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
    reader = reader.option("emptyValue", _EMPTY).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
    raw = reader.csv(path)
    # a record that doesn't have exactly one field more than there are columns comes with its text, whose fields are counted
    bare = F.regexp_replace("_record", '"([^"]|"")*"', "q")
    fields = F.when(F.col("_record").isNull(), n + 1).otherwise(F.char_length(bare) - F.char_length(F.regexp_replace(bare, re.escape(delimiter), "")) + 1)
    right = (fields == n) | ((fields == n + 1) & F.col("_extra").isNull())
    message = F.concat(F.lit(f"expected {n} fields but found "), fields.cast("string"))
    out = []
    for f, (name, kind, _) in zip(names, columns):
        text = f"replace({f}, {r.q(_EMPTY)}, '')" if kind == "VARCHAR" else f"nullif({f}, {r.q(_EMPTY)})"
        value = F.expr(r.cast(text, "VARCHAR", kind))
        out.append(F.when(right, value).otherwise(F.raise_error(message)).cast(r.SPARK[kind]).alias(name))
    return raw.select(*out)
