"""What EXPLAIN and EXPLAIN ANALYZE show."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame


def plan(df: DataFrame) -> str:
    """The optimized logical plan, with Catalyst's estimates, and the physical plan."""
    mode = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost")
    return df._jdf.queryExecution().explainString(mode)


@dataclass
class Operator:
    """A physical operator that ran: its place in the plan, Catalyst's estimate of its rows, the rows it had, and its other metrics."""

    name: str
    depth: int
    estimated: int | None
    rows: int | None
    metrics: dict[str, int]


def operators(df: DataFrame) -> tuple[list[Operator], int]:
    """Run ``df``; its operators from the result down, and the number of rows of the result."""
    execution = df._jdf.queryExecution()
    rows = execution.executedPlan().execute().count()
    return _operators(execution.executedPlan(), 0), rows


def measured(df: DataFrame, planning: float) -> str:
    """Run ``df`` and show its physical operators with estimated and actual rows, build sides' rows and the times that they had."""
    begun = time.perf_counter()
    found, rows = operators(df)
    took = time.perf_counter() - begun
    lines = []
    for o in found:
        facts = [f"estimated rows: {o.estimated}"] * (o.estimated is not None) + [f"{n}: {v}" for n, v in sorted(o.metrics.items())]
        if o.name == "BroadcastExchange" and o.rows is not None:
            facts.append(f"build rows: {o.rows}")
        lines.append("  " * o.depth + o.name + (f" ({', '.join(facts)})" if facts else ""))
    return "\n".join([*lines, f"result rows: {rows}", f"planning: {planning * 1000:.1f} ms", f"execution: {took * 1000:.1f} ms"])


def _estimate(node) -> int | None:
    """Rows of the logical operator that ``node`` carries out: its row count, or its size by the width of a row."""
    link = node.logicalLink()
    if link.isEmpty():
        return None
    stats = link.get().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    width, out = 8, link.get().output().iterator()
    while out.hasNext():
        width += out.next().dataType().defaultSize()
    return int(str(stats.sizeInBytes())) // width


def _operators(node, depth: int) -> list[Operator]:
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _operators(node.executedPlan(), depth)
    if name.endswith("QueryStage"):
        return _operators(node.plan(), depth)
    found = {}
    metrics = node.metrics().iterator()
    while metrics.hasNext():
        entry = metrics.next()
        value = entry._2().value()
        if value > 0:
            found[entry._2().name().get() if entry._2().name().isDefined() else entry._1()] = value
    inner = name.startswith(("WholeStageCodegen", "InputAdapter"))
    own = [] if inner else [Operator(name, depth, _estimate(node), found.get("number of output rows"), found)]
    children = node.children().iterator()
    while children.hasNext():
        own += _operators(children.next(), depth + bool(own))
    return own
