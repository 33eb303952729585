"""The dialect's functions for the DataFrame API: each takes column names and gives a Column.

``apply(recipes.divide, "a", "b")`` is IEEE division of two double columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..semantics import recipes


def apply(recipe: Callable[..., str], *columns: str, **options) -> Column:
    return F.expr(recipe(*[f"`{c}`" for c in columns], **options))


def divide(a: str, b: str) -> Column:
    return apply(recipes.divide, a, b)


def substring(s: str, start: int, length: int | None = None) -> Column:
    return F.expr(recipes.substring(f"`{s}`", f"{start}L", None if length is None else f"{length}L"))


def round_half_away(x: str, digits: int = 0) -> Column:
    return F.expr(recipes.round_double(f"`{x}`", f"{digits}L"))


def cast(x: str, kind: str, target: str) -> Column:
    """``x`` of the dialect's type ``kind`` as ``target``; text of doubles needs an Engine in the session."""
    return apply(recipes.cast, x, kind=kind, target=target)


def exact_sum(x: str) -> Column:
    """A sum of doubles that doesn't depend on the order of rows; it holds the group's values."""
    return apply(recipes.exact_sum_double, x)
