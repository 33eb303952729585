"""Expressions of Spark SQL (text in, text out) with the dialect's semantics.

All stay in the JVM and in generated code, but for the text of a double.
Operands may be repeated in the text; Catalyst computes equal subexpressions once.
"""

from __future__ import annotations

import datetime
import math

from ..frontend.types import BIG_MIN, INT_MIN, SPARK

#: Registered by the engine: the shortest decimal text of a double.
DOUBLE_TEXT = "tessera_double_text"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def q(text: str) -> str:
    """A string literal. A dollar sign is escaped, or Spark would look for a variable."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def literal(value: object, kind: str | None) -> str:
    if kind is None:
        return "NULL"
    if value is None:
        return f"CAST(NULL AS {SPARK[kind]})"
    if kind == "BOOLEAN":
        return str(value).upper()
    if kind == "DATE":
        assert isinstance(value, datetime.date)
        return f"DATE '{value.isoformat()}'"
    if kind == "VARCHAR":
        return q(value)
    if kind == "DOUBLE":
        if not math.isfinite(value):
            return f"double('{value}')"
        return f"{value!r}D" if not str(value).startswith("-") else f"(-{-value!r}D)"
    if value in (INT_MIN, BIG_MIN):
        return f"CAST('{value}' AS {SPARK[kind]})"
    suffix = "L" if kind == "BIGINT" else ""
    return f"{value}{suffix}" if value >= 0 else f"(-{-value}{suffix})"


# -- numbers


def divide(a: str, b: str) -> str:
    """IEEE division of doubles: by zero it gives an infinity or NaN, not an error."""
    return f"(CASE WHEN {b} = 0D THEN {a} * pow({b}, -1D) ELSE {a} / {b} END)"


def modulo_double(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0D THEN {a} * double('NaN') ELSE {a} % {b} END)"


def modulo_integer(a: str, b: str) -> str:
    return f"try_mod({a}, {b})"


def round_double(x: str, digits: str | None) -> str:
    """Half away from zero, by scaling; where scaling overflows the number is returned."""
    if digits is None:
        return f"round({x})"
    up, down = f"pow(10D, {digits})", f"pow(10D, -({digits}))"
    return f"(CASE WHEN {digits} < 0 THEN round({x} / {down}) * {down} WHEN abs({x} * {up}) = double('Infinity') THEN {x} ELSE round({x} * {up}) / {up} END)"


def round_integer(x: str, digits: str, kind: str) -> str:
    scale = f"CAST(pow(10D, -({digits})) AS decimal(38,0))"
    rounded = f"CAST(round(CAST({x} AS decimal(38,0)) / {scale}) * {scale} AS {SPARK[kind]})"
    return f"(CASE WHEN {digits} >= 0 THEN {x} WHEN {digits} < -19 THEN CAST(0 AS {SPARK[kind]}) ELSE {rounded} END)"


def whole(function: str, x: str) -> str:
    """floor or ceil of a double, as a double; beyond 2^53 every double is whole."""
    return f"(CASE WHEN abs({x}) < 9.007199254740992E15D THEN CAST({function}({x}) AS double) ELSE {x} END)"


# -- text


def upper(s: str) -> str:
    return f"translate({s}, '{LOWER}', '{UPPER}')"


def lower(s: str) -> str:
    return f"translate({s}, '{UPPER}', '{LOWER}')"


def like(s: str, pattern: str, constant: str | None = None) -> str:
    """LIKE without an escape character."""
    if constant is not None:
        return f"({s} LIKE {q(constant.replace(chr(92), chr(92) * 2))})"
    return f"({s} LIKE replace({pattern}, {q(chr(92))}, {q(chr(92) * 2)}))"


def substring(s: str, start: str, length: str | None) -> str:
    """Characters from ``start``, 1-based, or from the end if negative; a negative length goes backwards from there."""
    n, at = f"CAST(char_length({s}) AS bigint)", f"CAST({start} AS bigint)"
    begin = f"(CASE WHEN {at} > 0 THEN {at} - 1 WHEN {at} = 0 THEN -1L ELSE greatest({n} + {at}, {at} + {n}) END)"
    if length is None:
        end, first = n, begin
    else:
        size = f"CAST({length} AS bigint)"
        end = f"(CASE WHEN {size} < 0 THEN {begin} ELSE {begin} + {size} END)"
        first = f"(CASE WHEN {size} < 0 THEN {begin} + {size} ELSE {begin} END)"
    low, high = f"CAST(greatest({first}, 0L) AS int)", f"CAST(least({end}, {n}) AS int)"
    given = f"{start} IS NULL" + (f" OR {length} IS NULL" if length is not None else "")
    return f"(CASE WHEN {given} THEN CAST(NULL AS string) ELSE substring({s}, {low} + 1, greatest({high} - {low}, 0)) END)"


# -- dates


def date_in_range(d: str) -> str:
    return f"(CASE WHEN {d} NOT BETWEEN DATE '0001-01-01' AND DATE '9999-12-31' THEN CAST(raise_error('date out of range') AS date) ELSE {d} END)"


def add_days(d: str, n: str) -> str:
    return date_in_range(f"date_add({d}, {n})")


def date_part(part: str, d: str) -> str:
    #: Fields and Spark's function for each; weeks begin with Sunday, 0.
    function = {"year": "year", "month": "month", "day": "day", "quarter": "quarter", "doy": "dayofyear", "dayofyear": "dayofyear", "dow": "dayofweek", "dayofweek": "dayofweek"}[part]
    return f"CAST({function}({d}){' - 1' if function == 'dayofweek' else ''} AS bigint)"


# -- casts


def _trimmed(s: str) -> str:
    return f"regexp_replace({s}, {q(r'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$')}, '')"


def _digits(s: str) -> str:
    return f"regexp_replace({_trimmed(s)}, '(?<=[0-9A-Fa-f])_(?=[0-9A-Fa-f])', '')"


_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _bad(s: str, kind: str) -> str:
    return f"CAST(raise_error(concat('CAST_INVALID_INPUT: could not convert ', {s}, ' to {kind}')) AS {SPARK[kind]})"


def text_to_integer(s: str, kind: str) -> str:
    t, to = _digits(s), SPARK[kind]
    hex_digits = f"CAST(conv(regexp_replace({t}, '^[+-]?0[xX]', ''), 16, 10) AS decimal(20,0))"
    return (
        f"(CASE WHEN {s} IS NULL THEN CAST(NULL AS {to}) WHEN {t} RLIKE '^[+-]?[0-9]+\\u0024' THEN CAST({t} AS {to})"
        f" WHEN {t} RLIKE '^[+-]?0[xX][0-9a-fA-F]{{1,16}}\\u0024' THEN CAST(CASE WHEN {t} LIKE '-%' THEN -{hex_digits} ELSE {hex_digits} END AS {to})"
        f" WHEN {t} RLIKE {q(_REAL)} THEN CAST(round(CAST({t} AS double)) AS {to}) ELSE {_bad(s, kind)} END)"
    )


def text_to_double(s: str) -> str:
    t = _digits(s)
    words = r"(?i)^([+-]?inf(inity)?|nan)$"
    return f"(CASE WHEN {s} IS NULL THEN CAST(NULL AS double) WHEN {t} RLIKE {q(_REAL)} OR {t} RLIKE {q(words)} THEN CAST({t} AS double) WHEN lower({t}) IN ('+nan', '-nan') THEN double('NaN') ELSE {_bad(s, 'DOUBLE')} END)"


def text_to_date(s: str) -> str:
    t = _trimmed(s)
    part = lambda k: f"CAST(split_part({t}, '-', {k}) AS int)"
    return (
        f"(CASE WHEN {s} IS NULL THEN CAST(NULL AS date) WHEN lower({t}) IN ('inf', '+inf', 'infinity', '+infinity') THEN DATE '9999-12-31'"
        f" WHEN lower({t}) IN ('-inf', '-infinity') THEN DATE '0001-01-01'"
        f" WHEN {t} RLIKE '^[0-9]{{1,4}}-[0-9]{{1,2}}-[0-9]{{1,2}}\\u0024' AND {part(1)} > 0 THEN make_date({part(1)}, {part(2)}, {part(3)}) ELSE {_bad(s, 'DATE')} END)"
    )


def cast(x: str, kind: str, target: str) -> str:
    if kind == target:
        return x
    if kind == "VARCHAR":
        if target in ("INTEGER", "BIGINT"):
            return text_to_integer(x, target)
        if target == "DOUBLE":
            return text_to_double(x)
        if target == "DATE":
            return text_to_date(x)
    if kind == "DOUBLE" and target in ("INTEGER", "BIGINT"):
        return f"CAST(rint({x}) AS {SPARK[target]})"  # half to even
    if kind == "DOUBLE" and target == "VARCHAR":
        return f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS string) ELSE {DOUBLE_TEXT}({x}) END)"
    return f"CAST({x} AS {SPARK[target]})"


# -- aggregates


def sum_integer(x: str, kind: str, distinct: bool) -> str:
    """Exact; an error only if the total itself is no BIGINT. Halves of 32 bits are summed apart, so no order of rows overflows."""
    if distinct:
        return f"CAST(sum(DISTINCT CAST({x} AS decimal(38,0))) AS bigint)"
    if kind == "INTEGER":
        return f"sum({x})"
    high, low = f"CAST(sum({x} div 4294967296) AS decimal(38,0))", f"CAST(sum({x} % 4294967296) AS decimal(38,0))"
    return f"CAST({high} * 4294967296 + {low} AS bigint)"


def exact_sum_double(x: str) -> str:
    """Sum of doubles that doesn't depend on the order of rows: error-free transformation over the group's values, which it holds."""
    add = "named_struct('hi', a.hi + v, 'lo', a.lo + (CASE WHEN abs(a.hi) >= abs(v) THEN (a.hi - (a.hi + v)) + v ELSE (v - (a.hi + v)) + a.hi END))"
    total = f"aggregate(array_sort(array_agg({x}), (l, r) -> CASE WHEN abs(l) > abs(r) THEN -1 WHEN abs(l) < abs(r) THEN 1 WHEN l < r THEN -1 WHEN l > r THEN 1 ELSE 0 END), named_struct('hi', 0D, 'lo', 0D), (a, v) -> {add}, a -> CASE WHEN isnan(a.lo) OR abs(a.lo) = double('Infinity') THEN a.hi ELSE a.hi + a.lo END)"
    return f"(CASE WHEN count({x}) = 0 THEN CAST(NULL AS double) ELSE {total} END)"
