"""Filters that reports build at run time, as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def optional(column: Column, op: str, value: object) -> Column:
    """(:P IS NULL OR col op :P): no filter without a value."""
    if value is None:
        return F.lit(True)
    tests = {"=": column == value, "<>": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value, "like": column.like(value) if isinstance(value, str) else None}
    return tests[op]


def text(value: str | None, *columns: Column) -> Column:
    """col LIKE UPPER(TRIM(:P)) on any of the columns."""
    if value is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [c.like(value.strip().upper()) for c in columns])


def number(value: float | None, column: Column) -> Column:
    return F.lit(True) if value is None else column == value


def between(column: Column, low: object, high: object) -> Column:
    """Both binds: a closed range; one bind alone: equality, not an open range."""
    if low is not None and high is not None:
        return (column >= low) & (column <= high)
    if low is None and high is None:
        return F.lit(True)
    return column == (low if low is not None else high)


def effective(start: Column, end: Column, at: object) -> Column:
    """Rows in force at a time; an open end is in force."""
    if at is None:
        return F.lit(True)
    at = F.lit(at)
    return (F.coalesce(start, at) <= at) & (F.coalesce(end, at) >= at)


def branches(*tests: tuple[object, Column]) -> Column:
    """IF branches that each add one bind's predicate: all those whose bind has a value."""
    return reduce(lambda a, b: a & b, [c for value, c in tests if value is not None], F.lit(True))


class OpaqueFragment(ValueError):
    """A built predicate with a part that only the source system knows."""


def fragment(*parts: object, **prompts: object) -> str:
    """A predicate put together from constants and prompts; a None part is one that only the source system knows."""
    out = []
    for part in parts:
        if part is None:
            raise OpaqueFragment("a part of the predicate is not known")
        if isinstance(part, tuple):  # (prompt, text when it has a value, text when it has none)
            name, filled, empty = part
            out.append(filled if prompts.get(name) is not None else empty)
        else:
            out.append(str(part))
    return "".join(out)
