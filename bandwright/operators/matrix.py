"""Matrices, cross products and charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.operators.breaks import aggregate


NULL = "(null)"


def cell_name(value: Sequence[object], label: str = "") -> str:
    """What a cell's column is called: the values of the column fields, and the measure's label where there are several."""
    return "/".join(NULL if v is None else str(v) for v in value) + (f" {label}" if label else "")


def crosstab(df: DataFrame, rows: Sequence[str], columns: Sequence[str], values: Sequence[Sequence[object]], cells: Sequence[tuple[str, str, str]], names: Sequence[str] | None = None, margins: bool = False) -> DataFrame:
    """Rows by nested column fields with one aggregate for each (measure, function, label) of ``cells``.

    ``values`` are the combinations of the column fields' values that there
    are, NULL being a value like another, so the schema is known without a job and
    one aggregation does it all. With margins, each level of the column
    fields but the last has its totals (``A total`` for all columns below A,
    ``row_total`` for all), and a rollup adds the column totals, whose row has
    ``is_total``. A band is an outer key in ``rows``.
    """
    several = len(cells) > 1

    def within(value: Sequence[object]) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, value, strict=False)), F.lit(True))

    out = []
    for k, value in enumerate(values):
        for measure, function, label in cells:
            name = (names[k] + (f" {label}" if several else "")) if names else cell_name(value, label if several else "")
            out.append(aggregate(function, F.when(within(value), F.col(measure))).alias(name))
    if not margins:
        return df.groupBy(*rows).agg(*out)
    for level in range(len(columns) - 1, 0, -1):
        for value in dict.fromkeys(tuple(v[:level]) for v in values):
            out += [aggregate(f, F.when(within(value), F.col(m))).alias(f"{cell_name(value)} total" + (f" {label}" if several else "")) for m, f, label in cells]
    out += [aggregate(f, F.col(m)).alias("row_total" + (f" {label}" if several else "")) for m, f, label in cells]
    last = rows[-1]
    done = df.rollup(*rows).agg(*out, *(F.grouping(r).alias(f"_{r}") for r in rows))
    outer = reduce(lambda a, b: a & b, [F.col(f"_{r}") == 0 for r in rows[:-1]], F.lit(True))
    return done.where(outer).withColumn("is_total", F.col(f"_{last}") == 1).drop(*(f"_{r}" for r in rows))


def matrix(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[object], measure: str, function: str = "sum", names: Sequence[str] | None = None, margins: bool = False) -> DataFrame:
    """Rows by one column field with one aggregate a cell."""
    return crosstab(df, rows, [column], [(v,) for v in values], [(measure, function, "")], names, margins)


def cross_product(df: DataFrame, dimensions: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Every combination of the dimensions' values, with empty cells where no row falls.

    The dimensions are the report's axes: their distinct values, not its rows.
    """
    axes = [df.select(*d).distinct() for d in dimensions]
    grid = reduce(lambda a, b: a.crossJoin(b), axes)
    keys = [c for d in dimensions for c in d]
    cells = df.groupBy(*keys).agg(*aggregates)
    on = [grid[k].eqNullSafe(cells[k]) for k in keys]
    return grid.join(cells, on, "left").select(*(grid[k] for k in keys), *(cells[c] for c in cells.columns if c not in keys))


def chart(df: DataFrame, category: str, value: str, name: str = "value") -> DataFrame | None:
    """The series of a chart, or None if its columns are missing."""
    have = {c.lower() for c in df.columns}
    if category.lower() not in have or value.lower() not in have:
        return None
    return df.groupBy(category).agg(F.sum(value).alias(name))
