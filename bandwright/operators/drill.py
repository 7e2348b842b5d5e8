"""Drill-through: links to other reports, and runs of the linked report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link(report: str, params: dict[str, str]) -> Column:
    """A struct of the target report and the parameters that a click forwards."""
    args = F.create_map(*[x for name, column in sorted(params.items()) for x in (F.lit(name), F.col(column).cast("string"))])
    return F.struct(F.lit(report).alias("report"), args.alias("params"))


def link_text(report: str, params: dict[str, str]) -> Column:
    """The same link as text."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(column).cast("string"), F.lit(""))) for name, column in sorted(params.items())]
    return F.concat(F.lit(f"{report}?"), F.concat_ws("&", *parts))


def filtered(child: DataFrame, forwarded: dict[str, object]) -> DataFrame:
    """The child report for one click: a forwarded P_KEY filters KEY; without a value it filters nothing."""
    names = {c.upper(): c for c in child.columns}
    for name, value in forwarded.items():
        column = names.get(name.upper().removeprefix("P_"))
        if column and value is not None:
            child = child.where(F.col(column) == value)
    return child
