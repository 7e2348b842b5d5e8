"""Break groups: subtotals at every level, grand totals, shares and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from bandwright.operators.present import fixed, numbered, with_totals

FUNCTIONS = {
    "sum": F.sum,
    "average": F.avg,
    "avg": F.avg,
    "count": F.count,
    "minimum": F.min,
    "min": F.min,
    "maximum": F.max,
    "max": F.max,
    "count distinct": F.count_distinct,
    "stddev": F.stddev_samp,
    "stddevp": F.stddev_pop,
    "variance": F.var_samp,
    "varp": F.var_pop,
    "median": F.median,
}
PERCENT = ("% of total", "% of report", "% of group", "percent", "ratio_to_report")


class UnboundSummary(ValueError):
    """A summary over a column that its dataset lacks."""


def aggregate(function: str, column: Column, order: Column | None = None) -> Column:
    """A summary function over a column; first and last need an order."""
    name = function.lower()
    if name in ("first", "last"):
        if order is None:
            raise ValueError(f"{name} needs an order")
        return (F.min_by if name == "first" else F.max_by)(column, order)
    return FUNCTIONS[name](column)


def levels(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], kind: str = "rollup") -> DataFrame:
    """Subtotals of all levels in one pass, with ``level`` (how many keys are fixed) and ``row_type``.

    One rollup instead of an aggregation for each level. Data that already has
    rollup rows must not come here: totals would count twice.
    """
    grouped = {"rollup": df.rollup, "cube": df.cube}[kind](*keys)
    fixed = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(0))
    out = grouped.agg(*aggregates, fixed.alias("level"))
    kinds = F.when(F.col("level") == 0, "grand total").when(F.col("level") == len(keys), "group").otherwise("subtotal")
    return out.withColumn("row_type", kinds)


def labelled(df: DataFrame, keys: Sequence[str], total: str = "Total") -> DataFrame:
    """A label for each row of ``levels``: the innermost fixed key, or the total's own wording."""
    label = F.lit(total)
    for i, key in enumerate(keys, 1):
        label = F.when(F.col("level") == i, F.concat_ws(" ", F.lit("Subtotal" if i < len(keys) else ""), F.coalesce(F.col(key).cast("string"), F.lit("")))).otherwise(label)
    return df.withColumn("row_label", F.trim(label))


def share(df: DataFrame, value: str, name: str, scope: Sequence[str] = (), places: int = 6) -> DataFrame:
    """Each row's share of its scope's total (of the report without a scope)."""
    if scope:
        totalled = with_totals(df, scope, F.sum(value).alias("_total"))
        return totalled.withColumn(name, F.round((F.col(value) / F.col("_total")).cast("double"), places)).drop("_total")
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round((F.col(value) / F.col("_total")).cast("double"), places)).drop("_total")


COMBINED = {
    "sum": (F.sum, lambda a, b: a + b, lambda a, b: a + b),
    "count": (F.count, lambda a, b: a + b, lambda a, b: a + b),
    "min": (F.min, min, F.least),
    "max": (F.max, max, F.greatest),
}


def running(df: DataFrame, value: str, name: str, order: Sequence[Column | str], reset: Sequence[str] = (), function: str = "sum") -> DataFrame:
    """A running sum, count, min or max that starts again at each reset group, however large a group is.

    A prefix scan: one range sort by group and order; a window over each
    partition's part of a group; and for the group that a partition begins in,
    what the partitions before it have of that group. Of these there is one row
    a partition, so they are put together by the driver and broadcast.
    """
    made, combine, joined = COMBINED[function]
    keys = list(reset)
    ordered = fixed(df.orderBy(*keys, *order))
    inner = Window.partitionBy("_p", *keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(F.lit(0).alias("_"), *keys)
    parts = ordered.groupBy("_p", *keys).agg(made(value).alias("_t"), F.min("_i").alias("_f"), F.max("_i").alias("_l"))
    edges = parts.groupBy("_p").agg(F.min_by(key, "_f").alias("first"), F.max_by(key, "_l").alias("last"), F.max_by("_t", "_l").alias("_t")).orderBy("_p")
    carried, open_key, so_far = [], None, None
    for e in edges.collect():  # a row for each partition
        before = so_far if open_key == e.first else None
        if before is not None:
            carried.append((e["_p"], e.first, before))
        whole = e.first == e.last and before is not None
        so_far = combine(before, e["_t"]) if whole and e["_t"] is not None else before if whole else e["_t"]
        open_key = e.last
    kinds = edges.schema
    carry = df.sparkSession.createDataFrame(carried, StructType([StructField("_cp", kinds["_p"].dataType), StructField("_ck", kinds["first"].dataType), StructField("_cv", kinds["_t"].dataType)]))
    out = ordered.withColumn(name, made(value).over(inner))
    out = out.join(F.broadcast(carry), (F.col("_p") == F.col("_cp")) & key.eqNullSafe(F.col("_ck")), "left")
    total = F.coalesce(joined(F.col(name), F.col("_cv")), F.col(name), F.col("_cv"))
    return out.withColumn(name, total).drop("_p", "_i", "_cp", "_ck", "_cv")


def print_once(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], suffix: str = "_shown") -> DataFrame:
    """Break columns that show only on the first row of their group.

    Rows are numbered once; a group's first number is an aggregation, so a
    group of any size is dealt over tasks.
    """
    df = numbered(df, order, "_no")
    for i, column in enumerate(columns):
        df = with_totals(df, columns[: i + 1], F.min("_no").alias("_first"))
        df = df.withColumn(column + suffix, F.when(F.col("_no") == F.col("_first"), F.col(column))).drop("_first")
    return df.drop("_no")


def folded(df: DataFrame, keys: Sequence[str], leaves: Sequence[str], name: str) -> DataFrame:
    """One row a group with its leaf rows in order as an array of structs."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*leaves))).alias(name))


def percent(df: DataFrame, source: str, keys: Sequence[str], scope: Sequence[str], name: str) -> DataFrame:
    """Each group's sum as a share of its scope's (of the report without a scope); ``scope`` is the first of ``keys``."""
    by = df.groupBy(*keys).agg(F.sum(source).alias("_v"))
    return share(by, "_v", name, scope).drop("_v")


def brought(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the values that ``totals`` has for its group, NULL keys being a group too; one row of them goes to all."""
    if not keys:
        return df.crossJoin(F.broadcast(totals))
    names = {k.lower() for k in keys}
    named = totals.select(*(F.col(c).alias(f"_g_{c.lower()}") if c.lower() in names else F.col(c) for c in totals.columns))
    return df.join(named, [df[k].eqNullSafe(F.col(f"_g_{k.lower()}")) for k in keys], "left").drop(*(f"_g_{k.lower()}" for k in keys))


def summary(df: DataFrame, function: str, source: str, keys: Sequence[str], name: str, order: Column | None = None) -> DataFrame:
    """One declared summary at its level."""
    if source.lower() not in {c.lower() for c in df.columns}:
        raise UnboundSummary(f"summary {name}: no column {source}")
    value = aggregate(function, F.col(source), order).alias(name)
    return df.groupBy(*keys).agg(value) if keys else df.agg(value)
