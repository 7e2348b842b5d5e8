"""Tables behind a report's SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.plans import lex
from bandwright.plans.model import Item


def register(spark: SparkSession, folder: str, names: Iterable[str], format: str = "parquet") -> None:
    """Views over files; columns and filters reach the scans."""
    for name in names:
        spark.read.format(format).load(f"{folder}/{name}.{format}").createOrReplaceTempView(name)


def wanted(sql: str) -> list[str]:
    """Names of the tables that a statement reads."""
    flat = lex.tokens(lex.statement(sql))
    with_names = {flat[i].upper for i in range(len(flat) - 2) if flat[i].kind == "word" and flat[i + 1].upper == "AS" and flat[i + 2].text == "("}
    out: list[str] = []
    for i, t in enumerate(flat):
        follows = i and (flat[i - 1].upper in ("FROM", "JOIN") or flat[i - 1].text == "," and _in_from(flat, i))
        if follows and t.kind == "word" and t.upper not in ("DUAL", "LATERAL") and t.upper not in with_names:
            out.append(t.text)
    return list(dict.fromkeys(out))


def _in_from(flat: list, i: int) -> bool:
    depth = 0
    for t in reversed(flat[:i]):
        if t.text == ")":
            depth += 1
        elif t.text == "(":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t.kind == "word" and t.upper in ("SELECT", "WHERE", "BY", "HAVING", "ON"):
            return False
        elif depth == 0 and t.upper == "FROM":
            return True
    return False


def stub(spark: SparkSession, name: str, columns: Iterable[str]) -> DataFrame:
    """An empty table with the columns that a statement refers to, so that its report has a shape."""
    df = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df.createOrReplaceTempView(name)
    return df


def empty_as_null(df: DataFrame) -> DataFrame:
    """Empty texts as NULL, as the source system stores them."""
    return df.withColumns({f.name: F.nullif(F.col(f.name), F.lit("")) for f in df.schema if isinstance(f.dataType, T.StringType)})


def declared(df: DataFrame, items: Iterable[Item]) -> DataFrame:
    """The declared items in their order, matched by name, in their types and with their labels."""
    names = {c.upper(): c for c in df.columns}
    missing = [i.name for i in items if i.name.upper() not in names]
    if missing:
        raise ValueError(f"declared but not selected: {missing}")
    return df.select(*(F.col(names[i.name.upper()]).try_cast(i.spark_type).alias(i.name, metadata={"label": i.label}) for i in items))


def synthetic(spark: SparkSession, items: Iterable[Item], n: int) -> DataFrame:
    """n rows whose values follow from the column's name and the row, equal across datasets so that links meet."""
    def value(i: Item):
        row = F.col("id")
        if i.kind == "number":
            return (row + F.lit(sum(map(ord, i.name.upper())) % 7)).cast(i.spark_type)
        if i.kind == "date":
            return (F.expr("timestamp_ntz'2001-01-01 00:00:00'") + F.make_dt_interval(row.cast("int"))).cast("timestamp_ntz")
        return F.concat(F.lit(f"{i.name.upper()} "), row.cast("string"))

    return spark.range(n).select(*(value(i).alias(i.name) for i in items))
