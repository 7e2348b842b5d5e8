"""Bind variables as named parameters of Spark SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from bandwright.plans import connect, lex
from bandwright.plans.dialect import Dialect
from bandwright.plans.model import Param


def arguments(sql: str, values: dict[str, object], params: tuple[Param, ...] = ()) -> dict[str, object]:
    """A value for every bind of ``sql``: given, else the parameter's default, else None (no filter)."""
    known = {p.name.upper(): p for p in params}
    given = {k.upper(): v for k, v in values.items()}
    out = {}
    for name in lex.binds(sql):
        param = known.get(name)
        value = given.get(name, param.default if param else None)
        if param and param.is_date and isinstance(value, str):
            value = dt.date.fromisoformat(value[:10])
        out[name] = value
    return out


def run(spark: SparkSession, sql: str, values: dict[str, object] | None = None, params: tuple[Param, ...] = (), **options: object) -> DataFrame:
    """A source statement with its binds, as a DataFrame."""
    if connect.is_hierarchy(sql):
        given = {k.upper(): v for k, v in (values or {}).items()}
        return connect.run(spark, sql, Dialect(**options), lambda text: run(spark, text, values, params, **options), lambda name: given.get(name.upper()))
    done = Dialect(**options).query(sql)
    return spark.sql(done, args=arguments(done, values or {}, params))
