"""Trees and graphs of rows below start rows: paths of any length, with cycles found."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS, HOPS = 3, 32


class Loop(ValueError):
    """A row is its own ancestor, and the query does not say NOCYCLE."""


def _folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def _held(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """One round's rows, computed once, and what frees them: a table in the checkpoint folder where the session has one, else persisted."""
    spark = df.sparkSession
    folder = _folder(spark)
    if not folder:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()  # the rounds before it can go
        return kept, kept.unpersist
    path = f"{folder.rstrip('/')}/bandwright-ways-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def free() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), free


def _kept(df: DataFrame) -> DataFrame:
    return _held(df)[0]


def one_way(table: DataFrame, start: Column, condition: Column, most: int | None = None, root: bool = False, prior: bool = False, leaf: bool = False) -> DataFrame | None:
    """(row, level) and, if asked for, ``root``, ``prior`` and ``is_leaf`` of each row below a start row; None where a row may have several ways.

    In a forest whose start rows have no parent each row has one way, so that
    the way itself is not needed. Each row points to its parent, then to what
    that one points to: n rounds take it 2 ** n rows up, and a round is one join
    of (row, ancestor, distance), however long the ways are. Only the last
    round's table stays. Rows on a cycle, or below one, meet no start row.
    """
    spark, most = table.sparkSession, None if most is None else max(most, 1)  # start rows are found at any rate
    rows, free_rows = _held(table.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")))
    named = rows.select(F.col("id").alias("_cb_id"), "row.*")
    edges, free_edges = _held(named.alias("p").join(named.alias("c"), condition).select(F.col("p._cb_id").alias("parent"), F.col("c._cb_id").alias("id")))
    starts = named.where(start).select(F.col("_cb_id").alias("id"))
    if not edges.groupBy("id").count().where("count > 1").isEmpty() or not starts.join(edges, "id", "left_semi").isEmpty():
        free_rows()
        free_edges()
        return None
    up = rows.select("id").join(edges, "id", "left")
    far, free = _held(up.select("id", F.coalesce("parent", "id").alias("at"), F.col("parent").isNotNull().cast("int").alias("steps"), F.col("parent").isNull().alias("is_top")))
    hops, enough = 1, min(rows.count(), most or 1 << 62)
    while hops < enough and not far.where("NOT is_top").isEmpty():
        further = far.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("is_top").alias("_is_top"))
        moved = far.where("NOT is_top").join(further, "at").select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_is_top").alias("is_top"))
        then, free_then = _held(far.where("is_top").union(moved))
        free()
        far, free, hops = then, free_then, 2 * hops
        further = moved = then = None
        gc.collect()  # lets Spark delete the shuffle files of the rounds before
        spark.sparkContext._jvm.System.gc()
    found = far.where("is_top").join(starts.withColumnRenamed("id", "at"), "at", "left_semi").select("id", "at", (F.col("steps") + 1).alias("level"))
    found = found.where(F.col("level") <= most) if most is not None else found
    out = found.join(rows, "id")
    if leaf:
        below = edges.select(F.col("parent").alias("id")).distinct().withColumn("_has", F.lit(True))
        out = out.join(below, "id", "left").withColumn("is_leaf", (F.col("_has").isNull() | (F.col("level") == (most or 0))).cast("int")).drop("_has")
    if prior:
        above = edges.join(rows.select(F.col("id").alias("parent"), F.col("row").alias("prior")), "parent").drop("parent")
        out = out.join(above, "id", "left")
    if root:
        out = out.join(rows.select(F.col("id").alias("at"), F.col("row").alias("root")), "at")
    return out.drop("id", "at")


def connect_by(table: DataFrame, start: Column, condition: Column, nocycle: bool = False, fields: dict[str, Column] | None = None, most: int | None = None) -> DataFrame:
    """(row, trail) for each row on each way from a start row; ``trail`` has the ``id`` and ``fields`` of each row on the way, the row's own last.

    ``condition`` ties a child ``c`` to its parent ``p`` and should have an
    equality. The edges are joined once. Then the rows of the last level meet
    them, level by level (semi-naive: no row is looked at twice); after ``STEPS`` levels
    the edges are doubled ``HOPS`` times to ways of up to 2 ** HOPS rows, so that
    a chain of n rows takes about n / 2 ** HOPS rounds. Each round is written.
    ``most`` is the largest level.
    """
    fields = fields or {}
    rows = table.select(F.struct("*").alias("row"), F.struct(F.xxhash64("*"), F.xxhash64(F.lit(1), "*")).alias("id"), *(c.alias(f"_f_{n}") for n, c in fields.items()))
    step = F.struct("id", *(F.col(f"_f_{n}").alias(n) for n in fields))
    rows = _kept(rows.select("id", "row", F.array(step).alias("hops")))
    p = rows.select(F.col("id").alias("_cb_id"), "row.*").alias("p")
    c = rows.select(F.struct("id", "hops", "row").alias("_cb"), "row.*").alias("c")
    edges = _kept(p.join(c, condition).select(F.col("p._cb_id").alias("parent"), "c._cb.id", "c._cb.row", "c._cb.hops"))
    level = _kept(rows.select(F.struct("row", F.col("hops").alias("trail")).alias("_cb"), "row.*").where(start).select("_cb.*"))
    found, ways, hops, depth, n = [level], edges, 1, 1, 0
    ids = lambda x: F.transform(x, lambda h: h["id"])
    while not level.isEmpty() and (most is None or depth < most):
        n += 1
        if n > STEPS and hops < HOPS:
            ways, hops, n = _doubled(ways, hops, nocycle), 2 * hops, 1
        last = level.where(F.size("trail") == depth).select("trail", F.element_at("trail", -1)["id"].alias("at"))
        met = last.join(ways, F.col("at") == F.col("parent")).select("row", "trail", "hops")
        again = F.arrays_overlap(ids("trail"), ids("hops"))
        if most is not None:
            met = met.where(F.size("trail") + F.size("hops") <= most)
        if not nocycle:
            met = _kept(met)
            if not met.where(again).isEmpty():
                raise Loop("a row is its own ancestor")
        level = _kept(met.where(~again).select("row", F.concat("trail", "hops").alias("trail")))
        depth += hops
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _doubled(ways: DataFrame, hops: int, nocycle: bool) -> DataFrame:
    """Ways of up to twice ``hops`` rows from those of up to ``hops``; with ``nocycle`` each row once on a way."""
    first = ways.where(F.size("hops") == hops).select("parent", F.col("id").alias("at"), F.col("hops").alias("before"))
    more = first.join(ways.withColumnRenamed("parent", "at"), "at").select("parent", "id", "row", F.concat("before", "hops").alias("hops"))
    if nocycle:
        more = more.where(F.size(F.array_distinct(F.transform("hops", lambda h: h["id"]))) == F.size("hops"))
    return _kept(ways.union(more))


def leaves(walked: DataFrame) -> DataFrame:
    """``walked`` with ``is_leaf``: whether no row was found below on this way."""
    ids = lambda x: F.transform(x, lambda h: h["id"])
    ways = walked.withColumn("_way", ids("trail"))
    above = ways.where(F.size("trail") > 1).select(F.slice("_way", 1, F.size("_way") - 1).alias("_way")).distinct().withColumn("_has", F.lit(True))
    return ways.join(above, "_way", "left").withColumn("is_leaf", F.col("_has").isNull().cast("int")).drop("_way", "_has")


def cycles(walked: DataFrame, table: DataFrame, condition: Column) -> DataFrame:
    """``walked`` with ``is_cycle``: whether the row has a child that is its ancestor or itself."""
    rows = table.select(F.struct(F.xxhash64("*"), F.xxhash64(F.lit(1), "*")).alias("_cb_id"), "*")
    edges = rows.alias("p").join(rows.alias("c"), condition).select(F.col("p._cb_id").alias("at"), F.col("c._cb_id").alias("below"))
    ways = walked.withColumn("_way", F.transform("trail", lambda h: h["id"])).withColumn("at", F.element_at("_way", -1))
    back = ways.join(edges, "at").where(F.array_contains("_way", F.col("below"))).select("_way").distinct().withColumn("_has", F.lit(True))
    return ways.join(back, "_way", "left").withColumn("is_cycle", F.col("_has").isNotNull().cast("int")).drop("_way", "at", "_has")


def siblings(table: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``table`` with the place of each row in the order of siblings, from one range sort."""
    from bandwright.operators.present import numbered

    return numbered(table, order, name)
