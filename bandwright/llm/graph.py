"""Connected components over links that stay distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.store import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of a link; label is the smallest node of its component.

    Each round turns neighbourhoods into stars around their smallest node; the
    rounds end when the links no longer change (logarithmic in the longest
    path in practice). Links are written after each round, never collected; so
    are the smallest neighbours, which makes both sides of each join a plain
    shuffle: a hub of very many links can be split among tasks.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = written(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()
        before = state
        both = edges.union(edges.select("v", "u"))
        nearest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "nearest")
        large = written(both.join(nearest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        nearest = written(large.groupBy("u").agg(F.min("v").alias("m")), "nearest")
        moved = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(nearest).distinct(), "links")
