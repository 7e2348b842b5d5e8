"""Datasets without SQL: rows of XML, delimited or JSON files, with the columns that the definition declares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bandwright.plans.model import Dataset
from bandwright.sources import tables


def read(spark: SparkSession, dataset: Dataset, path: str, kind: str, row_tag: str = "row", separator: str = ",", header: bool = True) -> DataFrame:
    """The rows of files behind a dataset, by Spark's own readers: they split large files and reach any store.

    The schema is that of the declared items, so files are never read to guess
    it; names are matched without case, what a file lacks is NULL, and what does
    not fit its declared type is NULL as well.
    """
    if not dataset.items:
        raise ValueError(f"{dataset.name}: declares no columns")
    text = T.StructType([T.StructField(i.name, T.StringType()) for i in dataset.items])
    reader = spark.read.schema(text)
    if kind == "xml":
        rows = reader.format("xml").option("rowTag", row_tag).option("ignoreSurroundingSpaces", True).load(path)
    elif kind in ("csv", "text"):
        rows = reader.option("sep", separator).option("header", header).option("enforceSchema", not header).csv(path)
    elif kind == "json":
        rows = reader.json(path)
    else:
        raise ValueError(f"{dataset.name}: no reader for {kind}")
    return tables.declared(rows, dataset.items)
