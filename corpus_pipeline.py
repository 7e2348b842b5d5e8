"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept, as they were written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandwright.llm.op4_lines import without_repeats
from bandwright.llm.op5_mix import mixed
from bandwright.llm.op6_decontaminate import remove_contaminated
from bandwright.llm.op7_quality import keep_good
from bandwright.llm.op9_neardup import one_of_each
from bandwright.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier go, and documents that lose all their lines."""
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document."""
    return mixed(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix)]

#: Edit joins, sketches and index search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
