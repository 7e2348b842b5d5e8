"""The queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SURROGATE_KEY = "bandwright-1"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op1_surrogates import pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op2_secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op3_language import identify

    return identify(table(spark, sf_dir, "documents"))


def _deduped(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    from bandwright.llm.op4_lines import dedup_lines

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), **options)
    places = F.transform("dropped", lambda d: F.concat_ws(":", d["line"], d["first_id"], d["first_line"]))
    return done.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.array_join(places, ","), F.lit("")).alias("dropped"), "text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit at every length, as the DuckDB SQL of this query has it."""
    from bandwright.llm.op4_lines import MIN_CHARS

    return _deduped(spark, sf_dir, edits=((MIN_CHARS, 1),))


def op4_line_dedup_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of the operator and the pipeline, which grow with the length of a line."""
    return _deduped(spark, sf_dir)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op5_mix import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op6_decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op7_quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op8_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op9_neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bandwright.llm.op10_tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op11_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op12_repeats import without_repeats

    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandwright.llm.op13_resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_secret_scan, op3_language_id, op4_line_dedup, op4_line_dedup_edits, op5_source_mix, op6_decontaminate, op7_quality_rules, op8_html_text, op9_minhash_neardup, op10_token_counts, op11_prefix_trie, op12_repeated_bytes, op13_importance_resample)}


def oracle_sql() -> dict[str, str]:
    from bandwright.llm import sql

    return sql.ORACLES
