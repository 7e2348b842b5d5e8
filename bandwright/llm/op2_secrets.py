"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of a file is a row; its text's SHA-256 is the blob. Only (blob,
rule version) pairs that the ledger lacks are scanned, each once however many
paths and versions hold it, and the findings are joined back to all rows.

A finding is a span of code points, end exclusive, of the whole match. Spark's
regex functions give no positions, so they come from the lengths of the
matches and of the pieces between them. The new ledger rows are written before
they are joined back, so the join can split a blob that very many rows share.

Defined results: a null text is the empty blob and has no findings; repeated
rows each get the findings of their blob; an empty table gives an empty result
and leaves the ledger as it was; other columns are ignored. Rows may share an
id; they are matched to blobs one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.store import written

# Kinds in the order of ties, pattern, group that is measured, its least length.
# The first three are the base rules; the last two are added by this engine.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE_KINDS = 3
RULE_VERSION = "1"
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The spans of one rule as an array in text order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), measured.alias("own"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = (start + F.length(part["hit"])).cast("int")
        found = F.array(F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        keep = F.coalesce(F.length(part["own"]) >= least, F.lit(False))
        return F.struct(F.coalesce(end, state["at"]).alias("at"), F.when(keep, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(FINDINGS).alias("found"))
    return F.when(F.regexp(text, F.lit(pattern)), F.aggregate(parts, first, step)["found"]).otherwise(F.array().cast(FINDINGS))


def scan(df: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """``df`` without the text, with ``findings`` of every row's text."""
    found = [_spans(F.col(text), i, *rule) for i, rule in enumerate(rules)]
    return df.withColumn("findings", F.array_sort(F.concat(*found))).drop(text)


def blob_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger rows (blob, rule_version, findings) that ``versions`` adds to ``ledger``."""
    unseen = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")
    blobs = unseen.groupBy("blob").agg(F.first("text").alias("text"))
    return scan(blobs, "text", rules).select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """(id, blob, findings) for every row, from the ledger."""
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings")
    rows = versions.select(F.col(id_col), blob_of(text).alias("blob"))
    return rows.join(found, "blob", "left").select(id_col, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(df: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts by base kind, a digest of the base spans and all spans."""
    new = written(update_ledger(df, ledger, text), "ledger")
    full = new if ledger is None else ledger.unionByName(new)
    base = F.filter("findings", lambda s: s["rank"] < BASE_KINDS)
    counts = [F.expr(f"cast(size(filter(findings, s -> s.rank = {i})) as bigint)").alias(f"n_{kind}") for i, (kind, *_) in enumerate(RULES[:BASE_KINDS])]
    return findings(df, full, id_col, text).select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
