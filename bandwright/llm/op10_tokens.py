"""Token counts: a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their token lengths,
sent to every worker once (a byte blob and an array of lengths). Tier two is a
bounded cache in each Python worker: a pre-token that misses is encoded by the
tokenizer itself, in a batch with the other misses, and remembered. Pre-tokens
are never shuffled, and the tables only save time: with an empty table the
counts are the same.

Byte-pair merges never cross the edge of a pre-token, so a text's count is the
sum over its pre-tokens; a string of an added token counts as one, as the
library does by default. Long texts are read in pieces of about ``PIECE``
characters, cut before a single blank between two words, where a pre-token
always begins. The pre-token pattern is that of byte-level BPE, so a tokenizer
file with a normalizer, another pre-tokenizer or a prefix blank is refused.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
and ties are counted row by row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandwright.llm.store import small_batches

# The pre-token pattern of the public byte-level BPE, with white
# space written out so that every regex library agrees on it.
SPACE = "".join(regex.escape(chr(c), special_only=False) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CACHE_ENTRIES = 200_000
PIECE = 1 << 16
CUT = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 50_000
TABLE_ENTRIES = 50_000


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, if its pre-tokens are those of PATTERN."""
    tokenizer = Tokenizer.from_file(path)
    steps = json.loads(tokenizer.to_str())
    splits = steps["pre_tokenizer"] or {}
    if steps["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    return tokenizer


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where a pre-token does."""
    at = 0
    while len(text) - at > PIECE:
        cut = CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Lengths:
    """Pre-token lengths of one worker: the frequent table, then a cache of bounded size."""

    def __init__(self, path: str, blob: bytes, lengths: np.ndarray, cache_entries: int):
        self.tokenizer = load(path)
        self.find = regex.compile(PATTERN).findall
        added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.frequent = dict(zip(blob.decode().split("\0"), lengths.tolist(), strict=True)) if len(lengths) else {}
        self.known = dict(self.frequent)
        self.most = len(self.frequent) + cache_entries
        self.misses = 0

    def learn(self, found: set[str]) -> None:
        """Adds the lengths of all pre-tokens; a full cache starts again with the frequent ones."""
        missing = [p for p in found if p not in self.known]
        if len(self.known) + len(missing) > self.most:
            self.known = dict(self.frequent)
            missing = [p for p in found if p not in self.known]
        self.misses += len(missing)
        for piece, coded in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self.known[piece] = len(coded)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches of a text between added tokens, and how many of these it has."""
        if self.added is None or not self.added.search(text):
            return [text], 0
        return self.added.split(text), len(self.added.findall(text))

    def count(self, text: str) -> int:
        parts, total = self.parts(text)
        for piece in (p for part in parts for p in pieces(part)):
            found = self.find(piece)
            try:
                total += sum(map(self.known.__getitem__, found))
            except KeyError:
                self.learn(set(found))
                total += sum(map(self.known.__getitem__, found))
        return total


_worker: dict[tuple, Lengths] = {}


def frequent_pretokens(df: DataFrame, text: str, path: str, rows: int, entries: int) -> tuple[bytes, np.ndarray]:
    """The commonest pre-tokens of at most ``rows`` texts of up to SAMPLE_BYTES each, with their lengths.

    A stated, bounded sample, read from as few partitions as hold it: it
    decides which lookups are fast, never a count.
    """
    find = regex.compile(PATTERN).findall
    seen: Counter = Counter()
    for row in df.select(F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).take(rows):
        seen.update(find(row.t))
    commonest = sorted(p for p, _ in seen.most_common(entries) if "\0" not in p and len(p) <= 64)
    coded = load(path).encode_batch(commonest, add_special_tokens=False)
    return "\0".join(commonest).encode(), np.array([len(c.ids) for c in coded], np.uint16)


def token_counts(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    sample_rows: int = SAMPLE_ROWS,
    table_entries: int = TABLE_ENTRIES,
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``tokenizer`` is a file every worker can read."""
    small_batches(df.sparkSession)
    spark = df.sparkSession
    table = frequent_pretokens(df, text, tokenizer, sample_rows, table_entries) if sample_rows else (b"", np.zeros(0, np.uint16))
    sent = spark.sparkContext.broadcast(table)  # at most table_entries pre-tokens of 64 characters

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, sent.id if hasattr(sent, "id") else 0, cache_entries, len(sent.value[0]))
        if key not in _worker:
            _worker.clear()
            _worker[key] = Lengths(tokenizer, *sent.value, cache_entries)
        lengths = _worker[key]
        for batch in batches:
            texts = batch.column(1)
            n = [lengths.count(t) if t else 0 for t in (v.as_py() for v in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
