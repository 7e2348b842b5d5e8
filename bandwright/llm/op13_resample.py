"""Importance resampling of documents towards a target text, with a head-tail vocabulary.

A text's words are runs of ASCII digits, letters (lower-cased) and all bytes
beyond ASCII; its features are all words and all pairs of neighbouring words.
A feature's bucket is the CRC-32 of its bytes modulo ``buckets``. The gain of a
bucket is the log ratio of how often the target and the documents fill it; a
document's weight is the mean gain of its features, and the draw is the largest
weights after Gumbel noise from a hash of the id, which is a draw without
replacement and comes out the same on every run.

The head of the vocabulary is broadcast: the CRC states of frequent words (of
up to 16 bytes, compared whole) and the buckets of frequent pairs of these. A
feature of the tail takes its CRC directly, a pair from the state of its first
word on. Which words are in the head decides speed only, never a bucket, so the
head comes from a bounded sample (``SAMPLE_ROWS`` texts of up to
``SAMPLE_BYTES``); bucket totals are exact counts over all texts. Two scans of
the texts, in pieces of about half a MB whatever a text's length; one row for
each bucket and task is shuffled, and thin rows for the ranks.

Defined results: a null or empty text, or one without a word, has no features
and weight 0; rows that share an id are each judged and ranked on their own
(by features and weight where scores tie); a null id is hashed as an empty one
and ranks first among equals; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.order import numbered
from bandwright.llm.store import small_batches

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SAMPLE_ROWS = 1_000
SAMPLE_BYTES = 20_000
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 16
SLOT_BITS = 18
LONG_FEATURE = 64

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD = rb"[0-9a-z\x80-\xff]+"
FULL = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each range of bytes, on from ``states`` (CRCs of what stands before) if given."""
    crc = np.zeros(len(starts), np.uint32) if states is None else states.copy()
    size = ends - starts
    for i in np.flatnonzero(size > LONG_FEATURE):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]], int(crc[i]))
    order = np.flatnonzero(size <= LONG_FEATURE)
    order = order[np.argsort(-size[order], kind="stable")]
    size, at, state = size[order], starts[order], crc[order] ^ FULL
    left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # ranges that have a jth byte
    for j, n in enumerate(left):
        s = state[:n]
        state[:n] = CRC[(s ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    crc[order] = state ^ FULL
    return crc


def _slot(key: np.ndarray) -> np.ndarray:
    return (ts.mix(key) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Head:
    """Tables of 2 ** SLOT_BITS places: words by their 16 bytes with their CRC states, pairs by word numbers with their buckets."""

    low: np.ndarray
    high: np.ndarray
    number: np.ndarray
    state: np.ndarray
    pair: np.ndarray
    bucket: np.ndarray


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range of up to 16 bytes as two integers; longer ones give both as zero, which no word is."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))
    size = ends - starts
    keep = lambda n: ~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - n.astype(np.uint64)))
    fits = size <= 16
    low = np.where(fits, eight[starts] & keep(np.minimum(size, 8).clip(1)), np.uint64(0))
    high = np.where(fits & (size > 8), eight[starts + 8 * (size > 8)] & keep((size - 8).clip(1, 8)), np.uint64(0))
    return low, high


def head_of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> Head:
    """The head's tables; of words or pairs that want one place the first has it."""
    n = 1 << SLOT_BITS
    head = Head(np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int64), np.zeros(n, np.uint32), np.full(n, -1, np.int64), np.zeros(n, np.int64))
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    low, high = packed(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
    number = {}
    for i, slot in enumerate(_slot(low ^ ts.mix(high)).tolist()):
        if head.number[slot] < 0:
            head.low[slot], head.high[slot], head.number[slot], head.state[slot] = low[i], high[i], i, zlib.crc32(words[i])
            number[words[i]] = i
    known = [(a, b) for a, b in pairs if a in number and b in number]
    keys = np.array([number[a] * HEAD_WORDS + number[b] for a, b in known], np.int64)
    for key, slot, (a, b) in zip(keys.tolist(), _slot(keys.view(np.uint64)).tolist(), known, strict=True):
        if head.pair[slot] < 0:
            head.pair[slot], head.bucket[slot] = key, zlib.crc32(a + b" " + b) % buckets
    return head


def sampled_head(df: DataFrame, text: str, rows: int, buckets: int) -> Head:
    """The head from the commonest words and pairs of at most ``rows`` texts of up to SAMPLE_BYTES each."""
    import re

    find = re.compile(WORD).findall
    words: Counter = Counter()
    pairs: Counter = Counter()
    for row in df.select(F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLE_BYTES).take(rows) if rows else []:
        found = find(row.t.encode().lower())
        words.update(found)
        pairs.update(zip(found, found[1:], strict=False))
    commonest = [w for w, _ in words.most_common(HEAD_WORDS) if len(w) <= 16]
    return head_of(commonest, [p for p, n in pairs.most_common(HEAD_PAIRS) if n > 1], buckets)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each pair that ends at a word that ``follows`` the one before)."""
    low, high = packed(data, starts, ends)
    slot = _slot(low ^ ts.mix(high))
    known = (low != 0) & (head.number[slot] >= 0) & (head.low[slot] == low) & (head.high[slot] == high)
    number = np.where(known, head.number[slot], -1)
    crc = np.where(known, head.state[slot], np.uint32(0))
    tail = np.flatnonzero(~known)
    crc[tail] = crc_of(data, starts[tail], ends[tail])
    second = np.flatnonzero(follows)
    first = second - 1
    key = number[first] * HEAD_WORDS + number[second]
    both = (number[first] >= 0) & (number[second] >= 0)
    slot = _slot(np.where(both, key, 0).view(np.uint64))
    known = both & (head.pair[slot] == key)
    pair = np.where(known, head.bucket[slot], 0)
    tail = np.flatnonzero(~known)
    before = crc[first[tail]] ^ FULL
    before = CRC[(before ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (before >> np.uint32(8)) ^ FULL
    pair[tail] = crc_of(data, starts[second[tail]], ends[second[tail]], before).astype(np.int64) % buckets
    return crc.astype(np.int64) % buckets, pair


def pieces(column: pa.Array, size: int = ts.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, its start and end, whether it follows a word, bytes) in pieces of about ``size`` bytes.

    A text longer than a piece goes on in the next one, which begins with the
    last word again for its pair; that word's own row is then -1.
    """
    for row, _, texts in ts.slices(column, lower=True, size=size):
        if len(texts.data) <= 2 * size:
            yield _words(texts.data, texts.offsets, row)
            continue
        data, at, last = texts.data, 0, -1  # one long text
        while at < len(data):
            end = min(at + size, len(data))
            while end < len(data) and IN_WORD[data[end]]:
                stop = np.flatnonzero(~IN_WORD[data[end : end + size]])
                end = end + int(stop[0]) if len(stop) else min(end + size, len(data))
            begin = at if last < 0 else last
            owner, starts, ends, follows, part = _words(data[begin:end], np.array([0, end - begin]), row)
            if last >= 0:
                owner[0] = -1
            if len(starts):
                last = begin + int(starts[-1])
            at = end
            yield owner, starts, ends, follows, part


def _words(data: np.ndarray, offsets: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1 + row
    follows = np.zeros(len(starts), bool)
    follows[1:] = owner[1:] == owner[:-1]
    return owner, starts, ends, follows, data


def bucket_totals(df: DataFrame, text: str, head, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket has; ``head`` is broadcast."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for owner, starts, ends, follows, data in pieces(batch.column(0)):
                word, pair = features(data, starts, ends, follows, head.value, buckets)
                total += np.bincount(word[owner >= 0], minlength=buckets) + np.bincount(pair, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = df.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def gains(target: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's share, one added to each count; rounded down."""
    t, s, n = target.astype(float), documents.astype(float), float(len(target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``df``."""
    spark = df.sparkSession
    small_batches(spark)
    head = spark.sparkContext.broadcast(sampled_head(df, text, sample_rows, buckets))  # tables of fixed size
    gain = spark.sparkContext.broadcast(gains(bucket_totals(target, target_text, head, buckets), bucket_totals(df, text, head, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, starts, ends, follows, data in pieces(batch.column(1)):
                word, pair = features(data, starts, ends, follows, head.value, buckets)
                real, second = owner >= 0, owner[follows]
                np.add.at(words, owner[real], 1)
                np.add.at(total, owner[real], gain.value[word[real]])
                np.add.at(n, second, 1)
                np.add.at(total, second, gain.value[pair])
            n += words
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["id", "n_words", "n_features", "weight"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(weigh, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    seed: int = 7,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` is null for rows that are not drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weighed(df, target, id_col, text, target_text, buckets, sample_rows).withColumn("score", (F.col("weight") + noise).cast("long"))
    order = [F.col("enough").desc(), F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("n_features"), F.col("weight")]
    placed = numbered(scored.withColumn("enough", F.col("n_words") >= min_words), order, "place")
    drawn = placed.where("enough").count() * percent // 100
    rank = F.when(F.col("enough") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select(id_col, "n_features", "weight", "score", rank.cast("long").alias("rank"))
