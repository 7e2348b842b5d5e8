"""Quality rules: base rules on words, and divergence from language references.

A document is kept unless the base rules fail it or its histogram of character
classes, or of common words, lies farther than a threshold (Jensen-Shannon
distance, base 2) from every language reference. The references are summed
over all documents of a language; a document too short for a stable histogram
is not judged by it (minimum-length guards).

One pass over the texts leaves a thin table of counts and histograms; the
references and the verdicts come from that table alone.

Defined results: a null or empty text has no words and fails the base rules;
rows with a null language take part in no reference but are judged like the
others; repeated rows are judged alike; without any reference only the base
rules decide; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.store import small_batches, written

# Common words of the languages the reference histograms tell apart.
COMMON_WORDS = {
    "en": "the of and to in is that it for as with was on are be this by at from or an not",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas avec ne",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "es": "el que y los se del las por con para su al lo como más o pero sus le ya",
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other ASCII", "beyond ASCII")

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MIN_CHARS_JSD = 200
MIN_WORDS_JSD = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.28


def _classes() -> np.ndarray:
    table = np.full(256, 7, np.uint8)
    for code in range(128):
        c = chr(code)
        table[code] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:!?'\"()-" else 5 if c.encode() in SYMBOLS else 6
    return table


CLASS_OF = _classes()
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
START_BYTE = (np.arange(256) & 0xC0) != 0x80


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return ts.hash_ranges(data, np.concatenate([[0], ends[:-1]]), ends)


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, its words that lie in a window of ``width`` words found twice or more in that text."""
    n = len(hashes)
    owner = ts.spans_of(first)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    keys = ts.mix(ts.hash_ranges(hashes, starts, starts + width) + owner[starts].astype(np.uint64) * np.uint64(ts.BASE))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts[twice], 1)
    np.add.at(step, starts[twice] + width, -1)
    return ts.sum_by(first, np.cumsum(step[:-1]) > 0)


def duplicate_lines(texts: ts.Texts, word_starts: np.ndarray) -> np.ndarray:
    """For each text, its lines that hold a word and equal an earlier line."""
    starts, ends, first = texts.lines()
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    owner = ts.spans_of(first)[worded]
    keys = ts.mix(ts.hash_ranges(texts.data, starts[worded], ends[worded]) + owner.astype(np.uint64) * np.uint64(ts.BASE))
    _, at = np.unique(keys, return_index=True)
    n = np.bincount(owner, minlength=texts.n)
    return n - np.bincount(owner[at], minlength=texts.n)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and histograms of every text of (id, lang, text)."""
    vocabulary = _hash_of(WORDS)
    rank = np.argsort(vocabulary)
    sorted_hashes = vocabulary[rank]
    for batch in batches:
        for a, b, texts in ts.slices(batch.column(2)):
            starts, ends, first = texts.words()
            hashes = ts.hash_ranges(texts.data, starts, ends)
            inside = ~ts.IS_SPACE[texts.data]
            data = texts.data
            bare, _ = ts.bare_hashes(ts.Texts(data, texts.offsets, lower=True))
            at = np.minimum(np.searchsorted(sorted_hashes, bare), len(WORDS) - 1)
            bins = np.where(sorted_hashes[at] == bare, rank[at], len(WORDS))
            owner = ts.spans_of(first)
            width = len(WORDS) + 1
            word_bins = np.bincount(owner * width + bins, minlength=texts.n * width).reshape(texts.n, width)
            symbols = START_BYTE[data]
            byte_owner = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
            char_bins = np.bincount(byte_owner[symbols] * 8 + CLASS_OF[data][symbols], minlength=texts.n * 8).reshape(texts.n, 8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    *(pa.array(x, pa.int64()) for x in (np.diff(first), texts.sums(inside & symbols), texts.sums(IS_SYMBOL[data]), duplicate_lines(texts, starts), repeated_words(hashes, first))),
                    pa.FixedSizeListArray.from_arrays(pa.array(char_bins.ravel(), pa.int32()), 8).cast(pa.list_(pa.int32())),
                    pa.FixedSizeListArray.from_arrays(pa.array(word_bins.ravel(), pa.int32()), width).cast(pa.list_(pa.int32())),
                ],
                ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "commons"],
            )


def references(measured: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Summed histograms by language over all rows; one row for each language comes to the driver."""
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[i].cast("long")) for i in range(n))).alias(name)
    rows = measured.where("lang is not null").groupBy("lang").agg(sums("chars", len(CLASSES)), sums("commons", len(WORDS) + 1)).orderBy("lang").collect()
    return {r["lang"]: (list(r["chars"]), list(r["commons"])) for r in rows}


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.maximum(x, 1e-300) / np.maximum(m, 1e-300)), 0).sum(axis=1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def verdicts(chars: np.ndarray, words: np.ndarray, known: dict[str, tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(character distance, word distance) of each row of histograms from the nearest reference; 0 where too short to judge."""
    refs = [(np.array(c, float), np.array(w, float)) for c, w in known.values()]
    far = [np.min([distance(x, r[i]) for r in refs], axis=0) if refs and len(x) else np.zeros(len(x)) for i, x in ((0, chars), (1, words))]
    far[0][chars.sum(axis=1) < MIN_CHARS_JSD] = 0
    far[1][words.sum(axis=1) < MIN_WORDS_JSD] = 0
    return np.round(far[0], 6), np.round(far[1], 6)


def _histograms(batch: pa.RecordBatch, chars: int, commons: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(batch.column(i).flatten(), float).reshape(batch.num_rows, k) for i, k in ((chars, len(CLASSES)), (commons, len(WORDS) + 1)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(df: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["id"]
    return written(source.mapInArrow(measure, f"id {kind}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, chars array<int>, commons array<int>"), "quality")


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, counts, base_failed, kept, char_distance, word_distance) for every row."""
    measured = _measured(df, id_col, text, lang)
    known = references(measured)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = verdicts(*_histograms(batch, 1, 2), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, far)], ["row", "char_distance", "word_distance"])

    kind = dict(measured.dtypes)["id"]
    shape = f"row struct<id: {kind}, {', '.join(f'{c}: bigint' for c in COUNTS)}>"
    judged = measured.select(F.struct("id", *COUNTS).alias("row"), "chars", "commons").mapInArrow(judge, f"{shape}, char_distance double, word_distance double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return (
        judged.select("row.*", "char_distance", "word_distance")
        .withColumnRenamed("id", id_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("char_distance") <= MAX_CHAR_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE))
        .select(id_col, *COUNTS, "base_failed", "kept", "char_distance", "word_distance")
    )


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, with all their columns.

    The texts are measured again beside their rows, which costs a second scan
    and spares every shuffle of texts and every match by id. Null and empty
    texts go, as the base rules fail them; equal rows stay or go together; the
    columns are those of ``df`` whatever their names; an empty table stays empty.
    """
    known = references(_measured(df.select(F.lit(None).cast("int").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")), "id", "text", "lang"))
    at = df.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.string())
            done = 0
            for part in measure(iter([pa.RecordBatch.from_arrays([nothing, nothing, batch.column(at)], ["id", "lang", "text"])])):
                words, repeated = (np.array(part.column(i)) for i in (2, 6))
                far = verdicts(*_histograms(part, 7, 8), known)
                good = (words >= MIN_WORDS) & (repeated * 100 <= words * MAX_REPEATED_PERCENT) & (far[0] <= MAX_CHAR_DISTANCE) & (far[1] <= MAX_WORD_DISTANCE)
                yield batch.slice(done, part.num_rows).filter(pa.array(good))
                done += part.num_rows

    return df.mapInArrow(keep, df.schema)
