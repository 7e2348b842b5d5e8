"""Benchmark decontamination: BM25 search of test items with block-max WAND.

The test items are cut into parts of at most ``PART_WORDS`` words, the units
of an inverted index whose impacts are BM25 weights divided by the part's own
score, so a score is the share of the part that a passage covers. The parts are
in blocks, and each term has its largest impact in each block.

Every passage of every text (windows of ``PASSAGE_WORDS`` words, each half
overlapping the next) is a query that retrieves all parts scoring at least
``THRESHOLD``. The block-max bounds, sums of the terms' largest impacts in a
block, are computed for all passages and blocks of a batch at once; a block
that reaches the threshold is searched by WAND, with its own largest impacts as
the terms' bounds. A retrieved part is then verified: half of the five-word shingles of its question (its leading words)
and half of the three-word shingles of its answer (its last quarter, five
words at least) must be found around the passage.

Items too short to score, of fewer than ``MIN_ITEM_WORDS`` words, are found by
their whole word sequence: anywhere in the text if it has ``MIN_RUN_WORDS`` or
more, else as the whole text, for a word or two stand in any prose.

The index is flat arrays, about ten bytes for a byte of item text. It is sent
to the workers only up to a measured size (``INDEX_BYTES`` of item text); a
larger benchmark is split by item into several indexes that the rows pass one
after the other.

Defined results: a null or empty text is clean; items without a text or a word
prove no leak; ids of items may be of any type, and items without one count as
one item of null id; repeated rows are judged alike; an empty benchmark leaves
all clean; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.store import small_batches

PART_WORDS = 64
PASSAGE_WORDS = 128
MIN_ITEM_WORDS = 8
MIN_RUN_WORDS = 3
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
ANSWER_SHINGLE = 3
ANSWER_WORDS = 5
K1, B = 1.2, 0.75
GRID_BLOCKS = 64
INDEX_BYTES = 8 << 20
SLICE_BYTES = 1 << 18


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of a word sequence; of the whole sequence if it is shorter."""
    starts = np.arange(max(1, len(words) - width + 1))
    return np.unique(ts.hash_ranges(words, starts, np.minimum(starts + width, len(words))))


class Index:
    """The inverted index of some items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items: list[object] = []
        self.short: dict[int, dict[int, list[object]]] = {}  # items by words, then by hash of the sequence
        parts: list[np.ndarray] = []
        for item, text in sorted(items, key=lambda x: (str(x[0]), x[1])):
            words = ts.bare_words([text])[0]
            if 0 < len(words) < MIN_ITEM_WORDS:
                self.short.setdefault(len(words), {}).setdefault(int(ts.hash_ranges(words, np.array([0]), np.array([len(words)]))[0]), []).append(item)
            if len(words) < MIN_ITEM_WORDS:
                continue
            n = -(-len(words) // PART_WORDS)
            for part in np.array_split(words, n):
                self.items.append(item)
                parts.append(part)
        cuts = [max(0, len(p) - max(ANSWER_WORDS, len(p) // 4)) for p in parts]
        self.questions = [shingle_set(p[:c], SHINGLE) if c else shingle_set(p, SHINGLE) for p, c in zip(parts, cuts, strict=True)]
        self.answers = [shingle_set(p[c:], ANSWER_SHINGLE) for p, c in zip(parts, cuts, strict=True)]
        self.terms, self.n = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), max(1, len(parts))
        sizes = np.array([len(p) for p in parts], np.int64)
        at = np.repeat(np.arange(len(parts)), sizes)
        #: postings by term, then part: term * n + part, and the share of the part's score
        self.postings, tf = np.unique(np.searchsorted(self.terms, np.concatenate(parts)) * self.n + at, return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0))
        term, part = self.postings // self.n, self.postings % self.n
        held = np.bincount(term, minlength=len(self.terms))
        idf = np.log1p((len(parts) - held + 0.5) / (held + 0.5))
        length = sizes[part] / sizes.mean() if parts else np.zeros(0)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        self.shares = impact / np.bincount(part, impact, minlength=self.n)[part]
        self.starts = np.linspace(0, len(parts), min(GRID_BLOCKS, len(parts)) + 1).astype(int)
        #: the largest share of each term in each block that holds it, by term, then block
        self.blocks = max(1, len(self.starts) - 1)
        self.cells, first = np.unique(term * self.blocks + np.searchsorted(self.starts, part, "right") - 1, return_index=True)
        self.largest = np.maximum.reduceat(self.shares, first) if len(first) else np.zeros(0)
        self.first_cell = np.searchsorted(self.cells, np.arange(len(self.terms) + 1) * self.blocks)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def bounds(self, terms: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """rows x blocks: the sum of the largest shares of each row's terms; no part of the block scores more."""
        low, n = self.first_cell[terms], np.diff(self.first_cell)[terms]
        cell = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        flat = np.repeat(row, n) * self.blocks + self.cells[cell] % self.blocks
        return np.bincount(flat, self.largest[cell], minlength=rows * self.blocks).reshape(rows, self.blocks)

    def search(self, terms: np.ndarray, block: int, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (part, score) of one block of parts that score at least the threshold, by WAND over distinct terms."""
        first, end = int(self.starts[block]), int(self.starts[block + 1])
        bound = threshold - 1e-6
        low, high = (np.searchsorted(self.postings, terms * self.n + x) for x in (first, end))
        lists = []  # next part, its place, parts, shares, largest share
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if a < b:
                parts, shares = (self.postings[a:b] % self.n).tolist(), self.shares[a:b].tolist()
                lists.append([parts[0], 0, parts, shares, max(shares)])
        found = []
        while True:
            lists.sort(key=itemgetter(0))
            total, pivot = 0.0, -1
            for i, c in enumerate(lists):
                total += c[4]
                if total >= bound:
                    pivot = i
                    break
            if pivot < 0:
                return found
            part = lists[pivot][0]
            if lists[0][0] == part:
                score = sum(c[3][c[1]] for c in lists if c[0] == part)
                if score >= bound:
                    found.append((part, score))
                part += 1
            for c in lists:
                if c[0] >= part:
                    break
                while c[1] < len(c[2]) and c[2][c[1]] < part:
                    c[1] += 1
                c[0] = c[2][c[1]] if c[1] < len(c[2]) else end
            lists = [c for c in lists if c[0] < end]

    def short_leaks(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, object, float]]:
        """(text, item, 1.0) of the short items that stand in some texts."""
        found = []
        owner = ts.spans_of(first)
        for n, known in self.short.items():
            starts = np.arange(max(0, len(words) - n + 1))
            starts = starts[owner[starts] == owner[starts + n - 1]]
            if n < MIN_RUN_WORDS:
                starts = starts[(np.diff(first) == n)[owner[starts]]]
            hashes = ts.hash_ranges(words, starts, starts + n)
            for i in np.flatnonzero(np.isin(hashes, np.fromiter(known, np.uint64, len(known)))):
                found += [(int(owner[starts[i]]), item, 1.0) for item in known[int(hashes[i])]]
        return found

    def leaks(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, object, float]]:
        """(text, item, score) of every verified leak of a longer item in some texts, given all their words."""
        half = PASSAGE_WORDS // 2
        terms = self.lookup(words)
        at = np.flatnonzero(terms >= 0)
        owner = ts.spans_of(first)[at]
        window = (at - first[owner]) // half
        base = np.concatenate([[0], np.cumsum(np.diff(first) // half + 2)])
        passage = base[owner] + window
        keys = np.concatenate([passage, passage[window > 0] - 1]) * np.int64(len(self.terms) + 1) + np.concatenate([terms[at], terms[at][window > 0]])
        keys = np.unique(keys)
        passages, distinct = keys // (len(self.terms) + 1), keys % (len(self.terms) + 1)
        if not len(keys):
            return []
        begin = np.flatnonzero(np.concatenate([[True], passages[1:] != passages[:-1]]))
        stop = np.append(begin[1:], len(keys))
        bounds = self.bounds(distinct, np.repeat(np.arange(len(begin)), stop - begin), len(begin))
        found = []
        for row, block in zip(*(x.tolist() for x in np.nonzero(bounds >= THRESHOLD - 1e-4)), strict=True):
            p = int(passages[begin[row]])
            hits = self.search(distinct[begin[row] : stop[row]], block)
            if not hits:
                continue
            text = int(np.searchsorted(base, p, "right")) - 1
            start = int(first[text]) + (p - int(base[text])) * half
            around = runs_of(words[max(int(first[text]), start - half) : min(int(first[text + 1]), start + PASSAGE_WORDS + half)])
            for part, score in hits:
                if self.covered(self.questions[part], around) and self.covered(self.answers[part], around):
                    found.append((text, self.items[part], score))
        return found

    @staticmethod
    def covered(wanted: np.ndarray, around: np.ndarray) -> bool:
        return bool(np.isin(wanted, around).mean() >= OVERLAP)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of one to SHINGLE words."""
    starts = np.arange(len(words))
    return np.concatenate([ts.hash_ranges(words, starts[: max(0, len(words) - n + 1)], starts[: max(0, len(words) - n + 1)] + n) for n in range(1, SHINGLE + 1)])


def with_hits(df: DataFrame, benchmark: DataFrame, hits: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``df`` and a last column ``hits``: (item, best score) of every leak, by item; whole numbers as bigint, other ids as text."""
    small_batches(df.sparkSession)
    whole = dict(benchmark.dtypes)[item_id] in ("tinyint", "smallint", "int", "bigint")
    kind, arrow = ("bigint", pa.int64()) if whole else ("string", pa.string())
    items = benchmark.select(F.col(item_id).cast(kind).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // index_bytes))
    hit = pa.list_(pa.struct([("item", arrow), ("score", pa.float64())]))
    at = df.columns.index(text)
    found = df.withColumn(hits, F.array().cast(f"array<struct<item: {kind}, score: double>>"))
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
        sent = df.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in part.toLocalIterator()]))  # about index_bytes of texts

        def search(batches: Iterator[pa.RecordBatch], sent: object = sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for a, b, texts in ts.slices(batch.column(at), lower=True, size=SLICE_BYTES):
                    rows = batch.slice(a, b - a)
                    words, first = ts.bare_hashes(texts, ts.TRIMMED_SYMBOLS, 6)
                    leaks = [{h["item"]: h["score"] for h in row} for row in rows.column(rows.num_columns - 1).to_pylist()]
                    for t, item, score in (*index.leaks(words, first), *index.short_leaks(words, first)):
                        leaks[t][item] = max(round(score, 6), leaks[t].get(item, 0.0))
                    ordered = ([{"item": i, "score": x[i]} for i in sorted(x, key=lambda i: (i is not None, i if i is not None else 0))] for x in leaks)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(list(ordered), hit)], rows.schema.names)

        found = found.mapInArrow(search, found.schema)
    return found


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """(id, contaminated, n_items, items, best_score) for every row; items are the leaked item ids in order, null first."""
    found = with_hits(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), benchmark, "hits", "text", **options)
    ids = F.transform("hits", lambda h: h["item"])
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0))
    return found.select(F.col("id").alias(id_col), (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), ids.alias("items"), best.alias("best_score"))


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The rows of ``df`` without a leak, with all their columns, whatever their names.

    Null and empty texts stay; equal rows stay or go together; an empty table
    stays empty and an empty benchmark removes nothing.
    """
    hits = "hits" + "_" * max(len(c) for c in df.columns)
    return with_hits(df, benchmark, hits, text, **options).where(F.size(hits) == 0).drop(hits)
