"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (1 to 4 bytes, ASCII
letters lower-cased) that both hold, over a vocabulary, divided by the
geometric mean of their own numbers: a blended-spectrum presence kernel.
The vocabulary is what the landmarks hold. The landmarks give Nystroem
features, and a one-versus-rest kernel ridge regression on them gives a score
for each language. Texts are scored in batches: presence matrix times landmark
matrix, normalised, times the coefficients.

The model is fitted on a bounded sample of labelled rows (``per_language``
rows a language, at most ``max_rows``, texts of at most ``max_chars``), chosen
by a hash of the id and sent to all workers. Scoring reads whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a text without a known n-gram gets the first language with score 0.5; ties go
to the first language by code point; without labelled rows every row is
``und``; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.store import small_batches

SPECTRUM = 4
PER_LANGUAGE = 200
LANDMARKS_PER_LANGUAGE = 32
MAX_ROWS = 8_000
MAX_LANDMARKS = 512
MAX_CHARS = 20_000
RIDGE = 1e-3
SLOT_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: ts.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, gram) of every n-gram of each length inside one text; a gram is its bytes and its length in one integer."""
    data = texts.data.astype(np.uint64)
    owner = np.repeat(np.arange(texts.n, dtype=np.int32), np.diff(texts.offsets))
    value = np.zeros(len(data), np.uint64)
    for n in range(1, SPECTRUM + 1):
        size = len(data) - n + 1
        if size <= 0:
            return
        value = (value[:size] << np.uint64(8)) | data[n - 1 :]
        inside = owner[:size] == owner[n - 1 :]
        tagged = value | np.uint64(n << 32)
        yield (owner[:size], tagged) if inside.all() else (owner[:size][inside], tagged[inside])


@dataclass
class Vocabulary:
    """n-grams with one slot each of a hash table; a gram whose slot is taken is left out."""

    keys: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Vocabulary:
        _, first = np.unique(cls.slot(keys), return_index=True)
        keys = keys[np.sort(first)]
        slots = np.full(1 << SLOT_BITS, -1, np.int32)
        slots[cls.slot(keys)] = np.arange(len(keys), dtype=np.int32)
        return cls(keys, slots)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def presence(self, texts: ts.Texts) -> np.ndarray:
        """texts x vocabulary, 1 where the text holds the gram."""
        out = np.zeros((texts.n, len(self.keys)), np.float32)
        for owner, keys in grams(texts):
            at = self.slots[self.slot(keys)]
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.keys[at[hit]] == keys[hit]]
            out[owner[hit], at[hit]] = 1
        return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    landmarks: np.ndarray  # presence, landmarks x vocabulary
    coefficients: np.ndarray  # landmarks x languages, Nystroem map included

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        own = np.sqrt(presence.sum(axis=1, keepdims=True))
        return presence @ self.landmarks.T / np.maximum(own, 1) / np.sqrt(self.landmarks.sum(axis=1))[None, :]

    def scores(self, texts: ts.Texts) -> np.ndarray:
        return self.kernel(self.vocabulary.presence(texts)) @ self.coefficients


def _texts(values: list[str]) -> ts.Texts:
    raw = [v.encode() for v in values]
    return ts.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), lower=True)


def fit(labelled: list[tuple[str, str]], per_language: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """A model from (language, text) pairs; the first of each language become landmarks."""
    labelled = [(lang, text) for lang, text in labelled if text]
    if not labelled:
        return None
    languages = sorted({lang for lang, _ in labelled})
    per_language = max(1, min(per_language, MAX_LANDMARKS // len(languages)))
    taken = dict.fromkeys(languages, 0)
    marks = []
    for lang, text in labelled:
        if taken[lang] < per_language:
            taken[lang] += 1
            marks.append(text)
    vocabulary = Vocabulary.of(np.unique(np.concatenate([keys for _, keys in grams(_texts(marks))])))
    landmarks = vocabulary.presence(_texts(marks))
    model = Model(languages, vocabulary, landmarks, np.zeros((len(marks), len(languages)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(landmarks).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([model.kernel(vocabulary.presence(_texts([t for _, t in labelled[i : i + 200]]))) for i in range(0, len(labelled), 200)]) @ root
    wanted = np.where(np.array([lang for lang, _ in labelled])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    ridge = np.linalg.solve(features.T @ features + RIDGE * len(labelled) * np.eye(features.shape[1]), features.T @ wanted)
    model.coefficients = (root @ ridge).astype(np.float32)
    return model


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(df: DataFrame, id_col: str, text: str, lang: str, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows outside the held-out fold, in the order of a hash of the id."""
    labelled = df.where(~held_out(id_col) & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max_rows).collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, max_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_language / n))])
    draw = (F.xxhash64(F.col(id_col)) % 1_000_003 + 1_000_003) % 1_000_003
    chosen = labelled.where((draw < F.try_element_at(share, F.col(lang)) * 1_000_003) & (F.octet_length(text) <= max_chars))
    rows = chosen.select(draw.alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text")).orderBy("draw", "lang", "text").limit(2 * max_rows).collect()
    taken = dict.fromkeys(counts, 0)
    out = []
    for row in rows:
        if taken[row.lang] < per_language:
            taken[row.lang] += 1
            out.append((row.lang, row.text))
    return out


def identify(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row."""
    small_batches(df.sparkSession)
    model = fit(sample(df, id_col, text, lang))
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.regexp(F.col(text), F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANDMARKS x the grams of as many texts of MAX_CHARS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = np.array(known.languages, dtype=object)
        for batch in batches:
            for a, b, texts in ts.slices(batch.column(1), lower=True, size=ts.SLICE_BYTES // 2):
                scores = known.scores(texts)
                best = scores.argmax(axis=1)
                lettered = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                score = np.clip((scores[np.arange(texts.n), best].astype(float) + 1) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.where(lettered, names[best], "und"), pa.string()), pa.array(np.where(lettered, np.round(score, 6), 0.0))], ["id", "lang_pred", "score"]
                )

    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(score, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
