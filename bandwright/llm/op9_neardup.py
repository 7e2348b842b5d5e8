"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates. In round i < t every shingle is hashed into one
coordinate with a value between i and i + 1; in round t + i it goes to
coordinate i. A coordinate keeps the smallest value it got, and a text leaves
the rounds when all its coordinates are filled, so every coordinate fills and
equal coordinates estimate the Jaccard similarity with concentration bounds.

Texts with the same word sequence form a class and are sketched once. Classes
that share a band are candidates. They are verified on their full shingle sets
in two steps that together cover every candidate pair but those that one
component already holds: each class against the most central class of each of
its buckets (the one whose buckets are largest in sum); then, in buckets that
still hold several components, every class outside the largest of them against
all classes of other components. The second step uses that a shingle held by at
most RARE of those sets is rare: two sets that would overlap enough without
their rare shingles are compared, and so are two that share rare shingles and
could overlap enough with these; no other pair can be linked. So a group of n near copies costs about n comparisons and
not n * n, and no link between components is lost. With 32 bands of 5, a pair at 0.8 is no candidate
with probability 3e-6.

Defined results: a text without words has an empty set, its own component and
is kept; a null id belongs to its text's class but names no component unless
the class has no other; repeated rows share their component; rows that share
an id are kept or not by the id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.graph import components
from bandwright.llm.store import small_batches, written

BANDS = 32
ROWS = 5
PERCENT = 80
RARE = 32
BROADCAST_IDS = 500_000
FULL = np.uint64(ts.MASK)


def shingles(texts: ts.Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (owner, hash), sorted by owner and hash; and two hashes of each word sequence."""
    starts, ends, first = texts.words()
    words = ts.hash_ranges(texts.data, starts, ends)
    keys = [ts.hash_ranges(w, first[:-1], first[1:]) for w in (words, ts.mix(words + np.uint64(ts.BASE)))]
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(1, count - width + 1))
    owner = np.repeat(np.arange(texts.n), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    hashes = ts.hash_ranges(words, at, np.minimum(at + width, first[1:][owner]))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint16 if texts.n < 65536 else np.int64), kind="stable")]
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new], keys[0], keys[1]


def sketch(owner: np.ndarray, hashes: np.ndarray, n: int, t: int) -> np.ndarray:
    """The n x t sketches of distinct (owner, hash); rows of owners without shingles stay full of ones."""
    out = np.full(n * t, FULL)
    live = np.bincount(owner, minlength=n) > 0
    for i in range(2 * t):
        x = ts.mix(hashes + np.uint64((i + 1) * ts.BASE & ts.MASK))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, np.uint64(i << 40) | (x & np.uint64((1 << 40) - 1)))
        rows = np.flatnonzero(live)
        done = rows[(out.reshape(n, t)[rows] != FULL).all(axis=1)]
        if len(done):
            live[done] = False
            stay = live[owner]
            owner, hashes = owner[stay], hashes[stay]
        if not len(owner):
            break
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    keys = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(ts.BASE)
    for r in range(rows):
        keys = ts.mix(keys + sketches.reshape(len(sketches), bands, rows)[:, :, r])
    return keys.astype(np.int64)


def _key_array(a: np.ndarray, b: np.ndarray, empty: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(np.stack([a, b], axis=1)).view(np.uint8).tobytes()
    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(data)]).cast(pa.binary())
    return pa.array(keys.to_pylist(), pa.binary(), mask=empty) if empty.any() else keys


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    ``percent`` is the least 100 * intersection / union of a link. The ids of
    candidates are broadcast only when counted and at most ``broadcast_ids``;
    beyond that they are joined by a shuffle.
    """
    small_batches(df.sparkSession)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in ts.slices(batch.column(1), lower=True):
                owner, hashes, k0, k1 = shingles(texts, width)
                n = np.bincount(owner, minlength=texts.n)
                keys = band_keys(sketch(owner, hashes, texts.n, bands * rows), bands, rows)
                lists = _lists(np.repeat(np.arange(texts.n), bands), keys.ravel(), texts.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _key_array(k0, k1, n == 0), pa.array(n), lists], ["id", "key", "n", "bands"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ts.slices(batch.column(1), lower=True):
                owner, hashes, k0, k1 = shingles(texts, width)
                empty = np.bincount(owner, minlength=texts.n) == 0
                yield pa.RecordBatch.from_arrays([_key_array(k0, k1, empty), _lists(owner, hashes, texts.n)], ["key", "shingles"])

    source = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["id"]
    docs = written(source.mapInArrow(sketched, f"id {kind}, key binary, n long, bands array<long>"), "sketches")
    classes = written(docs.where("key is not null").groupBy("key").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("key", "n", F.explode("bands").alias("h"))
    sizes = banded.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(sizes, "h"), "members")
    central = members.groupBy("key").agg(F.sum("size").alias("score"))
    hubs = members.join(central, "key").groupBy("h").agg(F.max(F.struct("score", "key", "n")).alias("hub"))

    wanted = members.select("key").distinct().join(classes, "key").select(F.col("doc").alias("wanted"))
    wanted = written(wanted.distinct(), "wanted")
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    sets = source.join(wanted, source.id.eqNullSafe(F.col("wanted")), "left_semi").mapInArrow(with_sets, "key binary, shingles array<long>")
    sets = written(sets.where("key is not null").dropDuplicates(["key"]), "sets")

    close = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
        return shared.where(f"100 * shared >= {percent} * (total - shared)").select("a", "b")

    tried = written(members.join(hubs, "h").where(close("n", "hub.n")).where("key <> hub.key").select(F.col("key").alias("a"), F.col("hub.key").alias("b")).distinct(), "tried")
    first = written(verified(tried), "first")
    def split_buckets(links: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components, with the bucket's largest one."""
        labels = components(links, "a", "b").select(F.col("node").alias("key"), "label")
        labelled = members.select("h", "key", "n").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        labelled = written(labelled, "labelled")
        most = labelled.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
        return labelled.join(most.where("labels > 1").select("h", F.col("most.label").alias("most")), "h")

    mixed = written(split_buckets(first), "mixed")
    spread = sets.join(mixed.select("key", "n", "label").distinct(), "key").select("key", "n", "label", F.explode("shingles").alias("g"))
    spread = written(spread, "spread")
    few = spread.groupBy("g").agg(F.count("*").alias("c")).where(f"c <= {RARE}").select("g", "c")
    rare = written(spread.join(few, "g"), "rare")
    counts = rare.groupBy("key").agg(F.count("*").alias("rare"), F.count_if(F.expr("c > 1")).alias("shared"))
    mixed = mixed.join(counts, "key", "left").withColumn("common", F.expr("n - coalesce(rare, 0)"))
    mixed = written(mixed.join(classes.select("key", "bands"), "key"), "mixed")
    need = lambda most: F.expr(f"{100 + percent} * ({most}) >= {percent} * (an + bn)")
    named = lambda df, x, *cols: df.select(*cols, *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in cols)).withColumnsRenamed({f"{x}_key": x, f"{x}_n": f"{x}n"})
    left = named(mixed.where("label <> most").select("h", "key", "n", "common", "label", "bands"), "a", "h")
    right = named(mixed.select("h", "key", "n", "common", "label", "bands", "most"), "b", "h")
    once = F.col("h") == F.array_min(F.array_intersect("a_bands", "b_bands"))  # in the first bucket that they share
    dense = left.join(right, "h").where(F.expr("a_label <> b_label and (b_label = b_most or a < b)") & need("least(a_common, b_common)") & once).select("a", "b")
    side = rare.where("c > 1").select("key", "g").join(mixed.select("key", "n", "common", "shared", "label").distinct(), "key")
    left, right = named(side, "a", "g"), named(side, "b", "g")
    sharing = left.join(right, "g").where("a < b and a_label <> b_label").where(~need("least(a_common, b_common)") & need("least(a_common, b_common) + least(a_shared, b_shared)"))
    sharing = sharing.groupBy("a", "b", "an", "bn", "a_common", "b_common").agg(F.count("*").alias("both")).where(need("least(a_common, b_common) + both")).select("a", "b")
    rest = dense.union(sharing).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = written(rest.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    second = verified(rest)

    final = components(first.union(second), "a", "b").select(F.col("node").alias("key"), "label")
    linked = classes.select("key", "doc").join(final, "key")
    linked = written(linked, "linked")
    least = written(linked.groupBy("label").agg(F.min("doc").alias("component")), "least")  # so that a component of very many texts can be split in the join
    least = linked.join(least, "label").select("key", "component")
    of_class = classes.select("key", "doc").join(least, "key", "left").select("key", F.coalesce("component", "doc").alias("component"))
    of_class = written(of_class, "components")  # both sides of the next join are plain shuffles, so a class of very many copies can be split
    found = docs.select("id", "key", "n").join(of_class, "key", "left").select("id", "n", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS, **options: object) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one of the smallest id, a null id first.

    A row is told by its id and a hash of its text, so of rows that share an id
    each is judged by its own text; rows that agree in both stay or go
    together. Texts without words (null, empty) all stay. The columns are those
    of ``df`` whatever their names; an empty table stays empty.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))
    gone = near_duplicates(df.select(row.alias("row"), F.col(text).alias("text")), "row", "text", broadcast_ids=broadcast_ids, **options).where(~F.col("kept"))
    gone = written(gone.select("row.id", "row.text").distinct(), "gone")
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    return df.join(gone, df[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(df[text]) == gone["text"]), "left_anti")
