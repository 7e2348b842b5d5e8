"""Removal of byte strings that occur in an earlier document, by suffix arrays of shards.

Every byte goes that is covered by a string of ``width`` bytes which also starts in
a document with a smaller id. Strings are judged on the input, and never cross
documents.

1. Texts are written as blocks of about ``BLOCK`` bytes. Each window of ``width``
   bytes has an anchor: of its stretches of ``ANCHOR`` bytes the one with the
   smallest hash. Neighbouring windows with one anchor form a piece of at most
   ``2 * width - ANCHOR`` bytes. Equal windows have equal anchors, so all that can
   be equal meets in one shard: the anchor's.
2. Blocks send their distinct pieces, as hashes with the smallest id, to the
   shards, a row for each block and shard. A piece that is the only one of its
   anchor is settled by its smallest id. Of the other anchors each distinct piece
   is sent as bytes, once, however many documents hold it.
3. A shard's pieces are one text, whose suffixes ``induced.suffix_order`` sorts by
   external induced sorting. Suffixes that share ``width`` bytes with the one before are
   one string; the smallest id of their pieces holds for all of them. Queues and
   arrays beyond ``budget`` bytes are on the task's disk.
4. The answers go back to the blocks, which mark the covered bytes.

A passage in very many documents costs a shard one row for each block, not one
for each document. A shard has about ``SHARD`` bytes of text; its hashes (about 1.3
bytes a byte of text) are in one task's memory, its suffixes need not be. What is
shuffled is the blocks twice, for the two times that answers meet them, and hashes.

Defined results: a null text is empty; documents that share an id do not remove
from each other, and each is judged on its own; a null id is smaller than all;
texts shorter than ``width`` lose nothing; an empty table gives an empty result;
other columns are ignored. Texts of any length are scanned in pieces of 256 KB.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.induced import CHUNK, stable, suffix_order
from bandwright.llm.store import release, small_batches, written

WIDTH = 50
ANCHOR = 20
BLOCK = 1 << 20
SHARD = 12 << 20
BUDGET = 1 << 27
PART = 1 << 18
NO_ID = -(1 << 63)
ENTRY = np.dtype([("s", "<u8"), ("first", "<i8"), ("a", "<u4"), ("many", "u1")])
ASK = np.dtype([("s", "<u8"), ("first", "<i8"), ("a", "<u4"), ("many", "u1"), ("size", "<u2")])
RUN = np.dtype([("n", "u1"), ("first", "<i8")])
NOTHING, SETTLED, SENDS, WAITS = range(4)


def give_back() -> None:
    """What this worker has freed goes back to the system; else it is kept beside what the executor's other worker takes."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pieces(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash, start, number of windows) of the pieces of some texts that lie one after the other."""
    found = [[np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)]]
    per = width - ANCHOR + 1
    low = np.uint64((1 << 23) - 1)
    for base in range(0, len(data), PART):
        part = data[base : base + PART + width - 1]
        n = len(part) - width + 1
        if n < 1:
            continue
        total = ts.prefix_hashes(part)
        at = np.arange(len(part) - ANCHOR + 1, dtype=np.uint64)
        keys = ts.hash_neighbours(total, ANCHOR) & ~low | at
        anchor = (least_of(keys, per) & low).astype(np.int64)
        edges = bounds[np.searchsorted(bounds, base, "right") : np.searchsorted(bounds, base + len(part), "left")] - base
        across = np.zeros(n + 1, np.int64)  # windows that a boundary between texts cuts
        np.add.at(across, np.clip(edges - width + 1, 0, n), 1)
        np.add.at(across, np.clip(edges, 0, n), -1)
        inside = np.cumsum(across[:-1]) == 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
        lo, hi = np.flatnonzero(starts), np.flatnonzero(ends)
        a = ts.mix(ts.hash_between(total, anchor[lo], anchor[lo] + ANCHOR))
        found.append([a, ts.hash_between(total, lo, hi + width), lo + base, hi - lo + 1])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@dataclass
class Block:
    """A block's pieces, its distinct ones (entries) in order of shard, and where each shard's entries begin."""

    start: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    entries: np.ndarray
    sample: np.ndarray
    shards: np.ndarray
    cuts: np.ndarray


def block_of(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray, width: int, shards: int) -> Block:
    a, s, start, windows = pieces(data, bounds, width)
    doc = np.searchsorted(bounds, start, "right") - 1
    shard = ((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    a = a.astype(np.uint32)
    order = np.argsort(s)  # equal pieces are neighbours in any order
    order = order[stable(shard[order], shards)]
    new = np.ones(len(order), bool)
    new[1:] = (s[order][1:] != s[order][:-1]) | (a[order][1:] != a[order][:-1]) | (shard[order][1:] != shard[order][:-1])
    heads = np.flatnonzero(new)
    entry = np.zeros(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    entries = np.zeros(len(heads), ENTRY)
    sample = order[heads]
    entries["s"], entries["a"] = s[sample], a[sample]
    if len(heads):
        own = ids[doc[order]]
        entries["first"] = np.minimum.reduceat(own, heads)
        entries["many"] = np.maximum.reduceat(own, heads) != entries["first"]
    there, cuts = np.unique(shard[sample], return_index=True)
    return Block(start, windows, doc, entry, entries, sample, there, np.append(cuts, len(heads)))


def blocks_in(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, ids, bounds of the texts, bytes) of the blocks of a batch with columns block, ids, sizes, data."""
    for row in range(batch.num_rows):
        ids = batch.column("ids")[row].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        sizes = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False)
        yield row, ids, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(batch.column("data")[row].as_buffer(), np.uint8)


def _columns(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


SENT = [("shard", pa.int32()), ("block", pa.int64()), ("x", pa.binary())]
ASKED = [*SENT, ("bytes", pa.binary())]
SENT_TYPES, ASKED_TYPES = "shard int, block long, x binary", "shard int, block long, x binary, bytes binary"


def codes_of(table: pa.Table) -> pa.Table:
    """For the entries that blocks sent to a shard: (shard, block, x) with a code for each entry and the first id of the settled ones."""
    sizes = np.array([np.frombuffer(x.as_buffer(), "<i8", 1)[0] for x in table["x"]])
    s, a, first, many = (np.zeros(int(sizes.sum()), ENTRY[c]) for c in ("s", "a", "first", "many"))
    for x, at, n in zip(table["x"], np.cumsum(sizes) - sizes, sizes, strict=True):  # column by column: no copy of all entries beside them
        own = unpacked_entries(x.as_buffer())
        s[at : at + n], a[at : at + n], first[at : at + n], many[at : at + n] = own["s"], own["a"], own["first"], own["many"]
    order = np.lexsort((s, a))
    new_a, new = np.ones(len(s), bool), np.ones(len(s), bool)
    a = a[order]
    new_a[1:] = a[1:] != a[:-1]
    s = s[order]
    new[1:] = new_a[1:] | (s[1:] != s[:-1])
    del a, s
    heads, heads_a = np.flatnonzero(new), np.flatnonzero(new_a)
    first, many = first[order], many[order]
    shared = (np.minimum.reduceat(first, heads_a) != np.maximum.reduceat(first, heads_a)) | (np.maximum.reduceat(many, heads_a) > 0)
    least = np.minimum.reduceat(first, heads)
    alone = np.add.reduceat(new, heads_a, dtype=np.int64) == 1
    kind = np.where(~shared, NOTHING, np.where(alone, SETTLED, WAITS)).astype(np.uint8)
    code = np.repeat(kind, np.diff(np.append(heads_a, len(new))))
    code[new & (code == WAITS)] = SENDS
    codes, firsts = np.zeros(len(new), np.uint8), first
    codes[order], firsts[order] = code, np.repeat(least, np.diff(np.append(heads, len(new))))
    rows = []
    for shard, block, at, n in zip(table["shard"].to_pylist(), table["block"].to_pylist(), np.cumsum(sizes) - sizes, sizes, strict=True):
        own = codes[at : at + n]
        if own.any():
            rows.append((shard, block, own.tobytes() + firsts[at : at + n][own == SETTLED].tobytes()))
    return pa.Table.from_batches([_columns(SENT, rows)])


def packed_entries(entries: np.ndarray) -> bytes:
    """Entries column by column, the ids as differences from the smallest, in as few bytes as hold them: they compress well."""
    low = int(entries["first"].min()) if len(entries) else 0
    apart = entries["first"].view(np.uint64) - np.uint64(low & ((1 << 64) - 1))
    size = next(k for k in (2, 4, 8) if k == 8 or not len(apart) or int(apart.max()) < 1 << 8 * k)
    head = np.array([len(entries), low, size], "<i8")
    return b"".join(x.tobytes() for x in (head, entries["s"], entries["a"], apart.astype(f"<u{size}"), np.packbits(entries["many"])))


def unpacked_entries(x: bytes) -> np.ndarray:
    n, low, size = np.frombuffer(x, "<i8", 3).tolist()
    out = np.zeros(n, ENTRY)
    out["s"], out["a"] = np.frombuffer(x, "<u8", n, 24), np.frombuffer(x, "<u4", n, 24 + 8 * n)
    apart = np.frombuffer(x, f"<u{size}", n, 24 + 12 * n).astype(np.uint64)
    out["first"] = (apart + np.uint64(low & ((1 << 64) - 1))).view(np.int64)
    out["many"] = np.unpackbits(np.frombuffer(x, np.uint8, offset=24 + (12 + size) * n), count=n)
    return out


def unpacked(x: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, np.uint8, n), np.frombuffer(x, np.int64, offset=n)


def runs_of(table: pa.Table, width: int, budget: int) -> pa.Table:
    """For the pieces that blocks asked a shard about: (shard, block, x) with the first ids of each piece's windows, run by run."""
    asks = [np.frombuffer(x.as_buffer(), ASK) for x in table["x"]]
    sizes = np.array([len(x) for x in asks])
    e = np.concatenate(asks)
    texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["bytes"]]
    order = np.lexsort((e["size"] == 0, e["s"], e["a"]))  # who sends the bytes comes first
    new = np.ones(len(e), bool)
    new[1:] = (e["a"][order][1:] != e["a"][order][:-1]) | (e["s"][order][1:] != e["s"][order][:-1])
    heads = np.flatnonzero(new)
    piece = np.zeros(len(e), np.int64)
    piece[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(e["first"][order], heads)
    # the bytes of all pieces, in the order in which they were sent, each with a mark at its end
    senders = np.flatnonzero(e["size"] > 0)
    size = e["size"][senders].astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.ones(int((size + 1).sum()) + 1, np.uint16)
    text[-1] = 0
    inside = np.ones(len(text), bool)
    inside[start + size] = inside[-1] = False
    text[inside] = np.concatenate([t for t in texts if len(t)])
    text[inside] += np.uint16(2)
    ids, first = np.unique(least[piece[senders]], return_inverse=True)  # ids by number, which takes half the bytes for each window
    del inside, order, new
    suffixes, shared = suffix_order(text, width, budget)
    windows = size - width + 1
    begin = np.cumsum(windows) - windows
    place = np.arange(int(windows.sum())) + np.repeat(start - begin, windows)  # of each window in the text
    owns = np.full(len(text), len(ids), np.uint32)  # the first id of each window's piece, or none
    owns[place] = np.repeat(first, windows)
    answer = np.zeros(len(text), np.uint32)  # for each window, the first id of its string
    chunk, at = CHUNK, 0
    while at < len(suffixes):  # strings do not end with a chunk: it goes on to the end of its last one
        end = min(at + chunk, len(suffixes))
        while end < len(suffixes) and shared[end] >= width:
            stop = np.flatnonzero(shared[end : end + chunk] < width)
            end = end + int(stop[0]) if len(stop) else min(end + chunk, len(suffixes))
        own = owns[suffixes[at:end]]
        whole = np.flatnonzero(own < len(ids))
        string = np.cumsum(shared[at:end] < width)[whole]
        pos, own = suffixes[at:end][whole], own[whole]
        if len(pos):
            heads_ = np.flatnonzero(np.append(True, string[1:] != string[:-1]))
            answer[pos] = np.repeat(np.minimum.reduceat(own, heads_), np.diff(np.append(heads_, len(pos))))
        at = end
    del suffixes, shared, text, owns
    own = answer[place]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    new[begin] = True
    cuts = np.flatnonzero(new)
    run = np.zeros(len(cuts), RUN)
    run["n"], run["first"] = np.diff(np.append(cuts, len(own))), ids[own[cuts]]
    raw, edges = run.tobytes(), np.searchsorted(cuts, np.append(begin, len(own))).tolist()
    runs: list[bytes] = [b""] * len(heads)
    for k, a, b in zip(piece[senders].tolist(), edges[:-1], edges[1:], strict=True):
        runs[k] = bytes([b - a]) + raw[a * RUN.itemsize : b * RUN.itemsize]
    rows = [(shard, block, b"".join([runs[k] for k in piece[at : at + n].tolist()])) for shard, block, at, n in zip(table["shard"].to_pylist(), table["block"].to_pylist(), np.cumsum(sizes) - sizes, sizes, strict=True)]
    return pa.Table.from_batches([_columns(SENT, rows)])


def covered(x: Block, replies: list[dict], length: int, ids: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of a block go, from the shards' codes and runs."""
    where = {s: i for i, s in enumerate(x.shards.tolist())}
    settled = np.full(len(x.entries), np.iinfo(np.int64).max)
    waits = np.zeros(len(x.entries), bool)
    codes = {}
    for r in (r for r in replies if not r["late"]):
        a, b = x.cuts[where[r["shard"]]], x.cuts[where[r["shard"]] + 1]
        codes[r["shard"]], firsts = unpacked(r["x"], b - a)
        settled[a:b][codes[r["shard"]] == SETTLED] = firsts
        waits[a:b] = codes[r["shard"]] >= SENDS
    edges = np.zeros(length + 1, np.int64)
    own = ids[x.doc]
    k = np.flatnonzero(settled[x.entry] < own)
    np.add.at(edges, x.start[k], 1)
    np.add.at(edges, x.start[k] + x.windows[k] + width - 1, -1)
    n_runs = np.zeros(len(x.entries), np.int64)
    at_runs = np.zeros(len(x.entries), np.int64)
    runs, have = [], 0
    for r in (r for r in replies if r["late"]):
        a, b = x.cuts[where[r["shard"]]], x.cuts[where[r["shard"]] + 1]
        raw, at = r["x"], 0
        for e in (a + np.flatnonzero(codes[r["shard"]] >= SENDS)).tolist():
            n = raw[at]
            runs.append(raw[at + 1 : at + 1 + n * RUN.itemsize])
            n_runs[e], at_runs[e] = n, have
            have += n
            at += 1 + n * RUN.itemsize
    run = np.frombuffer(b"".join(runs), RUN)
    k = np.flatnonzero(waits[x.entry])
    n = n_runs[x.entry[k]]
    piece = np.repeat(k, n)
    which = np.repeat(at_runs[x.entry[k]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    size = run["n"][which].astype(np.int64)
    total = np.cumsum(size) - size
    start = x.start[piece] + total - np.repeat(total[np.cumsum(n) - n] if len(n) else total, n)
    gone = run["first"][which] < own[piece]
    np.add.at(edges, start[gone], 1)
    np.add.at(edges, start[gone] + size[gone] + width - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, shard_bytes: int = SHARD, block_bytes: int = BLOCK, budget: int = BUDGET) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of ``df``; ``kept`` is what is left of its bytes."""
    if not ANCHOR < width <= 150:
        raise ValueError(f"width must be over {ANCHOR} and at most 150 bytes")
    small_batches(df.sparkSession)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]
        for batch in batches:
            for a, b, texts in ts.slices(batch.column(1), size=block_bytes):
                yield _columns(kinds, [(uuid.uuid4().int >> 65, batch.column(0).slice(a, b - a).to_pylist(), np.diff(texts.offsets), texts.data.tobytes())])

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = written(source.mapInArrow(block, "block long, ids array<long>, sizes array<long>, data binary"), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, bounds, data in blocks_in(batch):
                x = block_of(data, bounds, ids, width, shards)
                name = batch.column("block")[row].as_py()
                yield _columns(SENT, [(s, name, packed_entries(x.entries[a:b])) for s, a, b in zip(x.shards.tolist(), x.cuts[:-1], x.cuts[1:], strict=True)])
                del x
        give_back()

    def coded(table: pa.Table) -> pa.Table:
        found = codes_of(table)
        give_back()
        return found

    codes = written(blocks.mapInArrow(send, SENT_TYPES).groupBy("shard").applyInArrow(coded, SENT_TYPES), "codes")
    release(df.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, bounds, data in blocks_in(batch):
                x = block_of(data, bounds, ids, width, shards)
                where = {s: i for i, s in enumerate(x.shards.tolist())}
                out = []
                for r in batch.column("replies")[row].as_py():
                    a, b = x.cuts[where[r["shard"]]], x.cuts[where[r["shard"]] + 1]
                    code, _ = unpacked(r["x"], b - a)
                    asks = np.zeros(int((code >= SENDS).sum()), ASK)
                    for c in ENTRY.names:
                        asks[c] = x.entries[c][a:b][code >= SENDS]
                    sends = x.sample[a:b][code == SENDS]
                    asks["size"][code[code >= SENDS] == SENDS] = x.windows[sends] + width - 1
                    if len(asks):
                        out.append((r["shard"], batch.column("block")[row].as_py(), asks.tobytes(), b"".join(data[p : p + n].tobytes() for p, n in zip(x.start[sends].tolist(), (x.windows[sends] + width - 1).tolist(), strict=True))))
                yield _columns(ASKED, out)
                del x, out
        give_back()

    def answered(table: pa.Table) -> pa.Table:
        found = runs_of(table, width, budget)
        give_back()
        return found

    def with_replies(replies: DataFrame) -> DataFrame:
        listed = replies.groupBy("block").agg(F.collect_list(F.struct("shard", "late", "x")).alias("replies"))
        return blocks.join(listed, "block", "left")

    early = codes.select("block", "shard", F.lit(False).alias("late"), "x")
    asked = with_replies(early).where("replies is not null").mapInArrow(ask, ASKED_TYPES)
    runs = written(asked.groupBy("shard").applyInArrow(answered, SENT_TYPES), "runs")
    release(df.sparkSession)
    kind = dict(df.select(id_col).dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, bounds, data in blocks_in(batch):
                replies = batch.column("replies")[row].as_py()
                gone = covered(block_of(data, bounds, ids, width, shards), replies, len(data), ids, width) if replies else np.zeros(len(data), bool)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = bounds[:-1][(bounds[:-1] < len(data)) & (np.diff(bounds) > 0)]
                begins[inner] = gone[inner]
                x = ts.Texts(data, bounds)
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                own = batch.column("ids")[row].values
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(bounds)), pa.array(x.sums(gone)), pa.array(x.sums(begins)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    late = runs.select("block", "shard", F.lit(True).alias("late"), "x")
    done = with_replies(early.union(late)).mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")

