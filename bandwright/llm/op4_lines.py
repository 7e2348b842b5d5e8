"""Line dedup by a segment-partition edit join.

A line goes when the same line, or one within a number of edits, occurs earlier
in the corpus (by document id, then line number); the first stays. ``EDITS``
gives the edits by the length of the shorter line: none below 40 code points, 2
from 40 and 3 from 100 on. Lines of fewer than ``MIN_CHARS`` code points, or no
letter or digit, are left alone: the shortest lines recur in clean prose. From
``MIN_CHARS`` to the first length of ``EDITS`` only exact copies go.

Each line of n code points with k edits is cut into k + 1 segments (the shorter
ones first). Two lines within k edits share a segment at nearly the same place,
so a line is indexed by (n, segment number, segment) and probes, for every
length n up to its own that its edits reach, the substrings that a segment can
have moved to (both the left and the right side bound the move). Candidates are
the rows that meet in the join on that key; they are verified with a banded
bit-parallel edit distance on the whole lines, after common ends are cut off.

A key that more than ``HOT`` lines are indexed by (a passage in many lines) is
not joined as it is but refined. If segment i is the one that is equal, the k
edits can be shared out so that i of them lie before it and k - i after it. The
longest part that is still open is cut into segments the same way, and the key
is extended by one of these, with its place and length; part by part, until at
most ``HOT_REFINED`` lines share a key or what is open is no longer than its
edits. Lines that meet there are candidates only if their counts of characters
differ by two for each edit at most. So lines that differ in a number only are
told apart by the number, and candidates grow with the lines and not with their
square.

Only keys and numbers are shuffled, not lines: the texts of candidates and of
lines with a hot key alone are read again. Probes are never written: they go from the texts to the join.
Decisions are joined to the texts once, to rebuild them.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; rows that share an id are told apart by nothing but their text, so
equal rows keep or lose the same lines and neither removes the other's; a null
id sorts first; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm import textscan as ts
from bandwright.llm.store import release, small_batches, written

EDITS = ((40, 2), (100, 3))
MIN_CHARS = 20
HOT = 16
HOT_REFINED = 128
TALLIES = ("t0", "t1", "t2", "t3")
BROADCAST_DOCS = 500_000
FILTERED_KEYS = 1_000_000
BROADCAST_KEYS = 100_000
LINE_SLICE_BYTES = 1 << 16


Edits = tuple[tuple[int, int], ...]


def edit_within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k, in a band of 2k + 1 diagonals held as bits.

    For each number of edits up to k, one word of bits says on which diagonals
    the current place can be reached; common ends are cut off first.
    """
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    n -= i
    j = 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = (a[: len(a) - j], b[: len(b) - j]) if j else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    if not a:
        return True
    # states: bit d of reach[e] is set if e edits reach the current place of a on diagonal d - k
    band = (1 << (2 * k + 1)) - 1
    same = {c: 0 for c in set(a)}
    for p, c in enumerate(b):
        if c in same:
            same[c] |= 1 << p
    reach = [0] * (k + 1)
    reach[0] = 1 << k
    for e in range(1, k + 1):  # insertions before the first character
        reach[e] = (reach[e - 1] | reach[e - 1] << 1) & band
    for p, c in enumerate(a):
        agree = (same[c] << k >> p) & band  # diagonal d compares a[p] with b[p + d - k]
        before = 0
        now = []
        for e in range(k + 1):
            step = reach[e] & agree
            if e:
                step |= reach[e - 1]  # substitution
                step |= reach[e - 1] >> 1  # deletion from a
                step |= before << 1  # insertion into a
                step &= band
            now.append(step)
            before = step
        reach = now
        if not any(reach):
            return False
    at = len(b) - len(a) + k
    return any(r >> at & 1 for r in reach)


def _windows(k: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, move) of every substring that a line probes."""
    out = []
    for delta in range(k + 1):
        for i in range(k + 1):
            low, high = max(-i, delta - (k - i)), min(i, delta + (k - i))
            out += [(delta, i, move) for move in range(low, high + 1)]
    return out


def _segments(n: np.ndarray, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of segment i of lines of n code points."""
    short = n // (k + 1)
    long_from = k + 1 - n % (k + 1)
    start = i * short + np.maximum(0, i - long_from)
    return start, start + short + (i >= long_from)


def _allowed(n: np.ndarray | int, edits: Edits) -> np.ndarray:
    """The edits that lines of n code points may have."""
    return np.array([0, *(k for _, k in edits)])[np.searchsorted([least for least, _ in edits], n, "right")]


class Lines:
    """The lines of some texts that take part: owner, number, size and two hashes; their index keys, probe keys and counts."""

    def __init__(self, texts: ts.Texts, least: int):
        self.texts = texts
        starts, ends, first = texts.lines()
        head = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=head[1:])
        solid = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(SOLID[texts.data], out=solid[1:])
        size = head[ends] - head[starts]
        owner = ts.spans_of(first)
        chosen = np.flatnonzero((size >= least) & (solid[ends] > solid[starts]))
        self.number = (np.arange(len(starts)) - first[owner])[chosen]
        self.starts, self.ends, self.size, self.owner = starts[chosen], ends[chosen], size[chosen], owner[chosen]
        self.base = head[self.starts]
        self.total = ts.prefix_hashes(texts.data)
        self.key = ts.hash_between(self.total, self.starts, self.ends)

    def other(self) -> np.ndarray:
        return ts.hash_ranges(self.texts.data ^ 0x55, self.starts, self.ends)

    def segments(self, edits: Edits, own: bool, repeats: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key hash, line, whether it is an index key): the index keys alone, or all keys to probe; of equal lines one has keys unless ``repeats``."""
        byte_at = np.append(np.flatnonzero((self.texts.data & 0xC0) != 0x80), len(self.texts.data))  # of the nth code point
        once = np.arange(len(self.key)) if repeats else np.sort(np.unique(self.key, return_index=True)[1])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for k in sorted({k for _, k in edits}):
            for delta, i, move in _windows(k):
                is_own = (delta, move) == (0, 0)
                if own and not is_own:
                    continue
                at = once[_allowed(self.size[once] - delta, edits) == k]
                n = self.size[at] - delta
                a, b = _segments(n, k, i)
                a, b = a + move, b + move
                fits = (a >= 0) & (b <= self.size[at])
                at, n, a, b = at[fits], n[fits], a[fits], b[fits]
                h = ts.hash_between(self.total, byte_at[self.base[at] + a], byte_at[self.base[at] + b])
                found.append((ts.mix(h + (n * (k + 1) + i).astype(np.uint64) * np.uint64(ts.BASE)), at, np.full(len(at), is_own)))
        h, at, flags = (np.concatenate(parts) for parts in zip(*found, strict=True))
        return h, at, flags

    def tallies(self) -> np.ndarray:
        """Four integers for each line: its counts of 32 groups of characters, a byte each."""
        data = self.texts.data
        last = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, True)) if len(data) else np.zeros(0, np.int64)  # byte of each code point
        at = np.searchsorted(self.starts, last, "right") - 1
        inside = (at >= 0) & (last < self.ends[np.maximum(at, 0)]) if len(self.starts) else np.zeros(len(last), bool)
        counts = np.bincount(at[inside] * 32 + (data[last[inside]].astype(np.int64) * 151 >> 3) % 32, minlength=len(self.starts) * 32)
        return counts.reshape(-1, 32).astype(np.uint8).view(np.int64).reshape(-1, len(TALLIES))

    def states(self, edits: Edits) -> States:
        """The open state of each line for each length of an index line that it can be near to."""
        at, n, k = [], [], []
        for most in sorted({k for _, k in edits}):
            for delta in range(most + 1):
                lines = np.flatnonzero(_allowed(self.size - delta, edits) == most)
                at.append(lines)
                n.append(self.size[lines] - delta)
                k.append(np.full(len(lines), most))
        at, n, k = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (at, n, k))
        none = np.zeros(len(n), np.int64)
        parts = np.stack([n, k, none, self.size[at], none], axis=1)[:, None, :].astype(np.int64)
        return States(at, np.zeros(len(at), np.uint64), n == self.size[at], parts)

    def refined(self, states: States) -> States:
        """The states after one more segment, of the longest open part."""
        open_ = np.where(states.parts[:, :, 0] > states.parts[:, :, 1], states.parts[:, :, 0], 0)
        part = open_.argmax(axis=1)
        rows = np.arange(len(part))
        is_open = open_[rows, part] > 0
        byte_at = np.append(np.flatnonzero((self.texts.data & 0xC0) != 0x80), len(self.texts.data))
        found = [States(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros((0, states.parts.shape[1] + 1, 5), np.int64))]
        size, budget, start, have, index = states.parts[rows, part].T
        for k in np.unique(budget[is_open]).tolist():
            for i in range(k + 1):
                for move in range(-i, i + 1):
                    can = is_open & (budget == k) & (np.abs(have - size - move) <= k - i)
                    row = np.flatnonzero(can)
                    a, b = _segments(size[row], k, i)
                    fits = (a + move >= 0) & (b + move <= have[row])
                    row, a, b = row[fits], a[fits], b[fits]
                    base = self.base[states.line[row]] + start[row] + move
                    h = ts.hash_between(self.total, byte_at[base + a], byte_at[base + b])
                    h = ts.mix(h + (size[row] * (k + 1) + i).astype(np.uint64) * np.uint64(ts.BASE) + states.h[row] * np.uint64(3))
                    parts = np.concatenate([states.parts[row], np.stack([size[row] - b, np.full(len(row), k - i), start[row] + b + move, have[row] - b - move, index[row] + b], axis=1)[:, None, :]], axis=1)
                    parts[np.arange(len(row)), part[row]] = np.stack([a, np.full(len(row), i), start[row], a + move, index[row]], axis=1)
                    found.append(States(states.line[row], h, states.own[row] & (move == 0), parts))
        return States(*(np.concatenate(c) for c in zip(*((f.line, f.h, f.own, f.parts) for f in found), strict=True)))


@dataclass
class States:
    """Lines on their way to a key: line, key so far, whether it is an index key, and the open parts (size in the index line, edits, start and size in this line, start in the index line)."""

    line: np.ndarray
    h: np.ndarray
    own: np.ndarray
    parts: np.ndarray

    def where(self, chosen: np.ndarray) -> States:
        return States(self.line[chosen], self.h[chosen], self.own[chosen], self.parts[chosen])


def line_states(texts: ts.Texts, edits: Edits, hots: tuple[np.ndarray, np.ndarray], cuts: dict[int, np.ndarray], depth: int, cut: bool = False) -> tuple[Lines, States]:
    """The states of one-line texts after ``depth`` segments, through the keys of ``hots`` (line, h) alone; open parts are cut as ``cuts`` says for each h, those of the last keys too with ``cut``."""
    x = Lines(texts, edits[0][0])
    known = np.unique(ts.mix(hots[1] + hots[0].astype(np.uint64) * np.uint64(ts.BASE)))
    states = x.refined(x.states(edits))
    for k in range(depth if cut else depth - 1):
        chosen = np.isin(ts.mix(states.h + x.owner[states.line].astype(np.uint64) * np.uint64(ts.BASE)), known)
        states = states.where(chosen)
        there, which = np.unique(states.h, return_inverse=True)
        if len(there):
            both = np.stack([cuts[h] for h in there.view(np.int64).tolist()])[which]  # (state, part, before and after)
            states.parts[:, :, 0] -= both.sum(axis=2)
            states.parts[:, :, 3] -= both.sum(axis=2)
            states.parts[:, :, 2] += both[:, :, 0]
            states.parts[:, :, 4] += both[:, :, 0]
        if k < depth - 1:
            states = x.refined(states)
    return x, states


def is_settled(states: States) -> np.ndarray:
    return (states.parts[:, :, 0] <= states.parts[:, :, 1]).all(axis=1)


def _alignments(size: int, have: int, budget: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(places in a part of the index line, places in the line's part) that may agree so that all between them costs at most the budget."""
    out = []
    for n in range(min(size, have) + 1):
        for s in itertools.combinations(range(size), n):
            for j in itertools.combinations(range(have), n):
                gaps = zip((-1, *s), (*s, size), (-1, *j), (*j, have), strict=True)
                if sum(max(b - a, d - c) - 1 for a, b, c, d in gaps) <= budget:
                    out.append((s, j))
    return [((), ())] if ((), ()) in out else out


def settled(x: Lines, states: States) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, line, whether it is an index key) for states whose parts are all no longer than their edits in the index line.

    Lines that meet in such a key are within their edits: it says which
    characters of the open parts agree, and the rest costs no more than the
    part's edits. The index line has a key for each choice of characters.
    """
    byte_at = np.append(np.flatnonzero((x.texts.data & 0xC0) != 0x80), len(x.texts.data))
    h, line, own, parts = states.h, states.line, states.own, states.parts
    for p in range(parts.shape[1]):
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, *parts.shape[1:]), np.int64))]
        kind = np.column_stack([parts[:, p, [0, 3, 1]], own]) if len(h) else np.zeros((0, 4), np.int64)
        kinds, which = np.unique(kind, axis=0, return_inverse=True)
        for k, (size, have, budget, is_own) in enumerate(kinds.tolist()):
            row = np.flatnonzero(which.ravel() == k)
            choices = [(s, s) for n in range(size + 1) for s in itertools.combinations(range(size), n)] if is_own else _alignments(size, have, budget)
            for s, j in choices:
                key = h[row].copy()
                if s:
                    key = ts.mix(key + np.uint64((p * 64 + sum(1 << i for i in s)) * ts.BASE & ts.MASK))
                for place in j:
                    at = x.base[line[row]] + parts[row, p, 2] + place
                    key = ts.mix(key * np.uint64(5) + ts.hash_between(x.total, byte_at[at], byte_at[at + 1]))
                found.append((key, line[row], own[row], parts[row]))
        h, line, own, parts = (np.concatenate(c) for c in zip(*found, strict=True))
    return h, line, own


SOLID = np.zeros(256, bool)
SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _signed(v: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(v).view(np.int64))


def _hot_lines(source: DataFrame, edits: Edits, hot: np.ndarray) -> DataFrame:
    """(key, value, hots) of the distinct lines with keys in ``hot``."""
    hot = np.sort(hot)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in ts.slices(batch.column(0)):
                x = Lines(texts, edits[0][0])
                h, at, _ = x.segments(edits, False)
                near = hot[np.minimum(np.searchsorted(hot, h.view(np.int64)), len(hot) - 1)]
                h, at = h[near == h.view(np.int64)], at[near == h.view(np.int64)]
                order = np.argsort(at, kind="stable")
                chosen, first = np.unique(at[order], return_index=True)
                values = pa.array([texts.data[x.starts[i] : x.ends[i]].tobytes().decode() for i in chosen], pa.string())
                hots = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), _signed(h[order]))
                yield pa.RecordBatch.from_arrays([_signed(x.key[chosen]), values, hots], ["key", "value", "hots"])

    return source.select("text").mapInArrow(lines, "key long, value string, hots array<long>").dropDuplicates(["key"])


HOTS = "array<struct<h:bigint,cut:array<int>>>"


def _hots_of(column: pa.ListArray, first: int, end: int) -> tuple[tuple[np.ndarray, np.ndarray], dict[int, np.ndarray]]:
    """((line, h), the cuts of each h) of some rows of a column of HOTS."""
    some = column.slice(first, end - first)
    owner = np.repeat(np.arange(end - first), np.diff(some.offsets.to_numpy()))
    flat = some.flatten()
    h = flat.field("h").to_numpy(zero_copy_only=False)
    there, at = np.unique(h, return_index=True)
    lists = flat.field("cut")
    return (owner, h.view(np.uint64)), {int(k): np.array(lists[int(i)].as_py(), np.int64).reshape(-1, 2) for k, i in zip(there, at, strict=True)}


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _collected(table: DataFrame) -> pa.Table | None:
    """A written table of keys, to go to all tasks with their code, if its rows are few; else joins shuffle it."""
    return table.toArrow() if table.count() <= BROADCAST_KEYS else None


def _with_cuts(batch: pa.RecordBatch, cut_of: dict[int, list[int]] | None) -> pa.RecordBatch:
    """Lines (key, value, hots, fresh) whose fresh keys went to the hots, with their cuts; as they are if these are joined already."""
    if cut_of is None:
        return batch
    hots = [old + [{"h": h, "cut": cut_of[h]} for h in fresh] for old, fresh in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    none = pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hots, pa.list_(pa.struct([("h", pa.int64()), ("cut", pa.list_(pa.int32()))]))), none], ["key", "value", "hots", "fresh"])


def _refined(lines: DataFrame, edits: Edits, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, nearest) of lines with hot keys: (a, b) of candidates, each once, and (key, near_first) of what is near for certain.

    One segment after the other. First, what all lines of a hot key have in
    common at the ends of the open parts is cut off, so that lines which
    differ in a few characters are left with these at once. Keys whose parts are no
    longer than their edits are settled: each line gets the earliest line there, an
    aggregation and a join, and no pair is made. Other keys of few lines
    give candidates; those of many go on. A round aggregates twice (ends, and
    counts of keys); hot keys and cuts go to the tasks with the code while they are at most
    ``BROADCAST_KEYS``, and are joined by a shuffle beyond it. Lines meet once, after the last round.
    """
    most = max(k for _, k in edits)
    tally = [F.col(t) for t in TALLIES]
    lines = lines.select("key", "value", F.array().cast(HOTS).alias("hots"), F.col("hots").alias("fresh"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, list of b), a > b, for the lines (key, size, tallies) that are near enough to one of their list by size and tallies."""
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            there = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            here = [c.to_numpy() for c in batch.columns[:-1]]
            theirs = [there.field(i).to_numpy() for i in range(len(here))]
            bytes_of = lambda columns: np.ascontiguousarray(np.stack(columns, axis=1)).view(np.uint8)
            apart = bytes_of(theirs[2:]) - bytes_of(here[2:])[owner]
            apart = np.minimum(apart, 0 - apart).sum(axis=1, dtype=np.int64)
            near = (here[0][owner] != theirs[0]) & (apart <= 2 * most - np.abs(here[1][owner] - theirs[1]))
            found = np.unique(np.sort(np.stack([here[0][owner][near], theirs[0][near]], axis=1), axis=1)[:, ::-1], axis=0)
            larger, first = np.unique(found[:, 0], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(larger), pa.ListArray.from_arrays(pa.array(np.append(first, len(found)).astype(np.int32)), pa.array(np.ascontiguousarray(found[:, 1])))], ["a", "bs"])

    rounds: list[tuple[DataFrame, DataFrame]] = []
    depth = 0
    while True:
        depth += 1

        def ends(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            """For each fresh key of some lines and each open part: its least and greatest text, forwards and backwards, and its least size."""
            for batch in batches:
                fresh = batch.column(3)
                for a, b, texts in ts.slices(batch.column(1), size=LINE_SLICE_BYTES):
                    hots, cuts = _hots_of(batch.column(2), a, b)
                    values = batch.column(1).slice(a, b - a).to_pylist()
                    some = fresh.slice(a, b - a)
                    mine = np.repeat(np.arange(b - a), np.diff(some.offsets.to_numpy()))
                    wanted = ts.mix(some.flatten().to_numpy().view(np.uint64) + mine.astype(np.uint64) * np.uint64(ts.BASE))
                    x, states = line_states(texts, edits, hots, cuts, depth)
                    states = states.where(np.isin(ts.mix(states.h + x.owner[states.line].astype(np.uint64) * np.uint64(ts.BASE)), wanted))
                    found: dict[int, list] = {}
                    for owner, h, parts in zip(x.owner[states.line].tolist(), states.h.view(np.int64).tolist(), states.parts.tolist(), strict=True):
                        here = []
                        for size, _, start, have, _ in parts:
                            part = values[owner][start : start + have]
                            back = part[::-1]
                            here += [part, part, back, back, min(size, have)]
                        before = found.get(h)
                        found[h] = here if before is None else [(max if i % 5 in (1, 3) else min)(v, w) for i, (v, w) in enumerate(zip(before, here, strict=True))]
                    columns = [pa.array([row[i] for row in found.values()], pa.int32() if i % 5 == 4 else pa.string()) for i in range(5 * depth + 5)]
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *columns], ["h", *named])

        def common(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            """(h, cut): how much of the beginning and the end of each open part all lines of a key share, which its least and greatest text do."""
            for batch in batches:
                rows = []
                for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    cut = []
                    for low, high, back_low, back_high, size in (row[5 * p : 5 * p + 5] for p in range(depth + 1)):
                        before = _common(low, high)
                        cut += [before, min(_common(back_low, back_high), size - before)]
                    rows.append(cut)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["h", "cut"])

        named = [f"{c}{p}" for p in range(depth + 1) for c in ("low", "high", "back_low", "back_high", "size")]
        all_ends = lines.mapInArrow(ends, "h long, " + ", ".join(f"{c} {'int' if c.startswith('size') else 'string'}" for c in named))
        all_ends = all_ends.groupBy("h").agg(*((F.max if c.startswith(("high", "back_high")) else F.min)(c).alias(c) for c in named))
        cuts = written(all_ends.mapInArrow(common, "h long, cut array<int>"), "cuts")
        table = _collected(cuts)
        cut_of = None if table is None else dict(zip(table["h"].to_pylist(), table["cut"].to_pylist(), strict=True))
        if cut_of is None:
            more = lines.select("key", F.explode("fresh").alias("h")).join(cuts, "h").groupBy("key").agg(F.collect_list(F.struct("h", "cut")).cast(HOTS).alias("more"))
            lines = written(lines.join(more, "key").select("key", "value", F.concat("hots", "more").alias("hots"), F.array().cast("array<long>").alias("fresh")), "cut-lines")

        def keys(batches: Iterator[pa.RecordBatch], depth: int = depth, cut_of: dict | None = cut_of) -> Iterator[pa.RecordBatch]:
            """The keys of each line, each once, after one more segment."""
            for batch in batches:
                batch = _with_cuts(batch, cut_of)
                names = batch.column(0).to_numpy()
                for a, b, texts in ts.slices(batch.column(1), size=LINE_SLICE_BYTES):
                    x, states = line_states(texts, edits, *_hots_of(batch.column(2), a, b), depth, cut=True)
                    open_ = x.refined(states.where(~is_settled(states)))
                    done = [settled(x, s.where(is_settled(s))) for s in (states, open_)]
                    open_ = open_.where(~is_settled(open_))
                    h, line, own = (np.concatenate(c) for c in zip(*done, strict=True))
                    h, line, own = np.concatenate([open_.h, h]), np.concatenate([open_.line, line]), np.concatenate([open_.own, own])
                    final = np.arange(len(line)) >= len(open_.line)
                    order = np.lexsort((final, own, h, line))
                    h, line, own, final = h[order], line[order], own[order], final[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1]) | (own[1:] != own[:-1]) | (final[1:] != final[:-1])
                    h, line, own, final = h[new], line[new], own[new], final[new]
                    columns = [_signed(h), pa.array(names[a:b][x.owner[line]]), pa.array(own), pa.array(final), pa.array(x.size[line]), *map(pa.array, x.tallies()[line].T)]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "key", "own", "final", "size", *TALLIES])

        found = written(lines.mapInArrow(keys, f"h long, key long, own boolean, final boolean, size long, {', '.join(f'{t} long' for t in TALLIES)}"), "refined")
        hot = written(found.where("own and not final").groupBy("h").count().where(F.col("count") > HOT_REFINED).select("h"), "hot")
        table = _collected(hot)
        rounds.append((found, hot if table is None else F.broadcast(hot)))
        if table is not None and not table.num_rows:
            break
        if table is not None:
            hot_keys = np.sort(table["h"].to_numpy().view(np.uint64))

            def still(batches: Iterator[pa.RecordBatch], depth: int = depth, cut_of: dict | None = cut_of, hot_keys: np.ndarray = hot_keys) -> Iterator[pa.RecordBatch]:
                """(key, value, hots, fresh) of the lines with keys that are still hot."""
                for batch in batches:
                    batch = _with_cuts(batch, cut_of)
                    for a, b, texts in ts.slices(batch.column(1), size=LINE_SLICE_BYTES):
                        x, states = line_states(texts, edits, *_hots_of(batch.column(2), a, b), depth + 1)
                        states = states.where(~is_settled(states) & np.isin(states.h, hot_keys))
                        owner, h = x.owner[states.line], states.h
                        order = np.lexsort((h, owner))
                        owner, h = owner[order], h[order]
                        new = np.ones(len(h), bool)
                        new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
                        owner, h = owner[new], h[new]
                        chosen, first = np.unique(owner, return_index=True)
                        fresh = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), _signed(h))
                        yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(pa.array(chosen)) for c in batch.columns[:3]), fresh], ["key", "value", "hots", "fresh"])

            lines = written(lines.mapInArrow(still, f"key long, value string, hots {HOTS}, fresh array<long>"), "hot-lines")
        else:
            if cut_of is not None:

                def with_cuts(batches: Iterator[pa.RecordBatch], cut_of: dict = cut_of) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        yield _with_cuts(batch, cut_of)

                lines = lines.mapInArrow(with_cuts, f"key long, value string, hots {HOTS}, fresh array<long>")
            fresh = found.where("not final").join(hot, "h").groupBy("key").agg(F.collect_set("h").alias("fresh"))
            lines = written(lines.drop("fresh").join(fresh, "key").select("key", "value", "hots", "fresh"), "hot-lines")

    # what all rounds have found meets at once
    final = functools.reduce(DataFrame.union, (found.where("final").select("h", "key", "own") for found, _ in rounds))
    certain = written(final.join(firsts, "key"), "certain")
    earliest = written(certain.groupBy("h").agg(F.min(F.when(F.col("own"), F.col("first"))).alias("indexed"), F.min("first").alias("all")), "earliest")
    near = certain.join(earliest, "h").select("key", F.when(F.col("own"), F.col("all")).otherwise(F.col("indexed")).alias("near_first")).where("near_first is not null")
    nearest = written(near.groupBy("key").agg(F.min("near_first").alias("near_first")), "nearest")

    cool = functools.reduce(DataFrame.union, (found.where("not final").drop("final").join(hot, "h", "left_anti") for found, hot in rounds))
    listed = cool.where("own").groupBy("h").agg(F.collect_list(F.struct("key", "size", *tally)).alias("near"))  # at most HOT_REFINED lines
    met = cool.select("h", "key", "size", *tally).join(listed, "h").where("size(near) > 1 or near[0].key <> key")
    pairs = written(met.select("key", "size", *tally, "near").mapInArrow(compared, "a long, bs array<long>"), "near")
    by = pairs.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    return by.select("a", F.explode("bs").alias("b")), nearest


def _decisions(df: DataFrame, id_col: str, text: str, edits: Edits, least: int, broadcast_docs: int) -> DataFrame:
    """(id, dropped): for each id, the lines to drop with the earliest place of each."""
    if any(least < (k + 1) ** 2 for least, k in edits):
        raise ValueError(f"edits {edits}: k edits need lines of (k + 1) ** 2 code points")
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["id"]
    edited = max(least, edits[0][0])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in ts.slices(batch.column(1)):
                x = Lines(texts, least)
                ids = batch.column(0).slice(a, b - a).take(pa.array(x.owner))
                yield pa.RecordBatch.from_arrays([ids, pa.array(x.number.astype(np.int32)), _signed(x.key), _signed(x.other())], ["id", "line", "key", "other"])

    def keys(own: bool) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, texts in ts.slices(batch.column(0)):
                    x = Lines(texts, edited)
                    h, at, _ = x.segments(edits, own)
                    yield pa.RecordBatch.from_arrays([_signed(h), _signed(x.key[at])], ["h", "key"])

        return source.select("text").mapInArrow(found, "h long, key long")

    places = written(source.mapInArrow(lines, f"id {kind}, line int, key long, other long"), "lines")
    distinct = written(places.groupBy("key", "other").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("copies")), "distinct")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for value, numbers in zip(batch.column(0), batch.column(1), strict=True):
                all_lines = (value.as_py() or "").split("\n")
                for n in numbers.as_py():
                    if n < len(all_lines):
                        values.append(all_lines[n])
            raw = [v.encode() for v in values]
            ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
            if raw:
                keys = ts.hash_ranges(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())], ["key", "value"])

    def texts_of(some: DataFrame) -> DataFrame:
        """(key, value) of the lines with distinct keys: each is read again where it is first."""
        wanted = some.join(distinct, "key").select("first.id", "first.line")
        wanted = written(wanted.groupBy("id").agg(F.collect_set("line").alias("lines")).select(F.col("id").alias("wanted"), "lines"), "wanted")
        if wanted.count() <= broadcast_docs:
            wanted = F.broadcast(wanted)
        found = source.join(wanted, F.col("id").eqNullSafe(F.col("wanted"))).select("text", "lines").mapInArrow(chosen, "key long, value string")
        return found.dropDuplicates(["key"])

    entries = written(keys(True).distinct(), "entries")
    hot = written(entries.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot")
    n_hot = hot.count()
    release(df.sparkSession)  # the largest shuffle comes next
    cool = entries if not n_hot else entries.join(F.broadcast(hot) if n_hot <= FILTERED_KEYS else hot, "h", "left_anti")
    certain = None
    pairs = keys(False).toDF("h", "a").join(cool.toDF("h", "b"), "h").where("a <> b").select("a", "b")
    if n_hot:
        if n_hot <= FILTERED_KEYS:
            lines_of = _hot_lines(source, edits, hot.toArrow()["h"].to_numpy())
        else:
            hots = written(keys(False).join(hot, "h").groupBy("key").agg(F.collect_set("h").alias("hots")), "hots")
            lines_of = hots.join(texts_of(hots.select("key")), "key").select("key", "value", "hots")
        more, certain = _refined(written(lines_of, "hot-lines"), edits, distinct.select("key", "first"))
        pairs = pairs.union(more)
    pairs = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    release(df.sparkSession)

    texts = written(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "texts")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [edit_within(a, b, int(_allowed(min(len(a), len(b)), edits))) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("value").alias("va")), "a").join(texts.select(F.col("key").alias("b"), F.col("value").alias("vb")), "b")
    linked = written(both.select("a", "b", "va", "vb").mapInArrow(close, "a long, b long"), "linked")

    links = linked.union(linked.select("b", "a")).toDF("key", "near").join(distinct.select(F.col("key").alias("near"), F.col("first").alias("near_first")), "near")
    links = links.select("key", "near_first")
    nearest = (links if certain is None else links.union(certain)).groupBy("key").agg(F.min("near_first").alias("near_first"))
    earliest = distinct.select("key", "other", "first", "copies").join(nearest, "key", "left").withColumn("earliest", F.least("first", "near_first"))
    earliest = written(earliest.where("copies > 1 or near_first < first").select("key", "other", "earliest"), "earliest")
    dropped = places.select("id", "line", "key", "other").join(earliest, ["key", "other"]).where(F.col("earliest") < F.struct("id", "line"))
    return dropped.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("line", F.col("earliest.id").alias("first_id"), F.col("earliest.line").alias("first_line")))).alias("dropped"))


OUTPUTS = ("n_lines", "n_dropped", "dropped")


def _rebuilt(df: DataFrame, id_col: str, text: str, edits: Edits, min_chars: int, broadcast_docs: int) -> DataFrame:
    """(row, text, n_lines, n_dropped, dropped) with each row of ``df`` as a struct, so no name of its columns can clash."""
    drops = written(_decisions(df, id_col, text, edits, min_chars, broadcast_docs), "drops").withColumnRenamed("id", "drop_id")
    row = F.col("row")
    joined = df.select(F.struct(*(df[c] for c in df.columns)).alias("row")).join(drops, row[id_col].eqNullSafe(F.col("drop_id")), "left")
    joined = joined.select("row", row[text].alias("text"), "dropped", F.transform("dropped", lambda d: d["line"]).alias("gone"))
    stay = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr("array_join(filter(split(text, '\\n', -1), (l, i) -> not array_contains(gone, i)), '\\n')"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return joined.select("row", stay.alias("text"), n_lines.alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"), "dropped")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", edits: Edits = EDITS, min_chars: int = MIN_CHARS, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """``df`` with the text rebuilt from the lines that stay, and n_lines, n_dropped and dropped (line, first_id, first_line).

    Columns of ``df`` of these three names give way to them.
    """
    done = _rebuilt(df, id_col, text, edits, min_chars, broadcast_docs)
    own = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns if c not in OUTPUTS]
    return done.select(*own, *OUTPUTS)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", chars: str | None = "n_chars", edits: Edits = EDITS, min_chars: int = MIN_CHARS, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """``df`` with the deduplicated texts; rows that lost every line go, and ``chars`` counts the new text.

    Rows without a dropped line stay as they are, with a null or empty text
    too; the columns are those of ``df`` whatever their names; an empty table
    stays empty.
    """
    done = _rebuilt(df, id_col, text, edits, min_chars, broadcast_docs).where(~((F.col("n_dropped") > 0) & (F.length(F.trim(F.col("text"))) == 0)))
    size = lambda c: F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row")[c]).cast(df.schema[c].dataType)
    return done.select(*(F.col("text").alias(c) if c == text else size(c).alias(c) if c == chars else F.col("row")[c].alias(c) for c in df.columns))
