"""Suffix order with common prefixes by induced sorting, in memory that does not grow with the text.

``suffix_order`` sorts all suffixes of an array of symbols that ends in a symbol
0 of which there is no other. As in all induced sorting, the suffixes that start
a rise (S*: an S-type after an L-type) are sorted first, by naming the stretches
between them and sorting the string of names by recursion, or in memory once the
names fit there. From their order the L-types follow in a scan upwards and the S-types in a scan downwards: whatever is
scanned puts the suffix that begins one symbol earlier into a priority queue.

The queue is bulk and disk-backed. It takes tuples (symbol, position, common
prefix) and gives them back by symbol, first in, first out. Symbols are dealt into
bins of about ``window`` tuples; a bin is appended to, spilled to a file when
the queue holds more than ``budget`` bytes, and sorted when its turn comes. A step
takes the longest run of tuples from the front that none of its own successors
would precede: for n tuples with many symbols about the root of n at once.

The common prefix of two neighbours in a bin is one more than the least common
prefix between the two scanned suffixes that put them there, so the scan carries
it: within a step by a table of minima, across steps by what each symbol saw last.
Between the L- and S-types of a symbol it is the shorter of their two runs of that
symbol. The order of the names comes back from the recursion with the number of
equal names, which gives the common prefix of the S* suffixes up to the first
unequal stretch. All are cut off at ``cap``.

Arrays as long as the text are files (memory maps) beyond ``budget`` bytes.
Positions and tuples have 32-bit numbers where text and symbols allow it, and what is made for them on
the way is made ``CHUNK`` symbols at a time.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field

import numpy as np

from bandwright.llm import textscan as ts

NO_TUPLES = np.zeros((0, 2), np.uint32)  # a tuple is (symbol << 8 | common prefix, position)
CHUNK = 1 << 18
#: Symbols from which on positions have 64 bits.
WIDE = 1 << 30
#: Bytes for each name that sorting in memory takes.
IN_MEMORY = 64
FAR = np.iinfo(np.int64).max


def stable(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys from 0 to ``most``: 16 bits are sorted by digits."""
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


@dataclass
class Disk:
    """Where arrays and queues go that are larger than ``budget`` bytes."""

    folder: str
    budget: int
    n: int = 0
    spilled: int = 0

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.folder, f"{self.n}")

    def space(self, n: int, kind: type | str) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.budget:
            return np.zeros(n, kind)
        self.spilled += 1
        path = self.path()
        found = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the space is given back with the array
        return found


@dataclass
class Queue:
    """A priority queue of tuples by bin: first in, first out within a bin; its blocks are in memory or in one file.

    A block is a view of what was pushed with it, which stays whole while one block of
    it does: ``held`` is what was pushed since the queue was last spilled.
    """

    disk: Disk
    bins: int
    kind: type = np.int64
    blocks: list[list] = field(default_factory=list)
    held: int = 0
    file: object = None

    def __post_init__(self):
        self.blocks = [[] for _ in range(self.bins)]

    def push(self, bins: np.ndarray, tuples: np.ndarray) -> None:
        order = stable(bins, self.bins)
        bins, tuples = bins[order], tuples[order]
        cuts = np.flatnonzero(bins[1:] != bins[:-1]) + 1
        for to, a, b in zip(bins[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(bins)], strict=True):
            self.blocks[to].append(tuples[a:b])
        self.held += tuples.nbytes
        if self.held > self.disk.budget:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            path = self.disk.path()
            self.file = open(path, "w+b")
            os.unlink(path)
        self.disk.spilled += 1
        self.file.seek(0, 2)
        for blocks in self.blocks:
            held = [b for b in blocks if isinstance(b, np.ndarray)]
            if held:
                joined = np.concatenate(held)
                blocks[:] = [b for b in blocks if not isinstance(b, np.ndarray)] + [(self.file.tell(), len(joined))]
                joined.tofile(self.file)
        self.held = 0

    def pop(self, bin_: int, least: int) -> np.ndarray:
        """The bin's first blocks, of at least so many tuples if it has them."""
        blocks, n, size = self.blocks[bin_], 0, 0
        while n < len(blocks) and size < least:
            size += len(blocks[n]) if isinstance(blocks[n], np.ndarray) else blocks[n][1]
            n += 1
        taken, self.blocks[bin_] = blocks[:n], blocks[n:]
        out = []
        for b in taken:
            if not isinstance(b, np.ndarray):
                self.file.seek(b[0])
                b = np.fromfile(self.file, self.kind, 2 * b[1]).reshape(-1, 2)
            out.append(b)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else NO_TUPLES


class Minima:
    """Least values over ranges of an array of bytes."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(values) > 1 << len(self.levels) - 1 and len(self.levels[-1]) > 1 << len(self.levels) - 1:
            step = 1 << len(self.levels) - 1
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.uint8)
        level = np.log2(last - first + 1).astype(np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << k) + 1])
        return out


class Carried:
    """The least common prefix of all that was scanned since each symbol's last push."""

    def __init__(self, disk: Disk, symbols: int, cap: int):
        self.cap, self.step = cap, 0
        self.seen = disk.space(symbols, np.int64)  # the step of the last push, from 1
        self.tail = disk.space(symbols, np.uint8)  # least from there to the end of its step
        self.open = 0  # steps from here on have no zero in them
        self.mins: list[int] = []

    def pushed(self, lcp: np.ndarray, at: np.ndarray, z: np.ndarray) -> np.ndarray:
        """For pushes of symbols ``z`` from places ``at`` of a step with prefixes ``lcp``: the common prefix with the symbol's push before."""
        self.step += 1
        table = Minima(lcp)
        order = stable(z, len(self.seen))
        zs, places = z[order], at[order]
        again = np.zeros(len(zs), bool)
        again[1:] = zs[1:] == zs[:-1]
        least = np.zeros(len(zs), np.int64)
        k = np.flatnonzero(again)
        least[k] = table.least(places[k - 1] + 1, places[k]).astype(np.int64) + 1
        k = np.flatnonzero(~again)
        seen = self.seen[zs[k]]
        between = np.zeros(len(k), np.int64)
        recent = seen >= self.open
        if self.mins and recent.any():
            suffix = np.minimum.accumulate(np.array([self.cap, *reversed(self.mins)]))[::-1]  # of the steps after one
            between[recent] = suffix[seen[recent] - self.open]
        elif not self.mins:
            between[recent] = self.cap
        head = np.minimum.accumulate(lcp)[places[k]].astype(np.int64) if len(lcp) else np.zeros(0, np.int64)
        least[k] = np.where(seen == 0, 0, np.minimum(np.minimum(between, self.tail[zs[k]]), head) + 1)
        last = np.append(np.flatnonzero(~again)[1:], len(zs)) - 1 if len(zs) else np.zeros(0, np.int64)
        end = len(lcp) - 1
        tails = np.full(len(last), self.cap, np.int64)
        inner = np.flatnonzero(places[last] < end)
        tails[inner] = table.least(places[last[inner]] + 1, np.full(len(inner), end))
        self.seen[zs[last]], self.tail[zs[last]] = self.step, tails
        if not lcp.all():
            self.open, self.mins = self.step, []
        else:
            self.mins.append(int(lcp.min()))
        out = np.zeros(len(z), np.uint8)
        out[order] = np.minimum(least, self.cap)
        return out


def doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The recursion's base case, for names that fit in memory: their suffixes by the first ``cap`` names, and the common prefixes.

    Ranks of the first h names make ranks of the first 2h. A suffix's common
    prefix with the one before is put together from the steps, largest first.
    """
    n, h = len(names), 1
    ranks = [names.astype(np.uint32)]
    while h < cap:
        key = ranks[-1].astype(np.uint64)
        key *= np.uint64(n + 2)
        key[:-h] += ranks[-1][h:]
        key[:-h] += np.uint64(1)
        order = np.argsort(key)  # equal keys get one rank in any order
        key = key[order]
        new = np.zeros(n, bool)
        new[1:] = key[1:] != key[:-1]
        del key
        rank = np.zeros(n, np.uint32)
        rank[order] = np.cumsum(new, dtype=np.uint32)
        ranks.append(rank)
        h *= 2
    order = np.argsort(ranks[-1], kind="stable")
    out = np.zeros(n, np.uint8)
    for at in range(1, n, CHUNK):
        a, b = order[at - 1 : at + CHUNK - 1], order[at : at + CHUNK]
        a, shared = a[: len(b)], np.zeros(len(b), np.int64)
        for k, rank in reversed(list(enumerate(ranks[:-1]))):
            shared += np.where(rank[np.minimum(a + shared, n - 1)] == rank[np.minimum(b + shared, n - 1)], 1 << k, 0)
        shared[ranks[-1][a] == ranks[-1][b]] = cap
        out[at : at + CHUNK] = np.minimum(shared, cap)
    return order, out


class Text:
    """An array of symbols with the types of its suffixes and the lengths of its runs."""

    def __init__(self, symbols: np.ndarray, cap: int, disk: Disk):
        self.symbols, self.n, self.cap, self.disk = symbols, len(symbols), cap, disk
        self.size, self.place = int(symbols.max()) + 1, np.int32 if len(symbols) < WIDE else np.int64
        self.s_type, self.run = disk.space(self.n, np.uint8), disk.space(self.n, np.uint8)
        self.s_type[-1] = self.run[-1] = 1
        rises, run = 1, 0  # of the symbol after the chunk
        for b in range(self.n - 1, 0, -CHUNK):
            a = max(0, b - CHUNK)
            part = symbols[a : b + 1]
            turns = np.flatnonzero(part[:-1] != part[1:])
            up = (part[turns] < part[turns + 1]).astype(np.uint8)
            ends = np.append(turns, b - a)
            lengths = np.diff(ends, prepend=-1)
            lengths[-1] = b - a - (int(turns[-1]) + 1 if len(turns) else 0)
            self.s_type[a:b] = np.repeat(np.append(up, rises), lengths)
            to_end = np.repeat(np.where(np.arange(len(ends)) < len(turns), ends, b - a + int(self.run[b]) - 1), lengths) - np.arange(b - a) + 1
            self.run[a:b] = np.minimum(to_end, 255)
            rises, run = self.s_type[a], self.run[a]
        starts = [(a + np.flatnonzero((self.s_type[a + 1 : a + CHUNK + 1] == 1) & (self.s_type[a : a + CHUNK][: len(self.s_type[a + 1 : a + CHUNK + 1])] == 0)) + 1).astype(self.place) for a in range(0, self.n, CHUNK)]
        self.lms = np.concatenate(starts)

    def induce(self, s_type: int, seeds: np.ndarray, seed_lcp: np.ndarray | None, everything: bool) -> tuple[np.ndarray, np.ndarray]:
        """(positions, common prefix with the one before) of all suffixes of a type from the order of the ``seeds``; with ``everything`` the seeds among them.

        L-types are induced upwards. S-types are induced downwards, as the same scan over mirrored symbols.
        """
        disk, bin_size, window = self.disk, max(512, int(self.n**0.5)), max(1 << 15, 2 * int(self.n**0.5))
        take = window
        mirrored = (lambda x: self.size - 1 - x.astype(np.int64)) if s_type else (lambda x: x.astype(np.int64))
        count = np.zeros(self.size, np.int64)
        for a in range(0, self.n, CHUNK):
            own = self.symbols[a : a + CHUNK][self.s_type[a : a + CHUNK] == s_type]
            count += np.bincount(own, minlength=self.size)
        if s_type:
            count = count[::-1]
        heavy = count > bin_size
        part = (np.cumsum(count) - count) // bin_size
        new = np.ones(self.size, bool)
        new[1:] = (part[1:] != part[:-1]) | heavy[1:] | heavy[:-1]
        bin_of = np.cumsum(new) - 1
        bins = int(bin_of[-1]) + 1
        many = ~np.zeros(bins, bool)
        many[bin_of[heavy]] = False
        kind = np.uint32 if self.place is np.int32 and self.size < 1 << 24 else np.int64
        queue, carried = Queue(disk, bins, kind), Carried(disk, self.size, self.cap) if seed_lcp is not None else None
        total = int(count.sum()) - s_type + (len(seeds) if everything else 0)  # the last symbol's own suffix is never pushed
        order, prefix = disk.space(total, self.place), disk.space(total, np.uint8)
        made, at = 0, 0
        last_sym, last_pos, last_seed = -1, 0, False
        seed_bins = self._ends(seeds, bin_of, mirrored, bins)
        for b in range(bins):
            front = NO_TUPLES
            while True:
                if not len(front) and queue.blocks[b]:
                    front = queue.pop(b, self.n if many[b] else window)
                    if many[b]:
                        front = front[stable(front[:, 0] >> 8, self.size)]
                if not len(front) and at == seed_bins[b]:
                    break
                some, own = front[:take], seeds[at : min(at + take, seed_bins[b])]
                if many[b] or not len(some):
                    key = np.concatenate([some[:, 0] >> 8 << 1, 2 * mirrored(self.symbols[own]) + 1])
                    turn = stable(key, 2 * self.size)[:take]
                else:  # of one symbol: the tuples come first, all of them
                    own = own[:0]
                    key, turn = some[:, 0] >> 8 << 1, np.arange(len(some))
                key = key[turn]
                pos = np.concatenate([some[:, 1], own])[turn]
                before = pos - 1  # of suffix 0 the last symbol, which is S-type and larger than none
                z = mirrored(self.symbols[before])
                puts = (self.s_type[before] == s_type) & (pos > 0)
                lands = np.minimum.accumulate(np.where(puts, z + z, FAR))
                late = key[1:] > lands[:-1]
                n = int(late.argmax()) + 1 if late.any() else len(key)
                take = min(window, max(256, 2 * n))
                turn, pos, puts, z = turn[:n], pos[:n], puts[:n], z[:n]
                is_seed = turn >= len(some)
                lcp = None
                if carried is not None:
                    lcp = np.concatenate([(some[:, 0] & 255).astype(np.uint8), seed_lcp[at : at + len(own)]])[turn]
                    sym = key[:n] >> 1
                    was_seed, was_sym, was_pos = np.append(last_seed, is_seed[:-1]), np.append(last_sym, sym[:-1]), np.append(last_pos, pos[:-1])
                    k = np.flatnonzero(is_seed & ~was_seed & (was_sym == sym))
                    lcp[k] = np.minimum(np.minimum(self.run[was_pos[k]], self.run[pos[k]]), self.cap)
                    lcp[was_sym != sym] = 0
                    last_sym, last_pos, last_seed = int(sym[-1]), int(pos[-1]), bool(is_seed[-1])
                who = np.flatnonzero(puts)
                tuples = np.stack([z[who] << 8, pos[who] - 1], axis=1)
                if carried is not None:
                    tuples[:, 0] |= carried.pushed(lcp, who, z[who])
                tuples = tuples.astype(kind)
                front, at = front[int((~is_seed).sum()) :], at + int(is_seed.sum())
                to = bin_of[z[who]]
                here = to == b
                if (~here).any():
                    queue.push(to[~here], tuples[~here])
                if here.any():
                    if queue.blocks[b]:  # a bin of one symbol that is read block by block
                        queue.push(to[here], tuples[here])
                    else:
                        front = np.concatenate([front, tuples[here]])
                        if many[b]:
                            front = front[stable(front[:, 0] >> 8, self.size)]
                keep = slice(None) if everything else ~is_seed
                out = pos[keep]
                order[made : made + len(out)] = out
                if lcp is not None:
                    prefix[made : made + len(out)] = lcp[keep]
                made += len(out)
        return order[:made], prefix[:made]

    def _ends(self, seeds: np.ndarray, bin_of: np.ndarray, mirrored, bins: int) -> np.ndarray:
        count = np.zeros(bins, np.int64)
        for a in range(0, len(seeds), CHUNK):
            count += np.bincount(bin_of[mirrored(self.symbols[seeds[a : a + CHUNK]])], minlength=bins)
        return np.cumsum(count)

    def from_seeds(self, seeds: np.ndarray, lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(all suffixes but the last symbol's, common prefix with the one before), downwards: the largest first."""
        falls, prefix = self.induce(0, seeds, lcp, False)
        # downwards, the prefix shared with the one before is what the one after it shared with it
        down = None if lcp is None else np.append(np.zeros(1, np.uint8), prefix[:0:-1])
        return self.induce(1, falls[::-1], down, True)

    def names(self, ordered: np.ndarray) -> tuple[np.ndarray, int]:
        """(name of each S* stretch in text order, number of names), from the numbers of the stretches in sorted order."""
        n = len(self.lms)
        size = np.diff(self.lms, append=self.place(self.n))
        hashes = self.disk.space(n, np.uint64)
        for a in range(0, n, CHUNK):
            lms = self.lms[a : a + CHUNK]
            begin, end = int(lms[0]), int(lms[-1] + size[a : a + CHUNK][-1])
            place = np.arange(end - begin) - np.repeat(lms - begin, size[a : a + CHUNK])
            up, _ = ts.powers(int(place.max()) + 2)
            own = np.add.reduceat((self.symbols[begin:end].astype(np.uint64) + np.uint64(1)) * up[place], lms - begin)
            follow = self.symbols[np.minimum(lms + size[a : a + CHUNK], self.n - 1)].astype(np.uint64)
            hashes[a : a + CHUNK] = ts.mix(ts.mix(own + size[a : a + CHUNK].astype(np.uint64) * np.uint64(ts.BASE)) + follow)
        out, last, before = self.disk.space(n, np.uint32), -1, None
        for a in range(0, n, CHUNK):
            which = ordered[a : a + CHUNK]
            own = hashes[which]
            new = np.append(before is None or own[0] != before, own[1:] != own[:-1])
            rank = np.cumsum(new) + last
            out[which], last, before = rank, int(rank[-1]), own[-1]
        return out, last + 1

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The common prefix of suffixes that share ``known`` symbols at least."""
        out = np.minimum(known, self.cap)
        at = np.flatnonzero(out < self.cap)
        while len(at):
            i, j = a[at] + out[at], b[at] + out[at]
            same = (np.maximum(i, j) < self.n) & (self.symbols[np.minimum(i, self.n - 1)] == self.symbols[np.minimum(j, self.n - 1)])
            at = at[same]
            out[at] += 1
            at = at[out[at] < self.cap]
        return out.astype(np.uint8)

    def sorted(self, carry: bool) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, common prefix with the one before); the queues carry the prefixes, or the names are compared afterwards."""
        n = len(self.lms)
        if n > 1:
            begin = self.lms[np.argsort(self.symbols[self.lms], kind="stable")]
            down, _ = self.from_seeds(begin, None)
            number = self.disk.space(self.n, np.uint32)  # of the stretch that starts there, from 1
            number[self.lms] = np.arange(1, n + 1)
            found = [x[x > 0][::-1] for x in (number[down[a : a + CHUNK]] for a in range(0, len(down), CHUNK))]
            ordered = np.concatenate([number[-1:], *found[::-1]]) - np.uint32(1)
            del begin, down, number, found
            names, number = self.names(ordered)
            del ordered
            if number == n:
                rank, equal = np.argsort(names, kind="stable"), np.zeros(n, np.uint8)
            elif n * IN_MEMORY <= self.disk.budget:
                rank, equal = doubled(names, (self.cap + 1) // 2)
            else:
                rank, equal = Text(names, (self.cap + 1) // 2, self.disk).sorted(False)  # a name is two symbols at least
            del names
            seeds = self.lms[rank]
            lcp = np.zeros(n, np.uint8)
            for a in range(1, n if carry else 0, CHUNK):
                part = slice(a, a + CHUNK)
                lcp[part] = self.common(seeds[a - 1 : a + CHUNK - 1][: len(seeds[part])], seeds[part], self.lms[rank[part] + equal[part].astype(np.int64)] - seeds[part])
            del rank, equal
        else:
            seeds, lcp = self.lms, np.zeros(n, np.uint8)
        down, prefix = self.from_seeds(seeds, lcp if carry else None)
        order, out = self.disk.space(self.n, self.place), self.disk.space(self.n, np.uint8)
        order[0], order[1:] = self.n - 1, down[::-1]
        if carry:
            out[2:] = prefix[:0:-1]
        else:
            for a in range(1, self.n, CHUNK):
                here = order[a : a + CHUNK]
                out[a : a + CHUNK] = self.common(order[a - 1 : a + CHUNK - 1][: len(here)], here, np.zeros(len(here), np.int64))
        return order, out


def suffix_order(symbols: np.ndarray, cap: int, budget: int = 1 << 26, spills: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of the prefix shared with the one before, at most ``cap``) of symbols whose last is the only 0.

    ``budget``: bytes that a queue or an array may have before it goes to disk,
    in the task's temporary folder; all of it is gone when the call's results are.
    """
    if not 1 <= cap <= 255:
        raise ValueError("cap must be from 1 to 255")
    if len(symbols) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        disk = Disk(folder, budget)
        found = Text(symbols, cap, disk).sorted(True)
        if spills is not None:
            spills.append(disk.spilled)
        return found
