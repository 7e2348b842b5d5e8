"""Operators 11 to 13: edge cases, and brute-force versions."""

import collections
import hashlib
import math
import random
import re
import tempfile
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from bandwright.llm import induced, op11_trie, op12_repeats, op13_resample, order

SCHEMA = "doc_id long, text string, lang string, n_words long, rank int, score string, id int"
LONG = "the cat sat on a mat and " * 4000
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "same text here, twice over and over, and long enough to be a passage of its own"), (5, "same text here, twice over and over, and long enough to be a passage of its own"), (None, "no id"), (6, "🙂 é"), (7, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", 0) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11
def trie(turns):
    """What the contract says, from rows (conv, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, t, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    children = collections.Counter(n[:-1] for n in nodes if n)
    saved = {n: (len(m) - 1) * (len(n[-1][1]) if n else 0) for n, m in nodes.items()}
    leaves, sums = collections.Counter(), collections.Counter()
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            sums[n[:d]] += saved[n]
    ends = {n: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(n)))) for n, m in nodes.items()}
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), children[n], leaves[n], sums[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


TURNS = "conv_id long, turn long, role string, text string, c int, d int, node string"


def conversations(n, longest):
    random.seed(n)
    out = []
    for c in random.sample(range(700), n):
        out += [(c, t, random.choice(["user", "assistant", None]), random.choice(["a", "b", "é🙂", "", None])) for t in range(random.randint(1, longest))]
    return out + [(100, t, "user", "long") for t in range(40)] + [(None, 0, "user", "lost"), (105, None, "system", "first")]


@pytest.mark.parametrize("local", [1 << 16, 7])
def test_trie(spark, local):
    turns = conversations(80, 6)
    df = spark.createDataFrame([(*t, 1, 2, "x") for t in turns], TURNS)
    assert rows_of(op11_trie.prefix_trie(df, local=local)) == trie(turns)


def test_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op11_trie, "PIECE", 4)
    turns = conversations(30, 20)
    assert rows_of(op11_trie.prefix_trie(spark.createDataFrame([(*t, 1, 2, "x") for t in turns], TURNS))) == trie(turns)
    assert op11_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_list_rank(spark):
    random.seed(4)
    places = random.sample(range(10_000), 500)
    df = spark.createDataFrame([(a, b, a % 7) for a, b in zip(places, [*places[1:], None])], "arc long, next long, w long")
    want, total = {}, 0
    for a in places:
        want[a] = total
        total += a % 7
    assert {r.arc: r.w for r in op11_trie.list_rank(df, ["w"], 10).collect()} == want


# ---- 12
def test_induced_sorting_is_sorting():
    random.seed(1)
    for _ in range(400):
        n, k, cap = random.choice([1, 2, 3, 8, 60, 200]), random.choice([1, 2, 5, 50]), random.choice([1, 3, 50, 255])
        x = [random.randint(1, k) for _ in range(n)]
        if random.random() < 0.4:
            x = (x[: n // 3 + 1] * 4)[:n]
        x = np.array([*x, 0], np.uint32)
        found, shared = induced.suffix_order(x, cap, random.choice([1 << 26, 64, 1000]))
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert sorted(found.tolist()) == sorted(want) and all((x[i : i + cap] == x[j : j + cap]).all() for i, j in zip(found, want, strict=True))
        lengths = [0]
        for i, j in zip(want, want[1:], strict=False):
            m = 0
            while m < cap and max(i, j) + m < len(x) and x[i + m] == x[j + m]:
                m += 1
            lengths.append(m)
        assert shared.tolist() == lengths


def test_queues_go_to_disk():
    spills = []
    induced.suffix_order(np.append(np.random.default_rng(2).integers(1, 9, 20_000), 0).astype(np.uint16), 50, 1 << 14, spills)
    assert spills[0] > 10


def removed(rows, width):
    first = {}
    for i, t in rows:
        i, b = -1 if i is None else i, (t or "").encode()
        for p in range(len(b) - width + 1):
            first[b[p : p + width]] = min(i, first.get(b[p : p + width], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (-1 if i is None else i):
                gone[p : p + width] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


def kept(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op12_repeats.without_repeats(df, **options).collect())


def test_repeats_of_edge_cases(spark, edges, nothing):
    assert kept(edges) == removed(EDGES, 50)
    assert op12_repeats.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "block_bytes": 700, "budget": 2000}, {"width": 70, "block_bytes": 1500}])
def test_repeats_of_copied_passages(spark, options):
    random.seed(9)
    words = ["".join(random.choice("abcdeé ") for _ in range(random.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(random.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [random.choice([random.choice(passages), " ".join(random.choice(words) for _ in range(8))]) for _ in range(random.randint(0, 4))]
        text = "\n".join(parts)
        if text and random.random() < 0.3:
            at = random.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((random.randint(0, 50) if i else None, text or None))
    rows += [(90 + i, " " * 300) for i in range(3)] + [(200 + i, passages[0]) for i in range(20)]
    df = spark.createDataFrame([(i, t, "", 0, 0, "", 0) for i, t in rows], SCHEMA).repartition(3)
    assert kept(df, **options) == removed(rows, options.get("width", 50))


def test_answers_of_a_shard(monkeypatch):
    """Each window gets the least id of its string; numpy is called for a shard, not for each of its pieces; 16-bit keys sort as wider ones."""
    random.seed(4)
    texts = sorted({"".join(random.choices("ab", k=random.randint(6, 12))).encode() for _ in range(400)})
    asks = np.zeros(len(texts), op12_repeats.ASK)
    asks["s"], asks["first"], asks["size"] = np.arange(len(texts)), random.sample(range(-500, 500), len(texts)), [len(t) for t in texts]
    table = pa.table({"shard": [1], "block": [2], "x": pa.array([asks.tobytes()], pa.binary()), "bytes": pa.array([b"".join(texts)], pa.binary())})
    calls = []
    diff = np.diff
    monkeypatch.setattr(np, "diff", lambda *a, **b: calls.append(1) or diff(*a, **b))
    raw = op12_repeats.runs_of(table, 6, 1 << 26)["x"][0].as_py()
    least = {}
    for t, first in zip(texts, asks["first"].tolist(), strict=True):
        for i in range(len(t) - 5):
            least[t[i : i + 6]] = min(first, least.get(t[i : i + 6], first))
    for t in texts:
        run = np.frombuffer(raw, op12_repeats.RUN, raw[0], 1)
        assert np.repeat(run["first"], run["n"]).tolist() == [least[t[i : i + 6]] for i in range(len(t) - 5)]
        raw = raw[1 + run.nbytes :]
    assert not raw and len(calls) < 100 < len(texts)
    for most in (200, 65_535, 65_536, 1 << 40):
        keys = np.array([random.choice([0, 5, most]) for _ in range(50)])
        assert (induced.stable(keys, most) == np.argsort(keys, kind="stable")).all()


@pytest.mark.parametrize("budget", [1 << 26, 1000])
def test_narrow_and_wide_positions(monkeypatch, budget):
    """32-bit positions, ranks and tuples order suffixes as 64-bit ones do, with any size of chunk, in memory and on disk."""
    x = np.append(np.tile(np.random.default_rng(3).integers(1, 5, 700), 3), 0).astype(np.uint16)
    kinds = [a.dtype.itemsize for a in induced.suffix_order(x, 50, budget)]
    narrow = [a.tolist() for a in induced.suffix_order(x, 50, budget)]
    monkeypatch.setattr(induced, "CHUNK", 64)
    assert [a.tolist() for a in induced.suffix_order(x, 50, budget)] == narrow
    monkeypatch.setattr(induced, "WIDE", 0)
    assert [a.tolist() for a in induced.suffix_order(x, 50, budget)] == narrow and kinds == [4, 1]


def test_memory_of_a_shard():
    """What a shard takes for each byte and entry, traced; a queue counts what its views keep, and a worker gives back what it has freed."""
    rng = np.random.default_rng(5)
    asks = np.zeros(12_000, op12_repeats.ASK)
    asks["s"], asks["first"], asks["size"] = np.arange(len(asks)), rng.integers(0, 5000, len(asks)), 60
    raw = rng.integers(97, 123, 60 * len(asks)).astype(np.uint8)
    raw[: len(raw) // 4] = raw[len(raw) // 2 :][: len(raw) // 4]  # passages of others
    table = pa.table({"shard": [1], "block": [2], "x": pa.array([asks.tobytes()], pa.binary()), "bytes": pa.array([raw.tobytes()], pa.binary())})
    entries = np.zeros(60_000, op12_repeats.ENTRY)
    entries["s"], entries["a"], entries["first"] = rng.integers(0, 50_000, len(entries)), rng.integers(0, 40_000, len(entries)), rng.integers(0, 9, len(entries))
    sent = pa.table({"shard": [1], "block": [2], "x": pa.array([op12_repeats.packed_entries(entries)], pa.binary())})
    tracemalloc.start()
    try:
        peaks = []
        for f in (lambda: op12_repeats.runs_of(table, 50, 1 << 27), lambda: op12_repeats.codes_of(sent)):
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            f()
            peaks.append(tracemalloc.get_traced_memory()[1] - before)
    finally:
        tracemalloc.stop()
    assert peaks[0] < 60 * len(raw) and peaks[1] < 120 * len(entries), (peaks[0] / len(raw), peaks[1] / len(entries))
    with tempfile.TemporaryDirectory() as folder:
        queue = induced.Queue(induced.Disk(folder, 1000), 2)
        for _ in range(4):  # bin 0 is taken at once, bin 1 keeps the arrays
            queue.push(np.append(np.zeros(29, int), 1), np.zeros((30, 2), np.int64))
            queue.pop(0, 1000)
        assert queue.disk.spilled and len(queue.pop(1, 1000)) == 4
    op12_repeats.give_back()


def test_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(op12_repeats, "PART", 256)
    rows = [(1, LONG[:900] + "xyz" + LONG[:300]), (2, "q" * 400 + LONG[100:700]), (3, "ab" * 500)]
    data = [(i, np.frombuffer(t.encode(), np.uint8)) for i, t in rows]
    bounds = np.cumsum([0, *(len(b) for _, b in data)])
    x = op12_repeats.block_of(np.concatenate([b for _, b in data]), bounds, np.array([i for i, _ in rows]), 50, 3)
    windows = {p for s, n in zip(x.start.tolist(), x.windows.tolist(), strict=True) for p in range(s, s + n)}
    assert windows == {int(a) + p for a, (_, b) in zip(bounds, data, strict=False) for p in range(len(b) - 49)}


def test_entries_of_a_block(monkeypatch):
    """A shard's entries lie together, each once, with the least id; hashes of neighbours are those of ranges; no suffix is searched for."""
    random.seed(6)
    rows = [(random.randrange(99), random.choice([LONG[:300], LONG[7:400]]) + "".join(random.choices("abcdef", k=200))) for _ in range(30)]
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    bounds, ids = np.cumsum([0, *map(len, data)]), np.array([i for i, _ in rows])
    x = op12_repeats.block_of(np.concatenate(data), bounds, ids, 50, 7)
    assert len(set(x.shards.tolist())) == len(x.shards) > 1 and x.cuts[-1] == len(x.entries) == len(set(x.entries["s"].tolist()))
    for e in range(len(x.entries)):
        own = ids[x.doc[x.entry == e]]
        assert x.entries["first"][e] == own.min() and x.entries["many"][e] == (own.min() != own.max())
    total = op12_repeats.ts.prefix_hashes(data[0])
    at = np.arange(len(data[0]) - 19)
    assert (op12_repeats.ts.hash_neighbours(total, 20) == op12_repeats.ts.hash_between(total, at, at + 20)).all()
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: searched.append(np.size(v)) or search(a, v, *more))
    asks = np.zeros(50, op12_repeats.ASK)
    asks["s"], asks["size"] = np.arange(50), 60
    raw = "".join(random.choices("abcdef", k=3000)).encode()
    op12_repeats.runs_of(pa.table({"shard": [1], "block": [2], "x": pa.array([asks.tobytes()], pa.binary()), "bytes": pa.array([raw], pa.binary())}), 50, 1 << 26)
    assert sum(searched) < 100


def test_entries_survive_packing():
    e = np.zeros(3, op12_repeats.ENTRY)
    for ids in ([5, 6, 7], [-9, 1 << 40, 3], [op12_repeats.NO_ID, (1 << 63) - 1, 0]):
        e["first"], e["s"], e["a"], e["many"] = ids, [1, 2, 1 << 63], [9, 8, 7], [1, 0, 1]
        assert (op12_repeats.unpacked_entries(op12_repeats.packed_entries(e)) == e).all()


# ---- 13
FEATURE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(rows, target, n):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n)))) for b in range(n)}
    out = []
    for i, x in rows:
        words, found = features(x)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(drawn[: len(drawn) * 25 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("sample_rows", [0, 5, 1000])
def test_resampling(spark, sample_rows, monkeypatch):
    random.seed(6)
    words = [random.choice(["über", "The", "x9", "a", "naïve", "w" * 20, "q" * 90, "🙂"]) + str(random.randint(0, 9)) for _ in range(60)]
    rows = [(i, random.choice(["", " ", "-\n"]).join([""]) + random.choice([" ", ", ", "\n"]).join(random.choice(words) for _ in range(random.choice([0, 1, 19, 20, 90])))) for i in range(80)]
    rows += [(None, "no id at all"), (500, None), (501, "...")]
    df = spark.createDataFrame([(i, t, "", 0, 0, "", 0) for i, t in rows], SCHEMA).repartition(3)
    target = [" ".join(words[:30]), None, "The a"]
    wanted = resampled(rows, target, 97)
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted((tuple(r) for r in op13_resample.resample(df, frame, buckets=97, sample_rows=sample_rows).collect()), key=str) == wanted


def test_resampling_of_edge_cases(edges, nothing):
    got = op13_resample.resample(edges, edges)
    assert collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(i for i, _ in EDGES)
    assert op13_resample.resample(nothing, edges).count() == 0
    assert op13_resample.resample(edges, nothing).count() == len(EDGES)


def test_a_long_text_goes_in_pieces():
    import pyarrow as pa

    text = " ".join(f"w{i % 17}{'é' * (i % 5)}" for i in range(3000)) + "z" * 5000 + " end"
    head = op13_resample.head_of([b"w1"], [], 97)
    for size in (64, 1000, 1 << 20):
        total = collections.Counter()
        for owner, starts, ends, follows, data in op13_resample.pieces(pa.array([text]), size):
            word, pair = op13_resample.features(data, starts, ends, follows, head, 97)
            total.update(word[owner >= 0].tolist() + pair.tolist())
        assert total == collections.Counter(zlib.crc32(f.encode()) % 97 for f in features(text)[1])


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i,) for i in random.sample(range(1000), 1000)], "i long").repartition(7)
    assert all(r.i == r.n for r in order.numbered(df, ["i"], "n").collect())
