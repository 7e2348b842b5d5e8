import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from bandwright.llm import op4_lines, op7_quality, op9_neardup, textscan as ts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x85 #🙂A.", max_size=60)), max_size=6)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_lines_and_hashes(texts):
    seen = {}
    rows = 0
    for a, b, t in ts.slices(pa.array(texts, pa.string()), size=40):
        assert (a, b - a) == (rows, t.n)
        rows = b
        starts, ends, first = t.words()
        ls, le, lf = t.lines()
        hashes = ts.hash_ranges(t.data, starts, ends)
        for i in range(t.n):
            text = texts[a + i] or ""
            words = [bytes(t.data[s:e]).decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert words == WORD.findall(text)
            assert [bytes(t.data[s:e]).decode() for s, e in zip(ls[lf[i] : lf[i + 1]], le[lf[i] : lf[i + 1]], strict=True)] == text.split("\n")
            for w, h in zip(words, hashes[first[i] : first[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def brute_counts(text):
    text = text or ""
    words, seen, lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n#|", max_size=120), st.lists(st.sampled_from("ab"), max_size=60).map(" ".join)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_quality_counts(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["en"] * len(texts)), pa.array(texts, pa.string())], ["id", "lang", "text"])
    got = [r for part in op7_quality.measure(iter([batch])) for r in part.to_pylist()]
    assert [[r[c] for c in op7_quality.COUNTS] for r in got] == [brute_counts(t) for t in texts]
    assert [sum(r["chars"]) for r in got] == [len(t or "") for t in texts] and [sum(r["commons"]) for r in got] == [brute_counts(t)[0] for t in texts]


@given(st.lists(st.text(alphabet="ab C", max_size=30), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_shingles_and_sketches(texts):
    (_, _, t), = ts.slices(pa.array(texts, pa.string()), lower=True)
    owner, hashes, k0, _ = op9_neardup.shingles(t, 2)
    for i, text in enumerate(texts):
        w = WORD.findall(text.lower())
        want = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
        assert (owner == i).sum() == len(want)
        assert all((k0[i] == k0[j]) == (w == WORD.findall(o.lower())) for j, o in enumerate(texts))
    sketch = op9_neardup.sketch(owner, hashes, t.n, 40)
    assert ((sketch != op9_neardup.FULL).all(axis=1) == (np.bincount(owner, minlength=t.n) > 0)).all()


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = op9_neardup.sketch(np.repeat([0, 1], 900), np.concatenate([a, b]), 2, 1000)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="abé", max_size=10), st.text(alphabet="abé", max_size=10))
@settings(max_examples=400, deadline=None)
def test_banded_edit_distance(a, b):
    for k in range(4):
        assert op4_lines.edit_within(a, b, k) == (edit(a, b) <= k)


@given(st.text(alphabet="abcdé", min_size=40, max_size=60), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 39), st.sampled_from("xyz")), max_size=3), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_close_lines_share_a_key_at_every_depth(a, edits, k):
    b = list(a)
    for kind, at, c in edits[:k]:
        if kind == 0:
            b[at] = c
        elif kind == 1:
            b.insert(at, c)
        else:
            b.pop(at)
    b = "".join(b)
    if len(b) < 40 or a == b:
        return
    (_, _, t), = ts.slices(pa.array([a, b]))
    x = op4_lines.Lines(t, 40)
    h, at, own = x.segments(((40, k),), False)
    known, cuts = np.zeros(0, np.uint64), {}

    def meet(h, line, own):
        keys = [(set(h[(line == i) & own]), set(h[line == i])) for i in (0, 1)]
        return keys[0][0] & keys[1][1] | keys[1][0] & keys[0][1]

    for depth in range(1, 5):
        lines, states = op4_lines.line_states(t, ((40, k),), (np.repeat([0, 1], len(known)), np.tile(known, 2)), cuts, depth)
        if depth == 1:
            assert set(zip(h, at, own)) == set(zip(states.h, states.line, states.own))
        done = op4_lines.is_settled(states)
        if meet(*op4_lines.settled(lines, states.where(done))):
            assert edit(a, b) <= k
            return
        left = states.where(~done)
        assert meet(left.h, left.line, left.own)
        cuts |= {int(i): np.zeros((depth + 1, 2), np.int64) for i in left.h.view(np.int64)}
        known = np.append(known, left.h)


@given(st.text(alphabet="ab", max_size=3), st.text(alphabet="ab", max_size=6), st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_settled_parts_are_within_their_edits(own, other, budget):
    """A part of the index line, no longer than its edits, agrees in some choice of characters exactly if it is within them."""
    if len(own) > budget:
        return
    chosen = any(all(own[i] == other[j] for i, j in zip(s, t, strict=True)) for s, t in op4_lines._alignments(len(own), len(other), budget))
    assert chosen == (edit(own, other) <= budget)
