"""The pipeline against a plain version, and the queries' SQL against DuckDB."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bandwright.llm import op4_lines, op5_mix, op7_quality, queries
from bandwright.llm.store import written

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours = queries.queries()[name](spark, DATA)
    theirs = con.sql(queries.oracle_sql()[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    a = sorted((tuple(r[c] for c in order) for r in ours.collect()), key=str)
    at = [theirs.columns.index(c) for c in order]
    assert a == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in op7_quality.quality(docs).collect()}
    seen: dict = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, DATA), name)
        if k < 4:
            assert docs.columns == columns
        got = {r.doc_id: r.asDict() for r in docs.collect()}
        if name == "quality_rules":
            rows = {i: t for i, t in rows.items() if verdict[i]}
            assert {i: r["text"] for i, r in got.items()} == rows
        elif name == "line_dedup":
            left = {}
            for i in sorted(rows):
                kept = []
                for line in rows[i].split("\n"):
                    long = len(line) >= op4_lines.MIN_CHARS and re.search(r"[0-9A-Za-z\x80-\U0010ffff]", line)
                    if long and (line in seen or any(_near(o, line) for o in seen)):
                        seen[line] = 1
                        continue
                    if long:
                        seen[line] = 1
                    kept.append(line)
                if kept == rows[i].split("\n") or "\n".join(kept).strip(" "):
                    left[i] = "\n".join(kept)
            assert {i: r["text"] for i, r in got.items()} == left
            assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if r["text"] != rows[i])
            rows = left
        elif name == "near_dedup":
            assert got.keys() <= rows.keys()
            sets = {i: _shingles(t) for i, t in rows.items()}
            for i in rows.keys() - got.keys():
                assert any(j != i and _alike(sets[i], sets[j]) for j in rows)
            assert not any(i < j and _alike(sets[i], sets[j]) for i in got for j in got)
            rows = {i: rows[i] for i in got}
        elif name == "decontamination":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r.text.split()) >= 8]
            leaked = {i for i, t in rows.items() if any(x in " ".join(t.split()) for x in items)}
            assert leaked and not leaked & got.keys() and len(rows) - len(got) <= len(leaked) + 2
            rows = {i: rows[i] for i in got}
        else:
            assert got.keys() == rows.keys()
            assert all(r["size"] == len(re.findall(op5_mix.WORD, rows[i])) and r["taken"] <= 2 * r["size"] for i, r in got.items())
    whole = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {i: r["taken"] for i, r in got.items()}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, dropped string, _gone int, n_dropped long, _hits int, hits int, row string, gone int, id int, key string, blob string"
GOOD = "It was a cold day in the north and the men of the town went out to the fields with their dogs to look for the lost sheep of the farm on the hill. "


def _clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "d", 1, 8, 2, 3, "r", 4, 5, "k", "b") for i, t in rows], CLASH)


@pytest.mark.parametrize("at", range(5), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, at):
    """Null and empty texts, repeated rows, a null id, an empty table, and columns whose names clash."""
    name, stage = corpus_pipeline.STAGES[at]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, GOOD + "one two three"), (4, GOOD + "one two three"), (5, GOOD + "one two three"), (None, "quite another text of the world, and so on it goes with it"), (6, "x " * 5000)]
    df = _clashing(spark, rows)
    done = stage(spark, df, DATA)
    got = [r.asDict() for r in done.collect()]
    assert stage(spark, df.limit(0), DATA).count() == 0
    if name == "source_mix":
        assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
        return
    assert done.columns == df.columns and all((r["dropped"], r["_gone"], r["n_dropped"], r["_hits"], r["row"]) == ("d", 1, 8, 2, "r") for r in got)
    ids = sorted((r["doc_id"] or 0 for r in got))
    want = {"quality_rules": [4, 4, 5], "line_dedup": [0, 1, 2, 3, 4, 4, 6], "near_dedup": [0, 1, 2, 3, 4, 4, 6], "decontamination": [0, 1, 2, 3, 4, 4, 5, 6]}[name]
    assert ids == want


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    from bandwright.llm.op9_neardup import one_of_each

    long, other = GOOD, "something else that nobody else has written so far, neither here nor there at all"
    got = one_of_each(_clashing(spark, [(1, long), (5, long), (5, other), (None, other + " "), (7, other)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, other + " "), (1, long)]


def _near(a, b):
    n = min(len(a), len(b))
    k = 0 if n < 40 else 2 if n < 100 else 3
    return k > 0 and abs(len(a) - len(b)) <= k and _distance_within(a, b, k)


def _distance_within(a, b, k):
    """Edit distance by the usual table, rows cut to the diagonals within k."""
    far = k + 1
    row = {j: j for j in range(min(k, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = min(i if j == 0 else far, row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]) if j else far)
        row = new
        if min(row.values()) > k:
            return False
    return row.get(len(b), far) <= k


def _shingles(text):
    w = [x.lower() for x in text.split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_language_is_learned(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = queries.op3_language_id(spark, data).where("held_out").join(docs, "doc_id").where("lang is not null")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98
