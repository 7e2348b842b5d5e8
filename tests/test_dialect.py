import pytest
from hypothesis import given
from hypothesis import strategies as st

from bandwright.functions.registry import UnknownFunction
from bandwright.plans import lex
from bandwright.plans.dialect import Dialect, UnresolvedLexical, Unsupported, to_spark_sql


def test_literals_are_never_rewritten():
    text = "SELECT 'NVL(a, b) (+) :P SYSDATE || x' AS t FROM t"
    assert "'NVL(a, b) (+) :P SYSDATE || x'" in to_spark_sql(text)


def test_nvl_in_code_is_rewritten():
    assert to_spark_sql("SELECT NVL(a, 0) FROM t") == "SELECT coalesce(a, 0) FROM t"


def test_outer_join_groups_edges_and_keeps_inner_predicates():
    out = to_spark_sql("SELECT 1 FROM a, b, c WHERE a.k = b.k(+) AND a.j = b.j(+) AND a.x = c.x")
    assert "LEFT JOIN b ON a.k = b.k AND a.j = b.j" in out and "WHERE a.x = c.x" in out


def test_outer_join_in_subquery_does_not_reach_the_outer_query():
    out = to_spark_sql("SELECT 1 FROM x WHERE x.i IN (SELECT a.i FROM a, b WHERE a.k = b.k(+))")
    assert out.startswith("SELECT 1 FROM x WHERE") and "LEFT JOIN b ON a.k = b.k" in out


def test_outer_join_unqualified_is_refused():
    with pytest.raises(Unsupported):
        to_spark_sql("SELECT 1 FROM a, b WHERE k = j(+)")


def test_rownum_is_applied_before_order():
    inner = to_spark_sql("SELECT a FROM t WHERE ROWNUM <= 3 ORDER BY a")
    assert inner.index("LIMIT 3") < inner.index("ORDER BY")
    top = to_spark_sql("SELECT * FROM (SELECT a FROM t ORDER BY a) WHERE ROWNUM <= 3")
    assert top.endswith("LIMIT 3")


def test_nulls_are_placed_as_in_the_source():
    assert to_spark_sql("SELECT a FROM t ORDER BY a, b DESC") == "SELECT a FROM t ORDER BY a ASC NULLS LAST, b DESC NULLS FIRST"
    assert "NULLS FIRST" in to_spark_sql("SELECT a FROM t ORDER BY a NULLS FIRST")


def test_dual_minus_and_statement_end():
    assert to_spark_sql("SELECT 1 FROM DUAL;\n/\nBEGIN x; END;") == "SELECT 1"
    assert " EXCEPT " in to_spark_sql("SELECT a FROM t MINUS SELECT b FROM u")


def test_between_keeps_its_and():
    assert to_spark_sql("SELECT 1 FROM t WHERE a BETWEEN 1 AND 2 AND b = 3") == "SELECT 1 FROM t WHERE a BETWEEN 1 AND 2 AND b = 3"


def test_lexicals():
    assert "a = 1" in Dialect(lexicals={"P_W": "a = 1"}).query("SELECT 1 FROM t WHERE &P_W")
    d = Dialect()
    assert "1 = 1" in d.query("SELECT 1 FROM t WHERE &P_W") and d.notes[0].startswith("RED")
    with pytest.raises(UnresolvedLexical):
        Dialect().query("SELECT 1 FROM &P_TABLE")


def test_unknown_package_call():
    with pytest.raises(UnknownFunction):
        to_spark_sql("SELECT Pkg.F_Secret(a) FROM t")


def test_unbalanced():
    with pytest.raises(ValueError):
        to_spark_sql("SELECT (a FROM t")


@given(st.text(alphabet="abc'(),:&+|-/* \n", max_size=40))
def test_tokenizer_loses_nothing_but_space_and_comments(text):
    kept = "".join(t.text for t in lex.tokens(text))
    assert len(kept) <= len(text)


@given(st.text(max_size=30))
def test_literal_round_trip(value):
    literal = "'" + value.replace("'", "''") + "'"
    tokens = lex.tokens(f"SELECT {literal} x")
    assert tokens[1].kind == "string" and tokens[1].text == literal


def test_days_are_added_to_dates_and_dates_subtracted(spark):
    import datetime as dt

    from bandwright.plans.dialect import to_spark_sql

    spark.createDataFrame([(dt.datetime(2024, 3, 1, 12), dt.datetime(2024, 2, 28), 5)], "d timestamp_ntz, e timestamp_ntz, n int").createOrReplaceTempView("dated")
    row = spark.sql(to_spark_sql("SELECT d - 1 a, d + 1/24 b, d - e c, TRUNC(d) - e + 3 f, n - 1 g, d - 1 - e h FROM dated", types={"d": "date", "e": "date", "n": "number"})).first()
    assert (row.a, row.b) == (dt.datetime(2024, 2, 29, 12), dt.datetime(2024, 3, 1, 13))
    assert (row.c, row.f, row.g, row.h) == (2.5, 5.0, 4, 1.5)


def test_a_nested_limit_has_its_sort_keys_among_its_columns(spark):
    spark.range(3).toDF("k").createOrReplaceTempView("outer_rows")
    spark.range(3000).selectExpr("id % 3 AS k", "id AS v", "id * 7919 % 997 AS w").repartition(7).createOrReplaceTempView("inner_rows")
    rows = [(v % 3, v, v * 7919 % 997) for v in range(3000)]
    want = {k: max((w, -v) for x, v, w in rows if x == k)[1] * -1 for k in range(3)}
    inner = "SELECT i.v FROM inner_rows i WHERE i.k = o.k ORDER BY i.w DESC, i.v FETCH FIRST 1 ROWS ONLY"
    for sql in (f"SELECT o.k, f.v FROM outer_rows o LEFT JOIN LATERAL ({inner}) f", f"SELECT o.k, ({inner}) AS v FROM outer_rows o"):
        done = spark.sql(to_spark_sql(sql))
        assert {r.k: r.v for r in done.collect()} == want
        assert "Sort [" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert to_spark_sql("SELECT a FROM t ORDER BY b FETCH FIRST 2 ROWS ONLY") == "SELECT a FROM t ORDER BY b ASC NULLS LAST LIMIT 2"
