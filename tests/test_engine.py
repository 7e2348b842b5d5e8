"""Definitions from XML run as a whole: links at every depth, cursors, matrices, styles; and what is refused."""

import pytest
from bandwright.operators import burst
from bandwright.plans import engine, plsql, quality
from bandwright.plans.dialect import Unsupported, to_spark_sql
from bandwright.plans.model import Dataset, Formula, Link, ReportDef, Summary, Trigger
from bandwright.sources import xml_source

CHAIN = b"""<report name="CHAIN"><data>
<dataSource name="Q_A"><select>SELECT id, nm, kind, amt FROM apps ORDER BY nm</select>
<group name="G_KIND"><dataItem name="KIND" breakOrder="descending"/></group>
<group name="G_A"><dataItem name="ID" datatype="number"/><dataItem name="NM"/><dataItem name="AMT" datatype="number"/>
<formula name="CF_LAST" source="cf_last"/></group></dataSource>
<dataSource name="Q_B"><select>SELECT b.bid, b.app_id, b.course, b.tag FROM apply b WHERE :ID = b.app_id AND b.tag = 'x . y'</select>
<group name="G_B"><dataItem name="BID" datatype="number"/><dataItem name="COURSE" datatype="number"/><dataItem name="TAG"/></group></dataSource>
<dataSource name="Q_C"><select>SELECT c.title FROM courses c WHERE (:COURSE IS NULL OR c.cid = :COURSE)</select>
<group name="G_C"><dataItem name="TITLE"/></group></dataSource>
<summary name="CS_PCT" source="AMT" function="% of total" reset="G_KIND" compute="report"/>
<summary name="CS_FIRST" source="NM" function="first" reset="G_KIND"/><summary name="CS_SUM" source="AMT" function="sum" reset="G_KIND"/>
<link parentGroup="G_A" childQuery="Q_B"/><link parentGroup="G_B" childQuery="Q_C"/></data>
<layout><section name="main"><body>
<repeatingFrame name="R_A" source="G_A"><field name="F_NM" source="NM" formatTrigger="F_NMT"><conditionalFormat>
<formatException label="(AMT &gt; 15)"><formatVisualSettings fillForegroundColor="red"/></formatException>
<formatException label="(NM = 'ann')"><formatVisualSettings fillForegroundColor="blue"/></formatException></conditionalFormat></field>
<repeatingFrame name="R_B" source="G_B"><field name="F_BID" source="BID"/><field name="F_TITLE" source="TITLE"/></repeatingFrame></repeatingFrame>
<text name="B_1"><textSegment><string>Dear &amp;NM of &amp;&lt;KIND&gt;</string></textSegment></text>
<matrix name="X_1"><matrixRow><field source="KIND"/></matrixRow><matrixCol><field source="NM"/></matrixCol><matrixCell><field source="CS_SUM"/></matrixCell></matrix>
</body></section></layout>
<programUnits><function name="cf_last"><textSource>function cf_last return char is CURSOR c IS SELECT p.phn FROM phones p WHERE p.app_id = :ID ORDER BY p.at DESC;
 r c%ROWTYPE; begin OPEN c; FETCH c INTO r; CLOSE c; RETURN r.phn; end;</textSource></function>
<function name="F_NMT"><textSource>function F_NMT return boolean is begin srw.set_hyperlink('http://h/rw?report=detail.rdf&amp;P_ID=' || :ID || '&amp;P_KIND=' || :KIND);
 if :AMT &gt; 15 then srw.set_font_weight('bold'); end if; return (TRUE); end;</textSource></function></programUnits></report>"""


@pytest.fixture
def chain(spark):
    frames = {
        "apps": ([(1, "ann", "k", 10), (2, "bob", "k", 20), (3, "cyd", "m", 30)], "id int, nm string, kind string, amt int"),
        "apply": ([(10, 1, 100, "x . y"), (11, 1, 101, "x . y"), (12, 2, 100, "x.y"), (13, 3, 999, "x . y")], "bid int, app_id int, course int, tag string"),
        "courses": ([(100, "Maths"), (101, "Music")], "cid int, title string"),
        "phones": ([(1, "111", 1), (1, "222", 5), (1, "221", 5), (3, "333", 2)], "app_id int, phn string, at int"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    report = xml_source.parse(CHAIN)
    return report, engine.run(report, spark)


def test_links_at_every_depth(chain):
    """A link below the main dataset, a reversed predicate, a literal with blanks, an injected key, a list and a cursor."""
    report, done = chain
    assert report.links == (Link("Q_A", "Q_B", (("ID", "app_id"),)), Link("Q_B", "Q_C", (("COURSE", "cid"),)))
    got = {r.id: r for r in done.main.collect()}
    assert {i: r.n_q_b for i, r in got.items()} == {1: 2, 2: 0, 3: 1}
    assert {i: r.bid for i, r in got.items()} == {1: "10\n11", 2: None, 3: "13"}
    assert {i: r.title for i, r in got.items()} == {1: "Maths\nMusic", 2: None, 3: None}
    assert {i: r.CF_LAST for i, r in got.items()} == {1: "222", 2: None, 3: "333"}
    assert {r.bid: r.title for r in done.datasets["Q_B"].collect()} == {10: "Maths", 11: "Music", 13: None}


def test_summaries_order_and_matrix(chain):
    report, done = chain
    assert {r.KIND: round(r.CS_PCT, 4) for r in done.totals["CS_PCT"].collect()} == {"k": 0.5, "m": 0.5}
    assert {r.KIND: r.CS_FIRST for r in done.totals["CS_FIRST"].collect()} == {"k": "ann", "m": "cyd"}
    assert [r.id for r in done.main.orderBy(*done.order).collect()] == [3, 1, 2]
    assert {r.KIND: (r.ann, r.bob, r.cyd) for r in done.matrices["X_1"].collect()} == {"k": (10, 20, None), "m": (None, None, 30)}
    assert report.shape() == "matrix" and any("3 columns" in n for n in done.notes)
    assert [r.row_no for r in engine.pages(done, report).orderBy("row_no").collect()] == [1, 2, 3]


def test_layout_of_the_main_rows(chain):
    _, done = chain
    got = {r.id: r.asDict() for r in done.main.collect()}
    assert {i: (r["_format_F_NM"] or {}).get("fillForegroundColor") for i, r in got.items()} == {1: "blue", 2: "red", 3: "red"}
    assert {i: r["_style_F_NM"] for i, r in got.items()} == {1: {}, 2: {"font_weight": "bold"}, 3: {"font_weight": "bold"}}
    assert got[2]["_link_F_NM"].report == "detail" and got[2]["_link_F_NM"].params == {"P_ID": "2", "P_KIND": "k"}
    assert got[3]["B_1_text"] == "Dear cyd of m" and got[1]["_visible_F_NM"]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT t.v FROM t WHERE t.k = :K", "SELECT t.v , t.k AS K FROM t WHERE t.k = :K"),
        ("SELECT SUM(v) s FROM t WHERE :K = t.k", "SELECT SUM (v) s , t.k AS K FROM t WHERE :K = t.k GROUP BY t.k"),
        ("SELECT a, COUNT(*) n FROM t WHERE k = :K GROUP BY a ORDER BY a", "SELECT a , COUNT (*) n , k AS K FROM t WHERE k = :K GROUP BY a , k ORDER BY a"),
        ("SELECT v FROM t WHERE k = :K UNION ALL SELECT 0 FROM DUAL", "SELECT v , k AS K FROM t WHERE k = :K UNION ALL SELECT 0 , NULL AS K FROM DUAL"),
        ("SELECT k, v FROM t WHERE k = :K", "SELECT k, v FROM t WHERE k = :K"),
        ("SELECT a, SUM(v) FROM t WHERE k = :K GROUP BY ROLLUP(a)", "SELECT a, SUM(v) FROM t WHERE k = :K GROUP BY ROLLUP(a)"),
    ],
)
def test_keys_are_injected(sql, want):
    report = ReportDef("R", datasets=(Dataset("P", "SELECT k FROM p"), Dataset("C", sql)), links=(Link("P", "C", (("K", "k"),)),))
    assert engine.with_keys(report.dataset("C"), report).replace(" ,", ",").replace("( ", "(").replace(" (", "(") == want.replace(" ,", ",").replace(" (", "(")


def test_what_is_no_single_fetch_is_refused():
    for body in ("begin FOR r IN c LOOP x := x || r.a; END LOOP; RETURN x; end;", "function f return char is CURSOR a IS SELECT b FROM t; CURSOR d IS SELECT e FROM u; begin return 1; end;", "function f return char is CURSOR a IS SELECT b FROM t; r a%ROWTYPE; begin OPEN a; FETCH a INTO r; RETURN r.zz; end;"):
        with pytest.raises(plsql.UntranslatableFormula):
            plsql.single_fetch(body)
    assert plsql.single_fetch("function f return char is CURSOR a IS SELECT t.b AS x, t.c FROM t; v char; w char; begin OPEN a; FETCH a INTO v, w; RETURN (w); end;") == "SELECT MAX(t.c) FROM t"


@pytest.mark.parametrize("sql", ["SELECT a FROM t WHERE ROWNUM + 1 < 5", "SELECT a FROM t, u WHERE t.a = u.a(+) OR t.b = u.b(+)", "SELECT a FROM t, u WHERE (t.a = u.a(+) OR t.b = 1)", "SELECT a FROM t CONNECT BY PRIOR a = b ORDER SIBLINGS BY a DESC"])
def test_refused(sql):
    with pytest.raises(Unsupported):
        to_spark_sql(sql)
    with pytest.raises(Unsupported):
        to_spark_sql("SELECT TO_CHAR(d, 'YYYY-XX') FROM t", types={"d": "date"})


def test_rownum(spark):
    spark.range(10).createOrReplaceTempView("ten")
    for where, n in (("ROWNUM BETWEEN 2 AND 5", 0), ("ROWNUM BETWEEN 1 AND 4", 4), ("3 >= ROWNUM", 3), ("ROWNUM < 3 AND ROWNUM <= 7", 2), ("ROWNUM > 0", 10), ("ROWNUM >= 2", 0)):
        assert spark.sql(to_spark_sql(f"SELECT id FROM ten WHERE {where}")).count() == n


def test_siblings_come_depth_first(spark):
    spark.createDataFrame([(1, None, "r"), (2, 1, "b"), (3, 1, "a"), (4, 2, "z"), (5, 3, "y"), (6, 3, None)], "i int, p int, n string").createOrReplaceTempView("tree")
    got = spark.sql(to_spark_sql("SELECT i, LEVEL FROM tree START WITH p IS NULL CONNECT BY PRIOR i = p ORDER SIBLINGS BY n")).collect()
    assert [r.i for r in got] == [1, 3, 5, 6, 2, 4]


def test_burst_by_trigger_and_tables():
    report = ReportDef("R", datasets=(Dataset("A", "SELECT * FROM s.x JOIN y ON 1 = 1"), Dataset("B", "SELECT * FROM y WHERE a IN (SELECT b FROM x) AND EXISTS (SELECT 1 FROM DUAL)"), Dataset("C", "SELECT 1 FROM z")), triggers=(Trigger("T", "begin :P_AS_PATH := 'x'; return (TRUE); end;"),))
    assert burst.is_burst(report) and not burst.is_burst(ReportDef("R"))
    assert quality.referenced(report) == [("x", 2), ("y", 2), ("z", 1)]


def test_a_frame_matrix_and_a_short_hand_layout():
    data = b"""<report name="M"><data><dataSource name="Q"><select>SELECT emp, rem, avl FROM v</select><group name="G_E"><dataItem name="emp" datatype="number"/></group>
<group name="G_R"><dataItem name="rem"/></group><group name="G_M"><dataItem name="avl" datatype="number"/></group></dataSource></data><layout>
<repeatingFrame name="R_E" source="G_E"/><repeatingFrame name="R_R" source="G_R"/><matrix name="X" horizontalFrame="R_E" verticalFrame="R_R"/>
<tabular name="T"><field source="emp" label="E"/></tabular></layout></report>"""
    report = xml_source.parse(data)
    m = report.matrices[0]
    assert (m.rows, m.column, m.measure) == (("rem",), "emp", "avl") and [f.name for f in report.fields] == ["F_emp"]


def test_no_link_is_dropped_silently(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("p1")
    spark.createDataFrame([(1, 2)], "pid int, v int").createOrReplaceTempView("c1")
    report = ReportDef("R", datasets=(Dataset("P", "SELECT id FROM p1"), Dataset("C", "SELECT v FROM c1")), links=(Link("P", "C", (("ID", "pid"),)),), summaries=(Summary("S", "v"),), formulas=(Formula("CF", "begin return :NOPE; end;", "P"),))
    notes = engine.run(report, spark).notes
    assert any("no column pid" in n for n in notes) and any(n.startswith("S:") for n in notes) and any(n.startswith("CF:") for n in notes)


def test_number_and_week_masks(spark):
    got = spark.sql(to_spark_sql("SELECT TO_CHAR(123456, '999') a, TO_CHAR(0.5, '999.99') b, TO_CHAR(d, 'IYYY-IW WW W D J') c, TO_CHAR(-5, '9MI') e FROM (SELECT TO_DATE('2024-12-30', 'YYYY-MM-DD') d FROM DUAL)", types={"d": "date"})).first()
    assert (got.a, got.b, got.c, got.e) == ("####", ".50", "2025-01 53 5 2 2460675", "5-")
