import pytest

from bandwright.plans import engine, quality
from bandwright.plans.model import Chart, Dataset, Field, Formula, Group, Item, Link, Matrix, Param, ReportDef, Summary, Trigger
from bandwright.sources import sql_source, tables, xml_source

XML = b"""<?xml version="1.0" encoding="WINDOWS-1252"?>
<!DOCTYPE report [<!ENTITY x SYSTEM "file:///etc/passwd">]>
<report name="ORDERS"><data>
<userParameter name="P_CITY" datatype="character" display="no"/><userParameter name="P_FROM" datatype="date"/>
<dataSource name="Q_C"><select><![CDATA[SELECT cust_id, name FROM cust WHERE city = :P_CITY OR :P_CITY IS NULL;]]></select>
<group name="G_C"><dataItem name="CUST_ID" oracleDatatype="number"/><dataItem name="NAME" datatype="vchar2" defaultLabel="Caf\xe9"/>
<formula name="CF_1" source="cf_1f"/></group></dataSource>
<dataSource name="Q_O"><select>SELECT o.order_id, o.cust_id, o.amount FROM ord o WHERE o.cust_id = :CUST_ID</select>
<group name="G_O"><dataItem name="ORDER_ID" datatype="number"/><dataItem name="AMOUNT" datatype="number" scale="2" precision="10"/></group></dataSource>
<summary name="CS_1" source="AMOUNT" function="sum" reset="G_C"/><link parentGroup="G_C" childQuery="Q_O" condition="eq"/></data>
<layout><field name="F_NAME" source="NAME"/></layout>
<programUnits><function name="cf_1f"><textSource>function cf_1f return char is begin return upper(:name); end;</textSource></function></programUnits></report>"""


def test_xml(spark):
    report = xml_source.parse(XML)
    assert (report.name, [p.name for p in report.params], [d.name for d in report.datasets]) == ("ORDERS", ["P_CITY", "P_FROM"], ["Q_C", "Q_O"])
    assert report.links == (Link("Q_C", "Q_O", (("CUST_ID", "cust_id"),)),)
    assert report.params[0].hidden and report.datasets[0].items[1].label == "Café"
    spark.createDataFrame([(1, "ann", "x"), (2, "bob", "y")], "cust_id int, name string, city string").createOrReplaceTempView("cust")
    spark.createDataFrame([(10, 1, 2.5), (11, 1, 3.5)], "order_id int, cust_id int, amount double").createOrReplaceTempView("ord")
    done = engine.run(report, spark)
    assert {(r.cust_id, r.CF_1, r.CS_1, r.n_q_o) for r in done.main.collect()} == {(1, "ANN", 6.0, 2), (2, "BOB", None, 0)}
    assert engine.run(report, spark, P_CITY="y").main.count() == 1


@pytest.mark.parametrize("data", [b"", b"\xff\xfe\x00", b"<a><b></a>", b"<module/>", b"not xml at all", b"<report", b"<report/>"])
def test_garbage_never_raises(data):
    report = xml_source.parse(data)
    assert report.notes or data == b"<report/>"
    assert xml_source.kind(data) in ("not xml", "other xml", "data model")


def test_web_page_and_chart():
    page = b"<html><!-- a <report> --><report name='R'><data><dataSource name='Q'><select>SELECT a, b FROM t</select></dataSource></data></report><!-- <rw:graph id=\"g\" groups=\"A\" dataValues=\"B\"> --></html>"
    report = xml_source.parse(page)
    assert report.name == "R" and report.charts[0] == Chart("g", "A", "B", "") and [i.name for i in report.datasets[0].items] == ["a", "b"]


def test_sql_sources():
    named = sql_source.named("Q_MAIN\nSELECT id, nm FROM t;\njunk\n\nQ_SUB:\nSELECT x FROM u WHERE k = :ID AND d > :P_D\n")
    report = sql_source.report("r", named)
    assert report.links == (Link("Q_MAIN", "Q_SUB", (("id", "k"),)),) and [p.name for p in report.params] == ["P_D"]
    assert sql_source.looks_like_sql("-- c\nselect 1") and not sql_source.looks_like_sql("Dear all")
    assert sql_source.better(Dataset("a", "SELECT a FROM t"), Dataset("a", "SELECT a, b FROM t")).sql.count(",") == 1


def test_tables(spark):
    assert tables.wanted("SELECT a, f(b, c) FROM x, y z JOIN v ON 1=1 WHERE a IN (SELECT k FROM w, u) AND EXISTS (SELECT 1 FROM DUAL)") == ["x", "y", "v", "w", "u"]
    assert tables.stub(spark, "missing_t", ["a", "b"]).columns == ["a", "b"]
    df = spark.createDataFrame([("", "x")], "a string, b string")
    assert tables.empty_as_null(df).first().a is None
    got = tables.declared(spark.createDataFrame([(7, "5")], "b int, A string"), [Item("a", "number", "L", 9), Item("B")])
    assert got.columns == ["a", "B"] and got.first() == (5, "7") and got.schema["a"].metadata["label"] == "L"
    with pytest.raises(ValueError, match="declared"):
        tables.declared(df, [Item("zz")])
    assert tables.synthetic(spark, [Item("ID", "number"), Item("N"), Item("D", "date")], 3).count() == 3


def test_engine_breaks_matrix_and_presentation(spark):
    spark.createDataFrame([("e", "a", 1.0), ("e", "b", 2.0), ("w", "a", 4.0)], "region string, product string, amount double").createOrReplaceTempView("sales_t")
    report = ReportDef(
        "R",
        (Param("P_MIN", "number", 0),),
        (Dataset("Q", "SELECT region, product, amount FROM sales_t WHERE amount >= :P_MIN", (Item("region"), Item("product"), Item("amount", "number", scale=2, precision=9)), (Group("G_R", ("region",), "Q"), Group("G_D", ("product", "amount"), "Q"))),),
        summaries=(Summary("CS_R", "amount", "sum", "G_R"), Summary("CS_T", "amount", "sum", "report"), Summary("CS_X", "nope")),
        formulas=(Formula("CF_D", "begin return :amount * 2 + :P_MIN; end;"), Formula("CF_BAD", "begin return Pkg.F_Q(:amount); end;")),
        matrices=(Matrix("M", ("region",), "product", ("a", "b"), "amount"),),
        charts=(Chart("C", "region", "amount"), Chart("C2", "zz", "amount")),
        triggers=(Trigger("T1", "function t return boolean is begin return (:amount > 1); end;"),),
        fields=(Field("F_A", "amount", "$NN0.00", "T1"),),
        max_records=2,
    )
    done = engine.run(report, spark)
    assert {(r.region, r.level, r.CS_R) for r in done.breaks.collect()} == {("e", 1, 3.0), ("w", 1, 4.0), (None, 0, 7.0)}
    assert done.totals["CS_T"].first()[0] == 7.0 and {tuple(r) for r in done.totals["CS_R"].collect()} == {("e", 3.0), ("w", 4.0)}
    assert {tuple(r) for r in done.matrices["M"].collect()} == {("e", 1.0, 2.0), ("w", 4.0, None)}
    assert {tuple(r) for r in done.charts["C"].collect()} == {("e", 3.0), ("w", 4.0)}
    rows = {r.amount: (r.CF_D, r.CF_BAD, r.F_A_text, r["_visible_F_A"]) for r in done.main.collect()}
    assert rows[1.0] == (2.0, None, "$1.00", False) and rows[4.0] == (8.0, None, "$4.00", True)
    assert sum("CF_BAD" in n or "C2" in n or "CS_X" in n for n in done.notes) == 3
    assert max(r.page_no for r in engine.pages(done, report, ["region", "product"]).collect()) == 2


def test_rollup_sql_gets_no_second_totals(spark):
    spark.createDataFrame([("e", 1)], "k string, v int").createOrReplaceTempView("roll_t")
    report = ReportDef("R", datasets=(Dataset("Q", "SELECT k, SUM(v) s FROM roll_t GROUP BY ROLLUP(k)", (Item("k"), Item("s", "number"))),), summaries=(Summary("CS", "s"),))
    done = engine.run(report, spark)
    assert done.breaks is None and not done.totals and any("subtotal rows" in n for n in done.notes)


def test_quality(spark):
    report = xml_source.parse(XML)
    assert quality.complexity(report) == 13
    assert quality.coverage(report, ["cust_id"]) == ["NAME"] and quality.coverage(report, ["name"]) == []
    assert quality.fidelity(report, ["cust_id", "name", "order_id", "amount"]) == 1.0
    assert quality.lint("SELECT * FROM a, b WHERE a.k = b.k(+) AND NVL(x, 1) = SYSDATE &P") == ["NVL", "SYSDATE", "(+)", "&P", "SELECT *"]
    assert quality.lint("SELECT 'NVL(' FROM t") == []
    assert quality.preflight(ReportDef("r"))[0] == "BLOCKER"
    bad = ReportDef("r", datasets=(Dataset("Q", "SELECT 1 UNION ALL SELECT 1, 2"),))
    assert quality.preflight(bad, spark)[0] == "BLOCKER" and quality.preflight(bad)[0] == "READY"
    new = ReportDef("ORDERS", report.params[:1], report.datasets, formulas=(Formula("CF_2", "x"),))
    assert quality.diff(report, new) == [("parameter", "P_FROM", "removed"), ("formula", "CF_1", "removed"), ("formula", "CF_2", "added")]
    assert quality.drift(["a", "b", "c"], ["A", "x"]) == 0.6667
    assert quality.effort("READY", 0.95) == "automatic" and quality.effort("RED", 1.0) == "manual"
    assert quality.hollow(spark.range(0)) and not quality.hollow(spark.range(1))
    assert "+b" in quality.unified("a", "b")
