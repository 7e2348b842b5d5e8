"""Queries that run one whole definition, read from XML, and look at its parts; and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.catalog import FIRST_FETCH, query, source, table
from bandwright.operators import breaks, matrix
from bandwright.plans import engine, quality
from bandwright.plans.lex import statement
from bandwright.plans.model import ReportDef
from bandwright.sources import xml_source

CUSTOMERS = """<?xml version="1.0" encoding="WINDOWS-1252"?><!DOCTYPE report [<!ENTITY x SYSTEM "file:///nowhere">]>
<report name="CUSTOMERS"><data><userParameter name="P_SEGMENT" datatype="character"/>
<dataSource name="Q_C"><select><![CDATA[SELECT c.c_custkey, c.c_name, c.c_mktsegment, c.c_nationkey, c.c_acctbal FROM customer c WHERE (:P_SEGMENT IS NULL OR c.c_mktsegment = :P_SEGMENT);]]></select>
<group name="G_SEGMENT"><dataItem name="c_mktsegment" datatype="vchar2" breakOrder="descending"/></group>
<group name="G_CUSTOMER"><dataItem name="c_custkey" datatype="number" precision="9"/><dataItem name="c_name"/><dataItem name="c_nationkey" datatype="number" precision="9"/><dataItem name="c_acctbal" datatype="float"/>
<formula name="CF_LAST" source="cf_lastformula"/></group></dataSource>
<dataSource name="Q_N"><select>SELECT n.n_name, n.n_regionkey FROM nation n WHERE :c_nationkey = n.n_nationkey</select><group name="G_NATION"><dataItem name="n_name"/><dataItem name="n_regionkey" datatype="number"/></group></dataSource>
<dataSource name="Q_R"><select>SELECT r.r_name FROM region r WHERE r.r_regionkey = :n_regionkey</select><group name="G_REGION"><dataItem name="r_name"/></group></dataSource>
<dataSource name="Q_O"><select>SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE (:c_custkey IS NULL OR o.o_custkey = :c_custkey) ORDER BY o.o_orderkey</select>
<group name="G_ORDER"><dataItem name="o_orderkey" datatype="number"/><dataItem name="o_totalprice" datatype="float"/></group></dataSource>
<summary name="CS_SPENT" source="o_totalprice" function="sum" reset="G_CUSTOMER"/><summary name="CS_N" source="c_custkey" function="count" reset="G_SEGMENT"/>
<summary name="CS_SHARE" source="c_acctbal" function="% of total" reset="G_SEGMENT" compute="report"/><summary name="CS_FIRST" source="c_name" function="first" reset="G_SEGMENT"/>
<link parentGroup="G_CUSTOMER" childQuery="Q_N"/><link parentGroup="G_NATION" childQuery="Q_R"/><link parentGroup="G_CUSTOMER" childQuery="Q_O"/></data>
<layout><section name="main"><body><repeatingFrame name="R_CUSTOMER" source="G_CUSTOMER">
<field name="F_NAME" source="c_name" formatTrigger="F_NAMETRIGGER"/><field name="F_NATION" source="n_name"/><field name="F_REGION" source="r_name"/>
<field name="F_BALANCE" source="c_acctbal" formatMask="999,990.00"><conditionalFormat><formatException label="(c_acctbal &lt; 0)"><formatVisualSettings fillForegroundColor="red"/></formatException>
<formatException label="(c_mktsegment = 'BUILDING')"><formatVisualSettings fillForegroundColor="blue"/></formatException></conditionalFormat></field>
<repeatingFrame name="R_ORDER" source="G_ORDER"><field name="F_ORDER" source="o_orderkey"/></repeatingFrame>
<text name="B_LETTER"><textSegment><string>Dear &amp;c_name (&amp;&lt;c_mktsegment&gt;)</string></textSegment></text></repeatingFrame>
<matrix name="X_SEGMENTS"><matrixRow><field source="c_mktsegment"/></matrixRow><matrixCol><field source="r_name"/></matrixCol><matrixCell><field source="CS_N"/></matrixCell></matrix></body></section></layout>
<programUnits><function name="cf_lastformula"><textSource><![CDATA[function CF_LASTFormula return number is CURSOR c IS SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = :c_custkey ORDER BY o.o_orderdate DESC NULLS LAST;
r c%ROWTYPE; begin OPEN c; FETCH c INTO r; CLOSE c; RETURN r.o_totalprice; end;]]></textSource></function>
<function name="F_NAMETRIGGER"><textSource><![CDATA[function F_NAMETRIGGER return boolean is begin srw.set_hyperlink('http://reports/rw?report=orders.rdf&P_CUST=' || :c_custkey || '&P_SEG=' || :c_mktsegment);
if :c_acctbal > 5000 then srw.set_font_weight('bold'); end if; if :c_acctbal < -900 then return (FALSE); end if; return (TRUE); end;]]></textSource></function></programUnits></report>"""
WEB_PAGE = "<html><body><!-- a <report> page --><%-- x --%>{}</body></html>"


def definition() -> ReportDef:
    return xml_source.parse(CUSTOMERS.encode("cp1252"))


def ran(spark: SparkSession, sf: str, report: ReportDef | None = None, **values: object) -> engine.Result:
    for name in ("customer", "orders", "nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return engine.run(report or definition(), spark, **values)


def of_main(name: str, oracle: str, pick: Callable[[DataFrame], DataFrame], **values: object) -> None:
    """A query over the main rows of the definition."""
    query(name, oracle)(lambda spark, sf: pick(ran(spark, sf, **values).main))


HOPS = "SELECT c_custkey, n_name, r_name{} FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey{}"
of_main("a01_definition_run", "SELECT c_custkey, coalesce(n, 0) AS n_orders, round(spent, 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey", lambda m: m.select("c_custkey", F.col("n_q_o").alias("n_orders"), F.round("CS_SPENT", 2).alias("spent")))
of_main("p07_parameter_of_a_definition", HOPS.format("", " WHERE c_mktsegment = 'MACHINERY'"), lambda m: m.select("c_custkey", "n_name", "r_name"), P_SEGMENT="MACHINERY")
of_main("j09_key_put_into_child", HOPS.format("", "").replace(", r_name", ""), lambda m: m.select("c_custkey", "n_name"))
of_main("j10_two_hops_of_a_definition", HOPS.format("", ""), lambda m: m.select("c_custkey", "n_name", "r_name"))
of_main("j06_list_of_a_definition", "SELECT c_custkey, string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", lambda m: m.select("c_custkey", F.col("o_orderkey").alias("orders")))
of_main("j13_cursor_of_a_definition", FIRST_FETCH, lambda m: m.select("c_custkey", F.col("CF_LAST").alias("last_price")))
of_main("e13_style_of_a_definition", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'bold' END AS weight, NOT coalesce(c_acctbal < -900, FALSE) AS is_visible FROM customer", lambda m: m.select("c_custkey", F.try_element_at("_style_F_NAME", F.lit("font_weight")).alias("weight"), F.col("_visible_F_NAME").alias("is_visible")))
of_main("e15_format_of_a_definition", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'red' WHEN c_mktsegment = 'BUILDING' THEN 'blue' END AS color FROM customer", lambda m: m.select("c_custkey", F.try_element_at("_format_F_BALANCE", F.lit("fillForegroundColor")).alias("color")))
of_main("e18_text_of_a_definition", "SELECT c_custkey, 'Dear ' || c_name || ' (' || c_mktsegment || ')' AS body FROM customer", lambda m: m.select("c_custkey", F.col("B_LETTER_text").alias("body")))
of_main("r05_link_of_a_trigger", "SELECT c_custkey, 'orders' AS report, CAST(c_custkey AS VARCHAR) || '/' || c_mktsegment AS args FROM customer", lambda m: m.select("c_custkey", "_link_F_NAME.report", F.concat_ws("/", F.col("_link_F_NAME.params")["P_CUST"], F.col("_link_F_NAME.params")["P_SEG"]).alias("args")))


@query("a02_definition_in_a_web_page", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    body = CUSTOMERS[CUSTOMERS.index("<report ") :]
    return ran(spark, sf, xml_source.parse(WEB_PAGE.format(body).encode()), P_SEGMENT="BUILDING").main.select("c_custkey", "n_name")


@query("a03_encodings", "SELECT n_nationkey, 'Café ' || n_name AS label FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same definition in three encodings, one of them undeclared: the same rows."""
    text = '<report name="N"><data><dataSource name="Q"><select>SELECT n_nationkey, \'Café \' || n_name AS label FROM nation</select></dataSource></data></report>'
    codes = [f'<?xml version="1.0" encoding="WINDOWS-1252"?>{text}'.encode("cp1252"), text.encode(), text.encode("latin-1")]
    rows = [ran(spark, sf, xml_source.parse(data)).main for data in codes]
    return rows[0].intersect(rows[1]).intersect(rows[2])


@query("a06_first_statement", "SELECT r_regionkey FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "region").createOrReplaceTempView("region")
    return spark.sql(statement("SELECT r_regionkey FROM region -- all; of them\n;\nDELETE FROM region;\n/\nBEGIN NULL; END;"))


@query("g05_first_of_a_definition", "SELECT c_mktsegment, arg_min(c_name, c_custkey) AS first_name FROM customer GROUP BY c_mktsegment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ran(spark, sf).totals["CS_FIRST"].withColumnRenamed("CS_FIRST", "first_name")


@query("g12_share_of_a_definition", "SELECT c_mktsegment, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ran(spark, sf).totals["CS_SHARE"].withColumnRenamed("CS_SHARE", "share")


@query("g21_matrix_of_a_definition", 'SELECT c_mktsegment, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2')
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the matrix, whose columns the run finds in the data, as rows again."""
    cells = ran(spark, sf).matrices["X_SEGMENTS"]
    regions = [c for c in cells.columns if c != "c_mktsegment"]
    return cells.unpivot("c_mktsegment", regions, "r_name", "n").where("n > 0")


@query("o03_break_order", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_custkey) AS INTEGER) AS row_no FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = definition()
    return engine.pages(ran(spark, sf, report), report).select("c_custkey", "row_no")


@query("g30_referenced_tables", "SELECT 'customer' AS name, 1 AS n, 0 AS place, count(*) AS n_rows FROM customer UNION ALL SELECT 'nation', 1, 1, count(*) FROM nation UNION ALL SELECT 'region', 1, 2, count(*) FROM region UNION ALL SELECT 'orders', 1, 3, count(*) FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that a definition reads, most used first, with their sizes."""
    counts = [table(spark, sf, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(n).alias("n"), F.lit(i).alias("place"), "n_rows") for i, (name, n) in enumerate(quality.referenced(definition()))]
    return reduce(DataFrame.union, counts)


def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(name, n, i) for i, (name, n) in enumerate(quality.referenced(definition()))], "name string, n int, place int")


@query("r26_details_not_rendered", "SELECT count(*) FILTER (WHERE o_orderkey IS NOT NULL) AS n_orders FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """No detail row is lost between the child and the lists of its parents."""
    lists = ran(spark, sf).main.select(F.explode(F.split("o_orderkey", "\n")).alias("o_orderkey"))
    return lists.agg(F.count("o_orderkey").alias("n_orders"))


# ---- operators on the tables themselves
@query("w04_reversed_link", "SELECT n_nationkey, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_name <> 'x . y' GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = xml_source.parse(b"""<report name="R"><data><dataSource name="Q_N"><select>SELECT n_nationkey FROM nation</select><group name="G_N"><dataItem name="n_nationkey"/></group></dataSource>
<dataSource name="Q_C"><select>SELECT c.c_custkey FROM customer c WHERE :n_nationkey = c.c_nationkey AND c.c_name &lt;&gt; 'x . y'</select><group name="G_C"><dataItem name="c_custkey"/></group></dataSource>
<link parentGroup="G_N" childQuery="Q_C"/></data></report>""")
    return ran(spark, sf, report).main.select("n_nationkey", F.col("n_q_c").alias("n_customers"))


@query("j09_key_put_into_groups", "SELECT n_nationkey, n_customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = xml_source.parse(b"""<report name="R"><data><dataSource name="Q_N"><select>SELECT n_nationkey FROM nation</select><group name="G_N"><dataItem name="n_nationkey"/></group></dataSource>
<dataSource name="Q_C"><select>SELECT COUNT(*) n_customers FROM customer c WHERE c.c_nationkey = :n_nationkey</select><group name="G_C"><dataItem name="n_customers"/></group></dataSource>
<link parentGroup="G_N" childQuery="Q_C"/></data><layout><repeatingFrame source="G_N"><field name="F" source="n_customers"/></repeatingFrame></layout></report>""")
    return ran(spark, sf, report).main.select("n_nationkey", "n_customers")


@query("j04_cross_product_cells", "SELECT n_regionkey, band, count(m) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (SELECT DISTINCT n_nationkey % 7 AS band FROM nation) g LEFT JOIN (SELECT n_regionkey AS r, n_nationkey % 7 AS b, 1 AS m FROM nation) ON r = n_regionkey AND b = band GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("band", F.col("n_nationkey") % 7)
    return matrix.cross_product(n, [["n_regionkey"], ["band"]], [F.count("*").alias("n")]).withColumn("n", F.coalesce("n", F.lit(0)))


@query("g14_grand_total_summary", "SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return breaks.summary(table(spark, sf, "orders"), "sum", "o_totalprice", (), "total").select(F.round("total", 2).alias("total"))


@query("g16_largest_group", "SELECT c_nationkey, max(n) AS largest FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    inner = breaks.summary(table(spark, sf, "customer"), "count", "c_custkey", ("c_nationkey", "c_mktsegment"), "n")
    return breaks.summary(inner, "max", "n", ("c_nationkey",), "largest")


source("w16_outer_filter_marked", "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_orderstatus(+) = 'P'", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
source("d49_systimestamp", "SELECT n_nationkey, TO_CHAR(SYSTIMESTAMP, 'YYYY-MM-DD HH24:MI') AS at FROM nation", "SELECT n_nationkey, '2001-06-15 10:30' AS at FROM nation")
source("d42_weeks_and_days", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'IYYY-IW') AS iso, TO_CHAR(o_orderdate, 'WW/W/D') AS nth, TO_CHAR(o_orderdate, 'J') AS julian FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%G-%V') AS iso, lpad(CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS VARCHAR), 2, '0') || '/' || CAST((day(o_orderdate) - 1) // 7 + 1 AS VARCHAR) || '/' || CAST(dayofweek(o_orderdate) + 1 AS VARCHAR) AS nth, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS VARCHAR) AS julian FROM orders")
source("d66_number_too_wide", "SELECT o_orderkey, TO_CHAR(o_totalprice, '99999') AS shown FROM orders", "SELECT o_orderkey, CASE WHEN round(CAST(o_totalprice AS DECIMAL(18,2)), 0) >= 100000 THEN '######' ELSE CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT) AS VARCHAR) END AS shown FROM orders")
source("o05_rownum_between", "SELECT COUNT(*) n FROM (SELECT o_orderkey FROM orders WHERE ROWNUM BETWEEN 1 AND 25)", "SELECT 25 AS n")
source("x03_helper_functions", "SELECT c_custkey, F_Format_Org_Name(NULL, c_name, 'q', c_mktsegment, NULL) AS who, F_Format_Address(c_mktsegment, NULL, c_name, 'TX', '01234', '') AS line FROM customer", "SELECT c_custkey, c_mktsegment || ', ' || c_name || ' q.' AS who, c_mktsegment || ' ' || c_name || ', TX 01234' AS line FROM customer")


@query("o01_order_numbered", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment DESC NULLS FIRST, c_acctbal NULLS LAST, c_custkey) AS INTEGER) AS row_no FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The order that a translated ORDER BY gives, as numbers."""
    from bandwright.operators import present
    from bandwright.plans.dialect import to_spark_sql

    table(spark, sf, "customer").createOrReplaceTempView("customer")
    text = to_spark_sql("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY 2 DESC, c_acctbal, 1")
    names = ["c_mktsegment", "c_acctbal", "c_custkey"]
    wanted = [F.col(n).desc_nulls_first() if "DESC NULLS FIRST" in x else F.col(n).asc_nulls_last() for n, x in zip(names, text.partition("ORDER BY ")[2].split(", "), strict=True)]
    return present.numbered(spark.sql(text), wanted).select("c_custkey", "row_no")
