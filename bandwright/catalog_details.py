"""Queries of details that are run for each parent row, of the order of evaluation, and of matrices, each from one XML definition."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.catalog import query, table
from bandwright.functions.registry import standard
from bandwright.operators import breaks, burst, links, matrix, pages
from bandwright.plans import binds, engine, quality
from bandwright.plans.model import Dataset, ReportDef
from bandwright.sources import files, xml_source

TABLES = ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")


def ran(spark: SparkSession, sf: str, report: ReportDef | bytes, **values: object) -> engine.Result:
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)
    spans = table(spark, sf, "lineitem").where("l_orderkey % 50 < 5").withColumn("from_date", F.col("l_shipdate"))
    spans.withColumn("to_date", F.expr(EFFECTIVE.format("3 DAY"))).createOrReplaceTempView("lineitem_spans")
    return engine.run(report if isinstance(report, ReportDef) else xml_source.parse(report), spark, **values)


def master_detail(parent: str, key: str, child: str, column: str) -> bytes:
    """A definition of a parent, and a detail whose ``column`` its rows list."""
    return f"""<report name="R"><data><dataSource name="Q_P"><select>{escape(parent)}</select><group name="G_P"><dataItem name="{key}"/></group></dataSource>
<dataSource name="Q_D"><select>{escape(child)}</select><group name="G_D"><dataItem name="{column}" datatype="number"/></group></dataSource>
<summary name="CS_ALL" source="{column}" function="sum" reset="G_P"/><link parentGroup="G_P" childQuery="Q_D"/></data></report>""".encode()


def detail(name: str, parent: str, key: str, child: str, column: str, inner: str, tables: str = "") -> None:
    """One query: how many rows each parent has and their sum, against the detail as DuckDB's lateral join."""
    oracle = f"SELECT p.{key}, coalesce(n, 0) AS n, total FROM ({tables or parent}) p LEFT JOIN LATERAL (SELECT count(*) AS n, CAST(sum({column}) AS DOUBLE) AS total FROM ({inner}) d) ON TRUE"

    @query(name, oracle)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return ran(spark, sf, master_detail(parent, key, child, column)).main.select(key, F.col("n_q_d").alias("n"), F.col("CS_ALL").cast("double").alias("total"))


CUSTOMERS, NATIONS = "SELECT c_custkey FROM customer", "SELECT n_nationkey FROM nation"
detail("j05_two_largest_of_each", CUSTOMERS, "c_custkey", "SELECT * FROM (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = :c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) WHERE ROWNUM <= 2", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = p.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2")
detail("j05_fetch_first_of_each", CUSTOMERS, "c_custkey", "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = :c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey FETCH FIRST 1 ROWS ONLY", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = p.c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
detail("o05_rownum_of_each", CUSTOMERS, "c_custkey", "SELECT 1 one FROM orders o WHERE o.o_custkey = :c_custkey AND ROWNUM <= 3", "one", "SELECT 1 AS one FROM orders WHERE o_custkey = p.c_custkey LIMIT 3")
detail("j06_row_numbers_of_each", CUSTOMERS, "c_custkey", "SELECT o.o_orderkey * ROW_NUMBER() OVER (ORDER BY o.o_totalprice, o.o_orderkey) place FROM orders o WHERE o.o_custkey = :c_custkey", "place", "SELECT o_orderkey * row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_custkey = p.c_custkey")
detail("w04_key_in_a_derived_table", CUSTOMERS, "c_custkey", "SELECT d.k FROM (SELECT o.o_orderkey k, o.o_orderstatus s FROM orders o WHERE o.o_custkey = :c_custkey) d WHERE d.s = 'F'", "k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey = p.c_custkey AND o_orderstatus = 'F'")
detail("w04_key_under_or", NATIONS, "n_nationkey", "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > 9000 OR c.c_nationkey = :n_nationkey", "c_custkey", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_nationkey = p.n_nationkey")
detail("w04_key_under_not", NATIONS, "n_nationkey", "SELECT c.c_custkey FROM customer c WHERE NOT (c.c_nationkey = :n_nationkey)", "c_custkey", "SELECT c_custkey FROM customer WHERE NOT (c_nationkey = p.n_nationkey)")
detail("w04_key_of_a_function", NATIONS, "n_nationkey", "SELECT c.c_custkey FROM customer c WHERE NVL(c.c_nationkey, 0) + 1 = :n_nationkey", "c_custkey", "SELECT c_custkey FROM customer WHERE coalesce(c_nationkey, 0) + 1 = p.n_nationkey")
detail("w04_key_in_exists", NATIONS, "n_nationkey", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = :n_nationkey AND s.s_nationkey = c.c_nationkey AND s.s_acctbal < c.c_acctbal)", "c_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = p.n_nationkey AND s.s_nationkey = c.c_nationkey AND s.s_acctbal < c.c_acctbal)")
detail("w04_key_in_the_select_list", NATIONS, "n_nationkey", "SELECT s.s_suppkey + :n_nationkey v FROM supplier s WHERE s.s_nationkey = :n_nationkey", "v", "SELECT s_suppkey + p.n_nationkey AS v FROM supplier WHERE s_nationkey = p.n_nationkey")
detail("w01_optional_key", "SELECT DISTINCT NULLIF(n_regionkey, 2) k FROM nation", "k", "SELECT n.n_nationkey FROM nation n WHERE (:k IS NULL OR n.n_regionkey = :k) AND n.n_nationkey > 3", "n_nationkey", "SELECT n_nationkey FROM nation WHERE (p.k IS NULL OR n_regionkey = p.k) AND n_nationkey > 3", "SELECT DISTINCT NULLIF(n_regionkey, 2) AS k FROM nation")

# ---- links without an equality: a point of the parent in an interval of the detail
detail("j19_value_in_an_interval", "SELECT c_custkey, c_acctbal FROM customer", "c_custkey", "SELECT s.s_suppkey FROM supplier s WHERE :c_acctbal BETWEEN s.s_acctbal - 100 AND s.s_acctbal + s.s_suppkey", "s_suppkey", "SELECT s_suppkey FROM supplier WHERE p.c_acctbal BETWEEN s_acctbal - 100 AND s_acctbal + s_suppkey")
EFFECTIVE = "CASE WHEN l_linenumber > 1 THEN l_shipdate + INTERVAL {} END"
detail("j19_effective_dating", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'", "o_orderkey", "SELECT l.l_linenumber FROM lineitem_spans l WHERE l.from_date <= :o_orderdate AND NVL(l.to_date, :o_orderdate) >= :o_orderdate AND l.l_quantity > 45", "l_linenumber", "SELECT l_linenumber FROM (SELECT *, " + EFFECTIVE.format("3 DAY") + " AS to_date FROM lineitem WHERE l_orderkey % 50 < 5) l WHERE l_shipdate <= p.o_orderdate AND (to_date IS NULL OR to_date >= p.o_orderdate) AND l_quantity > 45")


@query("j19_interval_join", "SELECT s_suppkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM supplier JOIN customer ON c_acctbal >= s_acctbal - s_suppkey AND c_acctbal < s_acctbal + 10 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") - F.col("s_suppkey")).alias("low"), (F.col("s_acctbal") + 10).alias("high")).dropna()
    held = links.totals_of_intervals(spans, table(spark, sf, "customer"), "c_acctbal", "low", "high", ["c_custkey"], high_is_open=True)
    return held.groupBy("s_suppkey").agg(F.sum("_n").alias("n"), F.sum("_sum0").alias("total"))


# ---- scans over whole reports
MONEY = "DECIMAL(18,2)"


@query("n02_running_totals_of_the_report", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS {MONEY})) OVER w AS DOUBLE) AS total, max(o_totalprice) OVER w AS largest, count(o_totalprice) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice").cast(MONEY))
    for name, function, value in (("total", "sum", "v"), ("largest", "max", "o_totalprice"), ("n", "count", "o_totalprice")):
        rows = breaks.running(rows, value, name, ["o_orderdate", "o_orderkey"], function=function)
    return rows.select("o_orderkey", F.col("total").cast("double").alias("total"), "largest", "n")


@query("n02_running_minimum_of_large_groups", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS least FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return breaks.running(table(spark, sf, "orders"), "o_totalprice", "least", ["o_orderkey"], ["o_orderstatus"], "min").select("o_orderkey", "least")


@query("n05_pages_by_group", "SELECT o_orderkey, CAST((nth - 1) // records + 1 AS INTEGER) AS page_of_group, CAST((nth - 1) // records + 1 + before AS INTEGER) AS page_no FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS nth FROM orders) JOIN (SELECT o_orderstatus, records, coalesce(sum(CAST(ceil(n / records) AS BIGINT)) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 7 ELSE 40 END AS records FROM orders GROUP BY 1)) USING (o_orderstatus)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("records", F.when(F.col("o_orderstatus") == "P", 7).otherwise(40))
    return pages.flowed(rows, ["o_orderstatus"], ["o_orderstatus", "o_orderkey"], "records").select("o_orderkey", "page_no", "page_of_group")


# ---- matrices
MATRICES = b"""<report name="M"><data><dataSource name="Q_L"><select>SELECT l_returnflag, l_linestatus, CAST(NULLIF(l_linenumber, 3) AS INT) AS line, l_quantity FROM lineitem</select>
<group name="G_F"><dataItem name="l_linestatus"/></group><group name="G_L"><dataItem name="l_returnflag"/><dataItem name="line" datatype="number"/><dataItem name="l_quantity" datatype="number"/></group></dataSource>
<summary name="CS_Q" source="l_quantity" function="sum"/><summary name="CS_N" source="l_quantity" function="count"/></data><layout><section name="main"><body>
<matrix name="X_TWO"><matrixRow><field source="l_returnflag"/></matrixRow><matrixCol><field source="l_linestatus"/><field source="line"/></matrixCol><matrixCell><field source="CS_Q"/><field source="CS_N"/></matrixCell></matrix>
<repeatingFrame name="R_F" source="G_F"><matrix name="X_BAND"><matrixRow><field source="l_returnflag"/></matrixRow><matrixCol><field source="line"/></matrixCol><matrixCell><field source="CS_N"/></matrixCell></matrix></repeatingFrame>
</body></section></layout></report>"""


def unpivoted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of a matrix as rows again."""
    names = [c for c in cells.columns if c not in keys]
    return cells.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).unpivot(keys, [F.col(f"`{c}`") for c in names], "cell", "value").where("value <> 0")


LINE = "coalesce(CAST(NULLIF(l_linenumber, 3) AS VARCHAR), '(null)')"


@query("g21_two_cells_and_two_column_fields", f"SELECT l_returnflag, l_linestatus || '/' || {LINE} || ' ' || unnest(['sum', 'count']) || ' l_quantity' AS cell, CAST(unnest([sum(l_quantity), count(l_quantity)]) AS DOUBLE) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus, {LINE}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(ran(spark, sf, MATRICES).matrices["X_TWO"], ["l_returnflag"])


@query("g24_band_of_the_layout", f"SELECT l_linestatus, l_returnflag, {LINE} AS cell, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(ran(spark, sf, MATRICES).matrices["X_BAND"], ["l_linestatus", "l_returnflag"])


@query("g25_several_matrices", "SELECT 'X_BAND' AS name, count(*) AS n FROM (SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem) UNION ALL SELECT 'X_TWO', count(DISTINCT l_returnflag) FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = ran(spark, sf, MATRICES).matrices
    return reduce(DataFrame.union, (m.select(F.lit(n).alias("name")) for n, m in found.items())).groupBy("name").agg(F.count("*").alias("n"))


@query("g23_margins_at_each_column_level", "SELECT l_returnflag, grouping(l_returnflag) = 1 AS is_total, CASE WHEN grouping(l_linestatus) = 1 THEN 'row_total' WHEN grouping(l_linenumber) = 1 THEN l_linestatus || ' total' ELSE l_linestatus || '/' || l_linenumber END AS cell, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), (l_returnflag), (l_linestatus, l_linenumber), (l_linestatus), ())")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    values = [tuple(r) for r in rows.select("l_linestatus", "l_linenumber").distinct().orderBy("l_linestatus", "l_linenumber").collect()]
    done = matrix.crosstab(rows, ["l_returnflag"], ["l_linestatus", "l_linenumber"], values, [("l_orderkey", "count", "")], margins=True)
    return unpivoted(done, ["l_returnflag", "is_total"])


# ---- the order of evaluation
ORDERED = b"""<report name="E"><data><dataSource name="Q_C"><select>SELECT c_custkey, c_nationkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(12,2)) bal FROM customer</select>
<group name="G_SEG"><dataItem name="c_mktsegment"/></group><group name="G_NAT"><dataItem name="c_nationkey" datatype="number"/></group>
<group name="G_C"><dataItem name="c_custkey" datatype="number"/><dataItem name="bal" datatype="number"/>
<formula name="CF_LABEL" source="cf_label"/><formula name="CF_RATE" source="cf_rate"/><formula name="CF_SHARE" source="cf_share"/></group></dataSource>
<dataSource name="Q_O"><select>SELECT o.o_orderkey, CAST(o.o_totalprice AS DECIMAL(15,2)) price FROM orders o WHERE o.o_custkey = :c_custkey</select>
<group name="G_O"><dataItem name="o_orderkey" datatype="number"/><dataItem name="price" datatype="number"/><formula name="CF_NET" source="cf_net"/></group></dataSource>
<dataSource name="Q_N"><select>SELECT n_name FROM nation WHERE n_nationkey = :c_nationkey</select><group name="G_N"><dataItem name="n_name"/></group></dataSource>
<summary name="CS_NET" source="CF_NET" function="sum" reset="G_C"/><summary name="CS_SEG" source="bal" function="sum" reset="G_SEG"/>
<summary name="CS_NATION" source="bal" function="sum" reset="G_NAT"/><summary name="CS_BEST" source="CS_NATION" function="maximum" reset="G_SEG"/>
<summary name="CS_WORST_BEST" source="CS_BEST" function="minimum" reset="report"/>
<link parentGroup="G_C" childQuery="Q_O"/><link parentGroup="G_C" childQuery="Q_N"/></data><programUnits>
<function name="cf_label"><textSource>function cf_label return char is begin return :n_name || '/' || :CF_RATE; end;</textSource></function>
<function name="cf_rate"><textSource>function cf_rate return number is begin if :CS_NET > 1000000 then return (2); end if; return (1); end;</textSource></function>
<function name="cf_share"><textSource>function cf_share return number is begin return (:bal - :CS_SEG); end;</textSource></function>
<function name="cf_net"><textSource>function cf_net return number is begin return (:price - 100); end;</textSource></function></programUnits></report>""".replace(b"> 1000000", b"&gt; 1000000")


def evaluated(name: str, oracle: str, pick: Callable[[engine.Result], DataFrame]) -> None:
    query(name, oracle)(lambda spark, sf: pick(ran(spark, sf, ORDERED)))


NET = "(SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(15,2)) - 100) AS net FROM orders GROUP BY 1)"
evaluated("e05_formula_on_a_detail_summary", f"SELECT c_custkey, CAST(net AS DOUBLE) AS net, CASE WHEN net > 1000000 THEN 2 ELSE 1 END AS rate FROM customer LEFT JOIN {NET} ON o_custkey = c_custkey", lambda r: r.main.select("c_custkey", F.col("CS_NET").cast("double").alias("net"), F.col("CF_RATE").cast("int").alias("rate")))
evaluated("e11_formula_on_a_later_one_and_a_lookup", f"SELECT c_custkey, n_name || '/' || CASE WHEN net > 1000000 THEN '2' ELSE '1' END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN {NET} ON o_custkey = c_custkey", lambda r: r.main.select("c_custkey", F.col("CF_LABEL").alias("label")))
evaluated("e11_formula_on_an_own_summary", "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) - sum(CAST(c_acctbal AS DECIMAL(12,2))) OVER (PARTITION BY c_mktsegment) AS DOUBLE) AS apart FROM customer", lambda r: r.main.select("c_custkey", F.col("CF_SHARE").cast("double").alias("apart")))
evaluated("g16_summary_of_a_summary", "SELECT c_mktsegment, CAST(max(s) AS DOUBLE) AS best FROM (SELECT c_mktsegment, c_nationkey, sum(CAST(c_acctbal AS DECIMAL(12,2))) AS s FROM customer GROUP BY 1, 2) GROUP BY 1", lambda r: r.totals["CS_BEST"].select("c_mktsegment", F.col("CS_BEST").cast("double").alias("best")))
evaluated("g16_three_levels_of_summaries", "SELECT CAST(min(best) AS DOUBLE) AS least FROM (SELECT c_mktsegment, max(s) AS best FROM (SELECT c_mktsegment, c_nationkey, sum(CAST(c_acctbal AS DECIMAL(12,2))) AS s FROM customer GROUP BY 1, 2) GROUP BY 1)", lambda r: r.totals["CS_WORST_BEST"].select(F.col("CS_WORST_BEST").cast("double").alias("least")))


# ---- hierarchies
@query("j20_chains_of_300", "SELECT c_custkey, CAST(c_custkey % 300 + 1 AS INTEGER) AS depth, c_custkey - c_custkey % 300 AS root, CAST(c_custkey % 300 = 299 OR c_custkey = (SELECT max(c_custkey) FROM customer) AS INTEGER) AS is_leaf FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of 300 customers, each the parent of the next."""
    table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 300 > 0 THEN c_custkey - 1 END AS prev").createOrReplaceTempView("customer_chain")
    return binds.run(spark, "SELECT c_custkey, LEVEL depth, CONNECT_BY_ROOT c_custkey root, CONNECT_BY_ISLEAF is_leaf FROM customer_chain START WITH prev IS NULL CONNECT BY PRIOR c_custkey = prev")


@query("j20_cycles_and_paths", """WITH RECURSIVE ring AS (SELECT n_nationkey, n_regionkey, coalesce((SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey > n.n_nationkey), (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey)) AS nxt FROM nation n),
w AS (SELECT n_nationkey, nxt, 1 AS depth, '/' || n_nationkey AS way, [n_nationkey] AS seen FROM ring WHERE n_nationkey IN (0, 2) UNION ALL SELECT r.n_nationkey, r.nxt, w.depth + 1, w.way || '/' || r.n_nationkey, list_append(w.seen, r.n_nationkey) FROM w JOIN ring r ON r.n_nationkey = w.nxt WHERE NOT list_contains(w.seen, r.n_nationkey))
SELECT n_nationkey, depth, way, CAST(list_contains(seen, nxt) AS INTEGER) AS is_cycle FROM w""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The nations of a region in a ring."""
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)
    ring = "SELECT n_nationkey, COALESCE(LEAD(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), MIN(n_nationkey) OVER (PARTITION BY n_regionkey)) nxt FROM nation"
    return binds.run(spark, f"SELECT n_nationkey, LEVEL depth, SYS_CONNECT_BY_PATH(n_nationkey, '/') way, CONNECT_BY_ISCYCLE is_cycle FROM ({ring}) START WITH n_nationkey IN (0, 2) CONNECT BY NOCYCLE PRIOR nxt = n_nationkey")


# ---- files
def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors reach; the machine's own only where one machine runs all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bandwright-")
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


NATION_FILES = b"""<report name="F"><data><dataSource name="Q_N"><select/><group name="G_N"><dataItem name="N_NATIONKEY" datatype="number" precision="9"/><dataItem name="N_NAME"/></group></dataSource>
<dataSource name="Q_C"><select>SELECT c.c_custkey, CAST(c.c_acctbal AS DECIMAL(12,2)) bal FROM customer c WHERE c.c_nationkey = :N_NATIONKEY</select><group name="G_C"><dataItem name="c_custkey" datatype="number"/><dataItem name="bal" datatype="number"/></group></dataSource>
<summary name="CS_BAL" source="bal" function="sum" reset="G_N"/><link parentGroup="G_N" childQuery="Q_C"/></data></report>"""


@query("a10_rows_of_xml_files", "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, count(c_custkey) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS bal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A parent that is read from XML files, with a detail that is SQL over a table."""
    path = shared_folder(spark)
    table(spark, sf, "nation").write.format("xml").option("rowTag", "nation").save(path)
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    report = xml_source.parse(NATION_FILES)
    main = engine.run(report, spark, sources={"Q_N": files.read(spark, report.dataset("Q_N"), path, "xml", "nation")}).main
    return main.select(F.col("N_NATIONKEY").alias("n_nationkey"), F.col("N_NAME").alias("n_name"), F.col("n_q_c").alias("n"), F.col("CS_BAL").cast("double").alias("bal"))


@query("a23_burst_files", "SELECT o_orderstatus, 'orders_' || o_orderstatus || '.csv' AS file_name, count(*) AS n_rows, count(*) > 3000 AS is_split FROM orders GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """One folder a status; the manifest of what was written."""
    rows = table(spark, sf, "orders")
    done = burst.write(rows, shared_folder(spark), "o_orderstatus", name=burst.file_name("orders_<O_ORDERSTATUS>.csv", rows.columns), rows_per_file=3000)
    return done.select("o_orderstatus", "file_name", "n_rows", (F.col("n_files") > 1).alias("is_split"))


# ---- rules of a definition, each seen in the rows of its run
RULES = b"""<report name="R"><data><userParameter name="P_SEG" datatype="character"><listOfValues><value>BUILDING</value><value>MACHINERY</value></listOfValues></userParameter>
<dataSource name="Q_C"><select>SELECT n_regionkey, n_name, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) bal FROM customer, nation WHERE c_nationkey = n_nationkey AND (:P_SEG IS NULL OR c_mktsegment = :P_SEG)</select>
<group name="G_R"><dataItem name="n_regionkey" datatype="number"/></group><group name="G_N"><dataItem name="n_name"/></group>
<group name="G_C"><dataItem name="c_custkey" datatype="number"/><dataItem name="bal" datatype="number"/><formula name="CF_LOOP" source="cf_loop"/><formula name="CF_CALL" source="cf_call"/><formula name="CF_OK" source="cf_ok"/></group></dataSource>
<summary name="CS_BAL" source="bal" function="sum" reset="report"/><summary name="CS_N" source="c_custkey" function="count" reset="G_R"/></data>
<layout><tabular name="T"><field source="bal" formatMask="999990.00"/><field source="CF_OK"/></tabular></layout><programUnits>
<function name="cf_loop"><textSource>function cf_loop return number is x number; begin for i in 1..3 loop x := x + i; end loop; return x; end;</textSource></function>
<function name="cf_call"><textSource>function cf_call return number is begin return Other_Pkg.Unknown_Function(:c_custkey); end;</textSource></function>
<function name="cf_ok"><textSource>function cf_ok return number is begin if :bal is null then return (0); end if; return (:bal * 2); end;</textSource></function></programUnits></report>"""
RULED = "FROM customer JOIN nation ON c_nationkey = n_nationkey"


def ruled(name: str, oracle: str, pick: Callable[[engine.Result], DataFrame], **values: object) -> None:
    query(name, oracle)(lambda spark, sf: pick(ran(spark, sf, RULES, **values)))


def noted(result: engine.Result, start: str) -> bool:
    return any(n.startswith(start) for n in result.notes)


ruled("e08_formula_that_is_not_translated", f"SELECT c_custkey, CAST(NULL AS VARCHAR) AS looped, CAST(2 * CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS doubled, TRUE AS is_noted {RULED}", lambda r: r.main.select("c_custkey", F.col("CF_LOOP").cast("string").alias("looped"), F.col("CF_OK").cast("double").alias("doubled"), F.lit(noted(r, "CF_LOOP")).alias("is_noted")))
ruled("e10_call_of_an_unknown_package", f"SELECT c_custkey, CAST(NULL AS VARCHAR) AS called, TRUE AS is_noted {RULED}", lambda r: r.main.select("c_custkey", F.col("CF_CALL").cast("string").alias("called"), F.lit(noted(r, "CF_CALL")).alias("is_noted")))
ruled("r34_short_hand_layout", f"SELECT c_custkey, printf('%.2f', CAST(c_acctbal AS DECIMAL(12,2))) AS shown {RULED}", lambda r: r.main.select("c_custkey", F.col("F_bal_text").alias("shown")))
ruled("r36_totals_of_the_data_model", f"SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS total {RULED}", lambda r: r.totals["CS_BAL"].select(F.col("CS_BAL").cast("double").alias("total")))
ruled("r03_bands_by_their_own_columns", f"SELECT n_regionkey, n_name, count(c_custkey) AS n, CASE WHEN grouping(n_regionkey) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END AS level {RULED} GROUP BY ROLLUP (n_regionkey, n_name)", lambda r: r.breaks.select("n_regionkey", "n_name", F.col("CS_N").alias("n"), "level"))
ruled("p10_value_of_the_list", f"SELECT c_custkey, FALSE AS is_noted {RULED} WHERE c_mktsegment = 'BUILDING'", lambda r: r.main.select("c_custkey", F.lit(noted(r, "P_SEG")).alias("is_noted")), P_SEG="BUILDING")
ruled("p10_value_outside_of_the_list", f"SELECT c_custkey, TRUE AS is_noted {RULED} WHERE c_mktsegment = 'FURNITURE'", lambda r: r.main.select("c_custkey", F.lit(noted(r, "P_SEG")).alias("is_noted")), P_SEG="FURNITURE")


@query("r04_no_second_totals", "SELECT c_mktsegment, count(*) AS n, FALSE AS is_added FROM customer GROUP BY ROLLUP (c_mktsegment)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A statement that has its totals among its rows gets none added."""
    report = b"""<report name="R"><data><dataSource name="Q"><select>SELECT c_mktsegment, COUNT(*) n FROM customer GROUP BY ROLLUP(c_mktsegment)</select><group name="G_S"><dataItem name="c_mktsegment"/></group><group name="G_N"><dataItem name="n" datatype="number"/></group></dataSource>
<summary name="CS_N" source="n" function="sum" reset="G_S"/></data></report>"""
    done = ran(spark, sf, report)
    return done.main.select("c_mktsegment", "n", F.lit(bool(done.totals) or done.breaks is not None).alias("is_added"))


@query("r24_hollow_parts", "SELECT * FROM (VALUES ('Q_P', FALSE, (SELECT count(*) FROM nation)), ('Q_D', TRUE, 0)) AS t(dataset, is_hollow, n_rows)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a report that came out without a row."""
    done = ran(spark, sf, master_detail(NATIONS, "n_nationkey", "SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = :n_nationkey AND c.c_acctbal > 1000000", "c_custkey"))
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), (F.col("n_rows") == 0).alias("is_hollow"), "n_rows") for name, df in done.datasets.items()]
    return reduce(DataFrame.union, parts)


@query("u02_arity_of_a_set_operation", "SELECT 'BLOCKER' AS bad, 'READY' AS good, n_nationkey AS k FROM nation UNION ALL SELECT 'BLOCKER', 'READY', r_regionkey FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Branches of unequal width stop a report before it runs; those of equal width run."""
    for name in TABLES:
        table(spark, sf, name).createOrReplaceTempView(name)
    wide, even = (ReportDef("R", datasets=(Dataset("Q", f"SELECT n_nationkey k{more} FROM nation UNION ALL SELECT r_regionkey FROM region"),)) for more in (", n_name", ""))
    verdicts = [quality.preflight(r, spark)[0] for r in (wide, even)]
    return engine.run(even, spark).main.select(F.lit(verdicts[0]).alias("bad"), F.lit(verdicts[1]).alias("good"), "k")


@query("x04_arity_of_a_call", "SELECT c_custkey, c_name || ';' AS v, TRUE AS is_refused FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A helper with as many arguments as it takes, and one with more, which is refused before it runs."""
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    refused = False
    try:
        binds.run(spark, "SELECT F_Add_Delimiter(c_name, ';', 1) FROM customer")
    except ValueError:
        refused = True
    return binds.run(spark, "SELECT c_custkey, F_Add_Delimiter(c_name, ';') v FROM customer").withColumn("is_refused", F.lit(refused))


@query("x05_helper_of_the_user", "SELECT c_custkey, c_name || '!' AS v, TRUE AS is_refused FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A helper that nobody supplied is refused; once it is supplied, it runs."""
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    sql, registry, refused = "SELECT c_custkey, Own_Pkg.F_Loud(c_name) v FROM customer", standard(), False
    try:
        binds.run(spark, sql, registry=registry)
    except ValueError:
        refused = True
    registry.add("F_Loud", 1, lambda x: f"concat({x}, '!')")
    return binds.run(spark, sql, registry=registry).withColumn("is_refused", F.lit(refused))


@query("x03_functions_over_tables", "SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'none ' || c_nationkey ELSE n_name END AS nation, (SELECT coalesce(string_agg(m.n_name, '; ' ORDER BY m.n_name), '') FROM nation m WHERE m.n_regionkey = c_nationkey) AS neighbours FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Helpers that read a table: a value by its key, and a list."""
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    table(spark, sf, "nation").where("n_nationkey % 4 <> 0").createOrReplaceTempView("nation_some")
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    registry = standard()
    registry.add_lookup("F_Nation_Name", "nation_some", "n_nationkey", "n_name", lambda x: f"concat('none ', {x})")
    registry.add_list("F_Nations_Of", "nation", ["n_regionkey"], "n_name")
    return binds.run(spark, "SELECT c.c_custkey, Geo.F_Nation_Name(c.c_nationkey) nation, Geo.F_Nations_Of(c.c_nationkey, '; ') neighbours FROM customer c", registry=registry)
