"""The queries of the report engine and their DuckDB SQL.

Each query works on whole tables. Those given as source-dialect text go through
the translator; the others call the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions.registry import standard
from bandwright.operators import breaks, burst, drill, links, matrix, present
from bandwright.plans import binds, criteria, engine, plsql, quality
from bandwright.plans.dialect import Dialect
from bandwright.plans.model import Dataset, Field, Formula, Group, Item, Param, ReportDef, Summary
from bandwright.sources import sql_source, tables

TABLES = "region nation customer supplier part orders lineitem events".split()
TYPES = {"o_orderdate": "date", "l_shipdate": "date", "ts": "date", "o_totalprice": "number", "c_acctbal": "number", "l_extendedprice": "number", "l_quantity": "number", "l_discount": "number", "p_size": "number", "p_retailprice": "number"}

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}
MONEY = "decimal(18,2)"


def query(name: str, oracle: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        f.__name__ = name
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(name: str, text: str, oracle: str, **values: object) -> None:
    """A query given in the source dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = {w.lower() for w in text.replace(",", " ").replace("(", " ").replace(")", " ").split()}
        for t in TABLES:
            if t in words:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return binds.run(spark, text, values, types=TYPES, now="timestamp_ntz'2001-06-15 10:30:00'")

    query(name, oracle)(run)


# ---- projections, binds, filters
source("p01_projection_alias", "SELECT n.n_nationkey AS nation_id, n.n_name nation_name, n.n_regionkey * 10 + 1 AS region_code FROM nation n", "SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey * 10 + 1 AS region_code FROM nation")
source("p05_wrapper_projection", "SELECT O.*, (SELECT COUNT(*) FROM nation n WHERE n.n_regionkey = O.r_regionkey) AS cf_nations FROM (SELECT r_regionkey, r_name FROM region) O", "SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS cf_nations FROM region")
source("p06_named_binds", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = :P_STATUS AND o_custkey <= :P_MAX", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey <= 500", P_STATUS="F", P_MAX=500)
source("p08_date_bind", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TO_DATE(:P_FROM, 'YYYY-MM-DD')", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-03-01'", P_FROM="1997-03-01")
source("w01_null_safe_filter_unset", "SELECT o_orderkey FROM orders WHERE (:P_STATUS IS NULL OR o_orderstatus = :P_STATUS)", "SELECT o_orderkey FROM orders")
source("w01_null_safe_filter_set", "SELECT o_orderkey FROM orders WHERE (:P_STATUS IS NULL OR o_orderstatus = :P_STATUS)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", P_STATUS="O")
source("w02_comparisons", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment LIKE 'B%') AND c_nationkey IS NOT NULL AND c_custkey BETWEEN 10 AND 900", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment LIKE 'B%') AND c_nationkey IS NOT NULL AND c_custkey BETWEEN 10 AND 900")
source("w17_exists_having", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY o_custkey HAVING COUNT(*) > 12)", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey GROUP BY o_custkey HAVING count(*) > 12)")
source("w17_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")


@query("p04_formula_column", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN CASE WHEN o_orderstatus = 'F' THEN 'big done' ELSE 'big' END WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS cf_band FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "function CF_Band return varchar2 is v varchar2(20) := 'small'; begin if :o_totalprice > 150000 then if :o_orderstatus = 'F' then v := 'big done'; else v := 'big'; end if; elsif :o_totalprice > 50000 then v := 'mid'; end if; return (v); end;"
    return table(spark, sf, "orders").select("o_orderkey", F.expr(plsql.formula(body, str.lower)).alias("cf_band"))


@query("p09_unset_parameters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.where(criteria.optional(F.col("c_mktsegment"), "=", "BUILDING") & criteria.optional(F.col("c_nationkey"), "=", None)).select("c_custkey")


@query("w06_criteria_text_like", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'MACH%' OR upper(c_name) LIKE 'MACH%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.where(criteria.text(" mach% ", F.col("c_mktsegment"), F.upper("c_name"))).select("c_custkey", "c_mktsegment")


@query("w07_criteria_number", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(criteria.number(7, F.col("c_nationkey"))).select("c_custkey")


@query("w08_criteria_range_both", "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 AND o_custkey <= 200")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(criteria.between(F.col("o_custkey"), 100, 200)).select("o_orderkey")


@query("w08_criteria_range_single", "SELECT o_orderkey FROM orders WHERE o_custkey = 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(criteria.between(F.col("o_custkey"), 100, None)).select("o_orderkey")


@query("w09_effective_dating", "SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, TIMESTAMP '1998-01-01') <= TIMESTAMP '1998-01-01' AND coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 365 DAY END, TIMESTAMP '1998-01-01') >= TIMESTAMP '1998-01-01'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    start = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    end = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 365 DAY"))
    return o.where(criteria.effective(start, end, F.expr("timestamp_ntz'1998-01-01 00:00:00'"))).select("o_orderkey")


@query("w10_literal_branches", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 700")
def _(spark: SparkSession, sf: str) -> DataFrame:
    test = criteria.branches(("F", F.col("o_orderstatus") == "F"), (None, F.col("o_orderpriority") == "1-URGENT"), (700, F.col("o_custkey") < 700))
    return table(spark, sf, "orders").where(test).select("o_orderkey")


@query("w11_concat_exists_case", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    where = criteria.fragment("EXISTS (", "SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey", ("P_STATUS", " AND o.o_orderstatus = :P_STATUS", ""), ")", P_STATUS="P")
    return binds.run(spark, "SELECT c_custkey FROM customer c WHERE &P_WHERE", {"P_STATUS": "P"}, lexicals={"P_WHERE": where})


@query("w13_lexical_default", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    return binds.run(spark, "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY &P_ORDER) pos FROM customer", lexicals={"P_ORDER": "c_acctbal DESC, c_custkey"})


@query("w15_drill_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return drill.filtered(table(spark, sf, "orders"), {"P_O_CUSTKEY": 42, "P_O_ORDERSTATUS": None}).select("o_orderkey", "o_totalprice")


@query("w16_outer_filter_in_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderstatus == "P"), "left").select("c_custkey", "o_orderkey")


@query("w18_visibility_trigger", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN FALSE WHEN o_totalprice > 100000 THEN TRUE ELSE FALSE END AS is_visible FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "function F_1 return boolean is begin if :o_orderstatus = 'P' then return (FALSE); elsif :o_totalprice > 100000 then return (TRUE); else return (FALSE); end if; end;"
    return table(spark, sf, "orders").select("o_orderkey", F.expr(plsql.visibility(body, str.lower)).alias("is_visible"))


@query("w20_condition_label", "SELECT o_orderkey, coalesce((o_orderstatus = 'F' AND o_totalprice > 1000.5) OR (o_orderpriority NOT LIKE '1%' AND o_custkey BETWEEN 5 AND 50), FALSE) AS is_marked FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    test = present.condition("(o_orderstatus = 'F' AND o_totalprice > 1000.5) OR (o_orderpriority NOT LIKE '1%' AND o_custkey BETWEEN 5 AND 50)")
    return table(spark, sf, "orders").select("o_orderkey", test.alias("is_marked"))


# ---- joins
source("j01_outer_plus", "SELECT c.c_custkey, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND c.c_nationkey = 3", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3")
source("j02_outer_plus_literal", "SELECT n.n_name, c.c_custkey, o.o_orderkey FROM nation n, customer c, orders o WHERE n.n_nationkey = c.c_nationkey(+) AND c.c_mktsegment(+) = 'BUILDING' AND c.c_custkey = o.o_custkey(+) AND o.o_totalprice(+) > 300000", "SELECT n_name, c_custkey, o_orderkey FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment = 'BUILDING' LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
source("j03_comma_join", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
source("j17_semi_anti", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5)", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5)")


@query("j04_cross_product", "SELECT r_name, m.c_mktsegment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) m")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "customer").select("c_mktsegment").distinct())


@query("j05_lookup_first", "SELECT c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.lookup(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), [("c_custkey", "o_custkey")], {"first_order": "o_orderkey"}, ["o_orderdate", "o_orderkey"])


@query("j06_lookup_set_join", "SELECT r_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.lookup_list(table(spark, sf, "region").select("r_regionkey"), table(spark, sf, "nation"), [("r_regionkey", "n_regionkey")], "n_name", "nations", ["n_nationkey"], "|")


@query("j07_composite_key", f"SELECT o_custkey, o_orderstatus, CAST(count(o2) AS BIGINT) AS n_same FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) a LEFT JOIN (SELECT o_custkey AS c2, o_orderstatus AS s2, o_orderkey AS o2 FROM orders WHERE o_totalprice > 200000) b ON o_custkey = c2 AND o_orderstatus = s2 GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    master = o.select("o_custkey", "o_orderstatus").distinct()
    child = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c2"), F.col("o_orderstatus").alias("s2"))
    return links.lookup_count(master, child, [("o_custkey", "c2"), ("o_orderstatus", "s2")], "n_same")


@query("j10_two_hop", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chain = [(table(spark, sf, "nation"), [("c_nationkey", "n_nationkey")], {"n_name": "n_name", "n_regionkey": "n_regionkey"}, ["n_nationkey"]), (table(spark, sf, "region"), [("n_regionkey", "r_regionkey")], {"r_name": "r_name"}, ["r_regionkey"])]
    return links.hops(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), chain).select("c_custkey", "n_name", "r_name")


@query("j11_lookup_count", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.lookup_count(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")], "n_orders")


@query("j12_cross_query_subtotal", f"SELECT n_nationkey, CAST(coalesce(sum(CAST(c_acctbal AS {MONEY})), 0) AS DOUBLE) AS balance FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = links.subtotal(table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "customer"), [("n_nationkey", "c_nationkey")], F.sum(F.col("c_acctbal").cast(MONEY)), "balance")
    return out.withColumn("balance", F.coalesce(F.col("balance").cast("double"), F.lit(0.0)))


FIRST_FETCH = "SELECT c_custkey, last_price FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS last_price FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey) ON c_custkey = o_custkey"


@query("j13_cursor_first_fetch", FIRST_FETCH)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return links.first_fetch(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), [("c_custkey", "o_custkey")], "o_totalprice", "last_price", [F.col("o_orderdate").desc_nulls_last()])


source("j13_keep_first", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o.o_orderdate DESC NULLS LAST) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_price FROM customer c", FIRST_FETCH)
source("j13_lateral_first", "SELECT c.c_custkey, f.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey FETCH FIRST 1 ROWS ONLY) f", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ON c_custkey = o_custkey")


@query("j15_burst_recipients_join", "SELECT DISTINCT o_custkey, c_name AS address, TRUE AS can_send FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return burst.recipients(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "c_name")


@query("j19_range_join", "SELECT o_orderkey, count(*) AS n_early FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("until"))
    joined = links.range_join(table(spark, sf, "lineitem"), o, [("l_orderkey", "o_orderkey")], "l_shipdate", "o_orderdate", "until")
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n_early"))


@query("j20_recursive_hierarchy", 'WITH RECURSIVE h AS (SELECT n_nationkey, n_name, 1 AS "level" FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_name, h."level" + 1 FROM nation n JOIN h ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 3 = h.n_nationkey) SELECT n_nationkey, n_name, "level" FROM h')
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    n.withColumn("parent", F.expr("case when n_nationkey > 0 then (n_nationkey - 1) div 3 end")).createOrReplaceTempView("nation_tree")
    return binds.run(spark, "SELECT n_nationkey, n_name, LEVEL FROM nation_tree START WITH n_nationkey = 0 CONNECT BY PRIOR n_nationkey = parent")


# ---- aggregates, breaks, matrices
source("g01_sum", f"SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS {MONEY})) AS double) total FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag")
source("g02_avg", "SELECT l_linestatus, ROUND(AVG(l_quantity), 4) mean FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY l_linestatus")
source("g03_count", "SELECT c_nationkey, COUNT(NULLIF(c_mktsegment, 'BUILDING')) n_other, COUNT(*) n_all FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, count(nullif(c_mktsegment, 'BUILDING')) AS n_other, count(*) AS n_all FROM customer GROUP BY c_nationkey")
source("g04_min_max", "SELECT p_brand, MIN(p_size) least_size, MAX(p_retailprice) top_price FROM part GROUP BY p_brand", "SELECT p_brand, min(p_size) AS least_size, max(p_retailprice) AS top_price FROM part GROUP BY p_brand")
source("g06_count_distinct", "SELECT l_suppkey, COUNT(DISTINCT l_partkey) n_parts FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey")
source("g07_stats", "SELECT p_brand, ROUND(STDDEV_SAMP(p_size), 4) sd, ROUND(STDDEV_POP(p_size), 4) sdp, ROUND(VAR_SAMP(p_size), 4) va, ROUND(VAR_POP(p_size), 4) vap FROM part GROUP BY p_brand", "SELECT p_brand, round(stddev_samp(p_size), 4) AS sd, round(stddev_pop(p_size), 4) AS sdp, round(var_samp(p_size), 4) AS va, round(var_pop(p_size), 4) AS vap FROM part GROUP BY p_brand")
source("g08_median_corr", "SELECT p_brand, MEDIAN(p_size) mid, ROUND(CORR(p_size, p_retailprice), 4) co, ROUND(COVAR_POP(p_size, p_retailprice), 2) cp FROM part GROUP BY p_brand", "SELECT p_brand, median(p_size) AS mid, round(corr(p_size, p_retailprice), 4) AS co, round(covar_pop(p_size, p_retailprice), 2) AS cp FROM part GROUP BY p_brand")
source("g09_listagg", "SELECT n_regionkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
source("g18_group_having", "SELECT o_custkey, COUNT(*) n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
for _kind, _name in (("ROLLUP", "g19_rollup"), ("CUBE", "g19_cube")):
    source(_name, f"SELECT o_orderstatus, o_orderpriority, COUNT(*) n, GROUPING(o_orderstatus) g1, GROUPING(o_orderpriority) g2 FROM orders GROUP BY {_kind}(o_orderstatus, o_orderpriority)", f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY {_kind}(o_orderstatus, o_orderpriority)")
source("g19_grouping_sets", "SELECT c_mktsegment, c_nationkey, COUNT(*) n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("g05_first_last", "SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority FROM orders GROUP BY o_custkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(breaks.aggregate("first", F.col("o_orderpriority"), order).alias("first_priority"), breaks.aggregate("last", F.col("o_orderpriority"), order).alias("last_priority"))


@query("g12_pct_of_total", f"SELECT o_orderpriority, round(CAST(sum(CAST(o_totalprice AS {MONEY})) / sum(sum(CAST(o_totalprice AS {MONEY}))) OVER () AS DOUBLE), 6) AS share FROM orders GROUP BY o_orderpriority")
def _(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("v"))
    return breaks.share(by, "v", "share").select("o_orderpriority", "share")


BREAK = f"""WITH d AS (SELECT n_name, c_mktsegment, CAST(o_totalprice AS {MONEY}) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT n_name, c_mktsegment, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n_orders, 2 - grouping(n_name) - grouping(c_mktsegment) AS level,
CASE 2 - grouping(n_name) - grouping(c_mktsegment) WHEN 0 THEN 'grand total' WHEN 2 THEN 'group' ELSE 'subtotal' END AS row_type FROM d GROUP BY ROLLUP(n_name, c_mktsegment)"""


def _break_report(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return breaks.levels(rows, ["n_name", "c_mktsegment"], [F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"), F.count("*").alias("n_orders")])


query("g13_break_two_levels", BREAK)(_break_report)


@query("g14_grand_total", f"SELECT CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS total, count(*) AS n FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("total"), F.count("*").alias("n"))


@query("g15_cross_dataset_total", f"SELECT n_name, (SELECT CAST(sum(CAST(s_acctbal AS {MONEY})) AS DOUBLE) FROM supplier) AS supplier_total FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "supplier").agg(F.sum(F.col("s_acctbal").cast(MONEY)).cast("double").alias("supplier_total"))
    return table(spark, sf, "nation").select("n_name").crossJoin(F.broadcast(total))  # one row


@query("g16_summary_of_summary", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_segments, max(n) AS largest FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY c_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    inner = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return inner.groupBy("c_nationkey").agg(F.count("c_mktsegment").alias("n_segments"), F.max("n").alias("largest"))


@query("g20_rollup_labels", f"SELECT row_label, n_orders FROM (SELECT CASE level WHEN 0 THEN 'All orders' WHEN 1 THEN 'Subtotal ' || n_name ELSE c_mktsegment END AS row_label, n_orders FROM ({BREAK}))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return breaks.labelled(_break_report(spark, sf), ["n_name", "c_mktsegment"], "All orders").select("row_label", "n_orders")


def _matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"), F.col("l_quantity").cast(MONEY).alias("q"))


CELLS = "CAST(sum(CAST(l_quantity AS decimal(18,2))) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS f, CAST(sum(CAST(l_quantity AS decimal(18,2))) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS o"


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


@query("g21_matrix", f"SELECT l_returnflag, {CELLS} FROM lineitem GROUP BY l_returnflag")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(matrix.matrix(_matrix_rows(spark, sf), ["l_returnflag"], "l_linestatus", ["F", "O"], "q", names=["f", "o"]), "f", "o")


@query("g22_matrix_count", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.matrix(_matrix_rows(spark, sf), ["l_returnflag"], "l_linestatus", ["F", "O"], "q", "count", ["f", "o"])


@query("g23_matrix_margins", f"SELECT l_returnflag, {CELLS}, CAST(sum(CAST(l_quantity AS decimal(18,2))) AS DOUBLE) AS row_total, grouping(l_returnflag) = 1 AS is_total FROM lineitem GROUP BY ROLLUP(l_returnflag)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(matrix.matrix(_matrix_rows(spark, sf), ["l_returnflag"], "l_linestatus", ["F", "O"], "q", names=["f", "o"], margins=True), "f", "o", "row_total")


@query("g24_matrix_banded", f"SELECT year(l_shipdate) AS ship_year, l_returnflag, {CELLS} FROM lineitem GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(matrix.matrix(_matrix_rows(spark, sf).withColumn("ship_year", F.col("ship_year").cast("long")), ["ship_year", "l_returnflag"], "l_linestatus", ["F", "O"], "q", names=["f", "o"]), "f", "o")


@query("g26_cross_product_matrix", "SELECT a.l_returnflag, b.l_linestatus, n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON a.l_returnflag = c.l_returnflag AND b.l_linestatus = c.l_linestatus")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.cross_product(_matrix_rows(spark, sf), [["l_returnflag"], ["l_linestatus"]], [F.count("*").alias("n")])


@query("g27_chart_series", f"SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS value FROM orders GROUP BY o_orderpriority")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").cast(MONEY).alias("v"))
    return _doubles(matrix.chart(rows, "o_orderpriority", "v"), "value")


@query("g28_nested_fold", "SELECT r_name, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS leaves FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _(spark: SparkSession, sf: str) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    fold = breaks.folded(n.join(r, n.n_regionkey == r.r_regionkey), ["r_name"], ["n_nationkey", "n_name"], "leaf")
    return fold.select("r_name", F.array_join(F.transform("leaf", lambda x: F.concat_ws(":", x["n_nationkey"], x["n_name"])), ",").alias("leaves"))


# ---- windows and pages
def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return present.numbered(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])


ROW_NO = "row_number() OVER (ORDER BY o_orderkey)"


@query("n01_row_band", f"SELECT o_orderkey, CAST({ROW_NO} AS INT) AS row_no, {ROW_NO} % 2 = 0 AS is_tinted FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return present.banded(_numbered(spark, sf)).select("o_orderkey", "row_no", "is_tinted")


@query("n02_running_total_reset", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS {MONEY})) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice").cast(MONEY))
    return _doubles(breaks.running(rows, "v", "running", ["o_orderdate", "o_orderkey"], ["o_custkey"]), "running").select("o_orderkey", "running")


@query("n03_print_once", "SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) = 1 THEN c_nationkey END AS c_nationkey_shown, CASE WHEN row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_mktsegment, c_custkey) = 1 THEN c_mktsegment END AS c_mktsegment_shown FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = breaks.print_once(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], ["c_mktsegment", "c_custkey"])
    return out.select("c_custkey", "c_nationkey_shown", "c_mktsegment_shown")


@query("n04_continuation", f"SELECT o_orderkey, page_no > min(page_no) OVER (PARTITION BY o_orderstatus) AS is_continued FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(({ROW_NO} - 1) / 25) + 1 AS INT) AS page_no FROM orders)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return present.continued(present.paged(_numbered(spark, sf), 25), ["o_orderstatus"]).select("o_orderkey", "is_continued")


@query("n05_records_per_page", f"SELECT o_orderkey, CAST(floor(({ROW_NO} - 1) / 25) + 1 AS INT) AS page_no FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return present.paged(_numbered(spark, sf), 25).select("o_orderkey", "page_no")


@query("n06_label_tiles", f"SELECT o_orderkey, CAST(({ROW_NO} - 1) % 3 + 1 AS INT) AS tile_column, CAST(floor(({ROW_NO} - 1) / 3) + 1 AS INT) AS tile_row FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return present.tiled(_numbered(spark, sf), 3).select("o_orderkey", "tile_column", "tile_row")


@query("n08_page_globals", "SELECT 'Page ' || page_no || ' of ' || max(page_no) OVER () AS page_text, n FROM (SELECT CAST(floor((rn - 1) / 40) + 1 AS INT) AS page_no, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = present.paged(_numbered(spark, sf), 40).groupBy("page_no").agg(F.count("*").alias("n"))
    last = pages.agg(F.max("page_no").alias("last"))
    return pages.crossJoin(F.broadcast(last)).select(F.concat(F.lit("Page "), "page_no", F.lit(" of "), "last").alias("page_text"), "n")


source("n09_ratio_to_report", "SELECT c_custkey, ROUND(RATIO_TO_REPORT(c_acctbal) OVER (PARTITION BY c_nationkey), 6) ratio FROM customer", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 6) AS ratio FROM customer")

# ---- sorting, limits, set operations
source("o01_order_ordinal", "SELECT n_name, n_regionkey FROM nation ORDER BY 2 DESC, 1", "SELECT n_name, n_regionkey FROM nation")
source("o02_sort_selector", "SELECT c_custkey, DECODE(:P_SORT, 'SEG', c_mktsegment, 'NAME', c_name) sort_key FROM customer", "SELECT c_custkey, c_mktsegment AS sort_key FROM customer", P_SORT="SEG")
source("o04_nulls_order", "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY NULLIF(c_mktsegment, 'BUILDING') DESC, c_custkey) pos FROM customer", "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_custkey) AS pos FROM customer")
source("o05_rownum_topn", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) WHERE ROWNUM <= 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
source("o05_rownum_unordered_subset", "SELECT COUNT(*) n FROM (SELECT o_orderkey FROM orders WHERE ROWNUM < 8 ORDER BY o_orderkey)", "SELECT CAST(7 AS BIGINT) AS n")
source("o06_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
source("o07_offset_fetch", "SELECT n_name FROM nation ORDER BY n_name OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT n_name FROM nation ORDER BY n_name LIMIT 7 OFFSET 5")
source("u01_union_all", "SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
source("u01_union", "SELECT c_nationkey k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
source("u01_intersect", "SELECT c_nationkey k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier")
source("u01_minus", "SELECT n_nationkey k FROM nation MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
source("u03_fallback_branch", "SELECT o_orderkey k FROM orders WHERE o_orderstatus = 'none' UNION ALL SELECT -1 FROM DUAL WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'none')", "SELECT CAST(-1 AS BIGINT) AS k")

# ---- scalar functions
source("d01_nvl", "SELECT o_orderkey, NVL(NULLIF(o_orderstatus, 'P'), 'none') v FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS v FROM orders")
source("d02_nvl2", "SELECT o_orderkey, NVL2(NULLIF(o_orderstatus, 'P'), 'set', 'unset') v FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'set' ELSE 'unset' END AS v FROM orders")
source("d03_coalesce", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), NULLIF(o_orderpriority, '5-LOW'), 'x') v FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), nullif(o_orderpriority, '5-LOW'), 'x') AS v FROM orders")
source("d04_decode_null", "SELECT o_orderkey, DECODE(NULLIF(o_orderstatus, 'P'), NULL, 'none', 'F', 'fin', 'other') v FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_orderstatus = 'F' THEN 'fin' ELSE 'other' END AS v FROM orders")
source("d05_case_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END v, CASE WHEN o_totalprice > 100000 THEN 'high' END w FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS v, CASE WHEN o_totalprice > 100000 THEN 'high' END AS w FROM orders")
source("d07_greatest_least", "SELECT p_partkey, GREATEST(NULLIF(p_size, 7), 20) g, LEAST(NULLIF(p_size, 7), 20) l FROM part", "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE greatest(p_size, 20) END AS g, CASE WHEN p_size = 7 THEN NULL ELSE least(p_size, 20) END AS l FROM part")
source("d10_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%A_L%' AND p_name NOT LIKE 'z%'", "SELECT p_partkey FROM part WHERE p_type LIKE '%A_L%' AND p_name NOT LIKE 'z%'")
source("d20_concat_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'P') || '-' || o_orderpriority v, NULLIF(o_orderstatus, 'P') || NULLIF(o_orderstatus, 'P') w FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') || '-' || o_orderpriority AS v, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || o_orderstatus END AS w FROM orders")
source("d21_substr", "SELECT p_partkey, SUBSTR(p_name, 3, 4) a, SUBSTR(p_name, 5) b, SUBSTR(p_name, 0, 2) c FROM part", "SELECT p_partkey, substr(p_name, 3, 4) AS a, substr(p_name, 5) AS b, substr(p_name, 1, 2) AS c FROM part")
source("d22_substr_negative", "SELECT p_partkey, SUBSTR(p_name, -3) a, SUBSTR(p_name, -4, 2) b FROM part", "SELECT p_partkey, right(p_name, 3) AS a, substr(p_name, -4, 2) AS b FROM part")
source("d23_instr", "SELECT p_partkey, INSTR(p_name, 'a') a, INSTR(p_name, 'a', 3) b, INSTR(p_name, 'a', 1, 2) c FROM part", "SELECT p_partkey, instr(p_name, 'a') AS a, CASE WHEN instr(substr(p_name, 3), 'a') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'a') + 2 END AS b, CASE WHEN instr(p_name, 'a') = 0 OR instr(substr(p_name, instr(p_name, 'a') + 1), 'a') = 0 THEN 0 ELSE instr(p_name, 'a') + instr(substr(p_name, instr(p_name, 'a') + 1), 'a') END AS c FROM part")
source("d24_length", "SELECT p_partkey, LENGTH(p_name) a, LENGTHB(p_type) b FROM part", "SELECT p_partkey, length(p_name) AS a, strlen(p_type) AS b FROM part")
source("d25_case_funcs", "SELECT p_partkey, UPPER(p_name) u, LOWER(p_type) l, INITCAP(p_type) i FROM part", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS i FROM part")
source("d26_trim_charset", "SELECT o_orderkey, LTRIM(o_orderpriority, '15-') a, RTRIM(o_orderpriority, 'TWH') b, TRIM('  ' || o_orderstatus || ' ') c FROM orders", "SELECT o_orderkey, ltrim(o_orderpriority, '15-') AS a, rtrim(o_orderpriority, 'TWH') AS b, o_orderstatus AS c FROM orders")
source("d27_replace", "SELECT o_orderkey, REPLACE(o_orderpriority, '-', ' / ') a, REPLACE(o_orderpriority, 'LOW') b FROM orders", "SELECT o_orderkey, replace(o_orderpriority, '-', ' / ') AS a, replace(o_orderpriority, 'LOW', '') AS b FROM orders")
source("d28_pad", "SELECT c_custkey, LPAD(c_mktsegment, 12, '*') a, RPAD(c_mktsegment, 5) b, LPAD(TO_CHAR(c_custkey), 8, '0') c FROM customer", "SELECT c_custkey, lpad(c_mktsegment, 12, '*') AS a, rpad(c_mktsegment, 5, ' ') AS b, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS c FROM customer")
source("d29_chr", "SELECT n_nationkey, CHR(65 + n_nationkey) v FROM nation", "SELECT n_nationkey, chr(65 + n_nationkey) AS v FROM nation")
source("d30_regexp_like", "SELECT p_partkey FROM part WHERE REGEXP_LIKE(p_brand, '#[12][0-9]$')", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12][0-9]$')")
source("d31_regexp_replace", "SELECT p_partkey, REGEXP_REPLACE(p_type, '[AEIOU]', '_') a, REGEXP_REPLACE(p_type, '[^A-Z]') b FROM part", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS a, regexp_replace(p_type, '[^A-Z]', '', 'g') AS b FROM part")
source("d32_to_char_number", "SELECT l_orderkey, l_linenumber, TO_CHAR(l_quantity) q FROM lineitem", "SELECT l_orderkey, l_linenumber, regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS q FROM lineitem")
source("d33_url_escape", "SELECT p_partkey, Pkg.F_Url_Escape(p_type) v FROM part", "SELECT p_partkey, replace(p_type, ' ', '%20') AS v FROM part")
source("d34_address_phone", "SELECT c_custkey, Pkg.F_Phone(LPAD(TO_CHAR(c_custkey), 10, '5')) phone, Pkg.F_Address(c_name, NULL, c_mktsegment, 'NY', '10001') addr FROM customer", "SELECT c_custkey, '(' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7, 4) AS phone, c_name || ', ' || c_mktsegment || ', NY 10001' AS addr FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS p FROM customer)")
source("d35_add_delimiter", "SELECT o_orderkey, F_Add_Delimiter(NULLIF(o_orderstatus, 'P'), ', ') v FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus || ', ' ELSE '' END AS v FROM orders")
source("d40_sysdate", "SELECT o_orderkey, TO_CHAR(SYSDATE, 'YYYY-MM-DD HH24:MI') v, CASE WHEN o_orderdate < SYSDATE THEN 'old' ELSE 'new' END age FROM orders", "SELECT o_orderkey, '2001-06-15 10:30' AS v, CASE WHEN o_orderdate < TIMESTAMP '2001-06-15 10:30:00' THEN 'old' ELSE 'new' END AS age FROM orders")
source("d64_date_arithmetic", "SELECT o_orderkey, TO_CHAR(o_orderdate + 30, 'YYYY-MM-DD') later, TO_CHAR(SYSDATE - 1/24, 'YYYY-MM-DD HH24:MI') an_hour_ago, TRUNC(SYSDATE) - TRUNC(o_orderdate) days FROM orders WHERE o_orderdate - 7 < SYSDATE - 400", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS later, '2001-06-15 09:30' AS an_hour_ago, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-15') AS DOUBLE) AS days FROM orders WHERE o_orderdate - INTERVAL 7 DAY < TIMESTAMP '2001-06-15 10:30:00' - INTERVAL 400 DAY")
source("d41_to_date", "SELECT o_orderkey, TO_CHAR(TO_DATE(TO_CHAR(o_orderdate, 'DD/MM/YYYY'), 'DD/MM/YYYY'), 'YYYY-MM-DD') v FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
source("d42_to_char_date", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'MM/DD/YYYY') a, TO_CHAR(o_orderdate, 'YYYY\"-Q\"Q') b FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS a, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS b FROM orders")
_D = "CAST(CAST({} AS DATE) AS VARCHAR)"
source("d43_trunc_date", "SELECT o_orderkey, TO_CHAR(TRUNC(o_orderdate, 'MM'), 'YYYY-MM-DD') m, TO_CHAR(TRUNC(o_orderdate, 'YYYY'), 'YYYY-MM-DD') y, TO_CHAR(TRUNC(o_orderdate), 'YYYY-MM-DD') d FROM orders", f"SELECT o_orderkey, {_D.format("date_trunc('month', o_orderdate)")} AS m, {_D.format("date_trunc('year', o_orderdate)")} AS y, {_D.format('o_orderdate')} AS d FROM orders")
source("d44_round_date", "SELECT o_orderkey, TO_CHAR(ROUND(o_orderdate, 'MM'), 'YYYY-MM-DD') m, TO_CHAR(ROUND(o_orderdate, 'YYYY'), 'YYYY-MM-DD') y FROM orders", f"SELECT o_orderkey, {_D.format("date_trunc('month', o_orderdate) + CASE WHEN day(o_orderdate) >= 16 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END")} AS m, {_D.format("date_trunc('year', o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN INTERVAL 12 MONTH ELSE INTERVAL 0 MONTH END")} AS y FROM orders")
source("d45_add_months", "SELECT o_orderkey, CAST(ADD_MONTHS(o_orderdate, 1) AS string) v FROM orders", f"SELECT o_orderkey, {_D.format("CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH) ELSE o_orderdate + INTERVAL 1 MONTH END")} AS v FROM orders")
source("d46_months_between", "SELECT o_orderkey, ROUND(MONTHS_BETWEEN(TO_DATE('2000-06-15', 'YYYY-MM-DD'), CAST(o_orderdate AS date)), 4) v FROM orders", "SELECT o_orderkey, round((2000 - year(o_orderdate)) * 12 + (6 - month(o_orderdate)) + (15 - day(o_orderdate)) / 31.0, 4) AS v FROM orders")
source("d47_next_day", "SELECT o_orderkey, CAST(NEXT_DAY(o_orderdate, 'MONDAY') AS string) v FROM orders", f"SELECT o_orderkey, {_D.format("CAST(o_orderdate AS DATE) + CAST((7 - isodow(o_orderdate)) % 7 + 1 AS INT)")} AS v FROM orders")
source("d48_last_day", "SELECT o_orderkey, CAST(LAST_DAY(o_orderdate) AS string) v FROM orders", "SELECT o_orderkey, CAST(last_day(o_orderdate) AS VARCHAR) AS v FROM orders")
source("d50_long_date", "SELECT o_orderkey, F_Long_Date(o_orderdate) v FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS v FROM orders")
source("d51_masks_date", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'DD-Mon-YYYY') a, TO_CHAR(o_orderdate, 'fmMonth DD, YYYY') b, TO_CHAR(o_orderdate, 'Dy DD.MM.YY') c FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%d-%b-%Y') AS a, strftime(o_orderdate, '%B %-d, %Y') AS b, strftime(o_orderdate, '%a %d.%m.%y') AS c FROM orders")
source("d52_spelled_case", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'DD-MON-YYYY') a, TO_CHAR(o_orderdate, 'day') b FROM orders", "SELECT o_orderkey, upper(strftime(o_orderdate, '%d-%b-%Y')) AS a, lower(strftime(o_orderdate, '%A')) AS b FROM orders")
source("d60_round", f"SELECT o_orderkey, CAST(ROUND(CAST(o_totalprice AS {MONEY}), 1) AS double) v, CAST(ROUND(CAST(o_totalprice AS {MONEY})) AS double) w FROM orders", f"SELECT o_orderkey, CAST(round(CAST(o_totalprice AS {MONEY}), 1) AS DOUBLE) AS v, CAST(round(CAST(o_totalprice AS {MONEY}), 0) AS DOUBLE) AS w FROM orders")
source("d61_trunc_number", "SELECT c_custkey, CAST(TRUNC(c_acctbal) AS double) a, CAST(TRUNC(-c_acctbal) AS double) b FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS DOUBLE) + 0.0 AS a, CAST(trunc(-c_acctbal) AS DOUBLE) + 0.0 AS b FROM customer")
source("d62_floor_ceil_abs_sign", "SELECT c_custkey, CAST(FLOOR(c_acctbal) AS bigint) f, CAST(CEIL(c_acctbal) AS bigint) c, ABS(c_acctbal) a, CAST(SIGN(c_acctbal) AS int) s FROM customer", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
source("d63_power_mod", "SELECT p_partkey, POWER(p_size, 2) a, MOD(-p_size, 7) b, MOD(p_size, 0) c FROM part", "SELECT p_partkey, power(p_size, 2) AS a, -p_size % 7 AS b, p_size AS c FROM part")
source("d65_to_number", "SELECT o_orderkey, CAST(TO_NUMBER(SUBSTR(o_orderpriority, 1, 1)) AS double) a, TO_NUMBER(o_orderstatus) b FROM orders", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM orders")
source("d66_masks_number", "SELECT l_orderkey, l_linenumber, TO_CHAR(l_extendedprice, '$NNN,NN0.00') a, TO_CHAR(l_quantity, '000099') b, TO_CHAR(l_extendedprice, '9G999G999') c FROM lineitem", "SELECT l_orderkey, l_linenumber, '$' || format('{:,.2f}', CAST(l_extendedprice AS decimal(18,2))) AS a, lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 6, '0') AS b, format('{:,}', CAST(round(CAST(l_extendedprice AS decimal(38,10)), 0) AS BIGINT)) AS c FROM lineitem")
source("d67_unknown_mask", "SELECT p_partkey, TO_CHAR(p_size, 'XYZ?') v FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v FROM part")


# ---- formulas and presentation
@query("e07_placeholder_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END AS cp_state, CASE WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Open' END || '/' || o_orderpriority AS cp_text FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "begin if :o_orderstatus = 'F' then :CP_State := 'Closed'; else :CP_State := 'Open'; end if; :CP_Text := :CP_State || '/' || :o_orderpriority; return (1); end;"
    found = plsql.Compiler(Dialect(), str.lower).compile(body).placeholders
    return table(spark, sf, "orders").select("o_orderkey", F.expr(found["CP_STATE"]).alias("cp_state"), F.expr(found["CP_TEXT"]).alias("cp_text"))


@query("e13_style_trigger", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'red' END AS text_color, CASE WHEN o_totalprice > 200000 THEN 'bold' END AS font_weight FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "function F_2 return boolean is begin if :o_totalprice > 200000 then srw.set_text_color('red'); srw.set_font_weight('bold'); end if; return (TRUE); end;"
    styles = plsql.Compiler(Dialect(), str.lower).compile(body).styles
    return table(spark, sf, "orders").select("o_orderkey", *(F.expr(v).alias(k) for k, v in styles.items()))


@query("e15_conditional_format", "SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'red' WHEN o_orderstatus = 'P' OR o_orderpriority LIKE '1%' THEN 'blue' END AS color FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("o_totalprice >= 250000", {"color": "red"}), ("o_orderstatus = 'P' OR o_orderpriority LIKE '1%'", {"color": "blue"})]
    return table(spark, sf, "orders").select("o_orderkey", F.try_element_at(present.styled(rules), F.lit("color")).alias("color"))


@query("e18_token_text", "SELECT c_custkey, 'Dear ' || c_name || ' (' || c_mktsegment || '), &unknown' AS body FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", present.token_text("Dear &C_NAME (&<C_MKTSEGMENT>), &unknown", c.columns).alias("body"))


@query("r02_stat_sections", "SELECT 'segments' AS section, c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT 'priorities', o_orderpriority, count(*) FROM orders GROUP BY 1, 2 UNION ALL SELECT 'segments', 'Total', count(*) FROM customer UNION ALL SELECT 'priorities', 'Total', count(*) FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    def section(name: str, df: DataFrame, key: str) -> DataFrame:
        rows = breaks.levels(df, [key], [F.count("*").alias("n")])
        return rows.select(F.lit(name).alias("section"), F.when(F.col("level") == 0, "Total").otherwise(F.col(key)).alias("category"), "n")

    return section("segments", table(spark, sf, "customer"), "c_mktsegment").unionByName(section("priorities", table(spark, sf, "orders"), "o_orderpriority"))


@query("r05_drill_link", "SELECT c_custkey, 'R_ORDERS?P_CUSTKEY=' || c_custkey || '&P_SEGMENT=' || c_mktsegment AS link FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", drill.link_text("R_ORDERS", {"P_CUSTKEY": "c_custkey", "P_SEGMENT": "c_mktsegment"}).alias("link"))


@query("r09_burst_recipients", "SELECT DISTINCT c_nationkey, CASE WHEN s_name IS NULL THEN FALSE ELSE TRUE END AS can_send FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("mail"))
    key = burst.burst_key(["c_name", "c_nationkey"], "'out_'||:c_nationkey||'.pdf'")
    return burst.recipients(table(spark, sf, "customer"), people, key, "s_nationkey", "mail").select("c_nationkey", "can_send")


@query("r10_burst_filename", "SELECT n_nationkey, 'notice_' || n_nationkey || '_' || n_name || '.pdf' AS file FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", burst.file_name("notice_<N_NATIONKEY>_<N_NAME>.pdf", n.columns).alias("file"))


@query("r12_idempotent_resend", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey")
    done = n.where("n_nationkey % 3 = 0").withColumn("delivered", F.lit(True))
    failed = n.where("n_nationkey % 5 = 1").withColumn("delivered", F.lit(False))
    return burst.pending(n, done.union(failed).union(failed).union(failed), "n_nationkey")


@query("r30_secondary_breakdown", "SELECT 'main' AS section, n_name AS category, CAST(1 AS BIGINT) AS n FROM nation UNION ALL SELECT 'by region', r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'total', 'Nations listed', count(*) FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    main = n.select(F.lit("main").alias("section"), F.col("n_name").alias("category"), F.lit(1).cast("long").alias("n"))
    by = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count("*").alias("n")).select(F.lit("by region").alias("section"), F.col("r_name").alias("category"), "n")
    total = n.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("Nations listed").alias("category"), "n")
    return main.unionByName(by).unionByName(total)


@query("r35_labelled_parameter", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Status: Final' WHEN o_orderstatus <> 'P' THEN 'Status: ' || o_orderstatus END AS line FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The line that a parameter's value gives, for the value of each row."""
    body = "begin if :P_STATUS = 'F' then return ('Status: ' || 'Final'); elsif :P_STATUS is null then return (null); else return ('Status: ' || :P_STATUS); end if; end;"
    return table(spark, sf, "orders").select("o_orderkey", F.expr(plsql.formula(body, lambda n: "nullif(o_orderstatus, 'P')")).alias("line"))


def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "begin if :P_STATUS = 'F' then return ('Status: ' || 'Final'); elsif :P_STATUS is null then return (null); else return ('Status: ' || :P_STATUS); end if; end;"
    return spark.range(1).select(F.expr(plsql.formula(body, lambda n: "'F'")).alias("line"))


# ---- definitions and their checks
SAMPLE = """Q_CUSTOMER
SELECT c.c_custkey, c.c_name, NVL(c.c_mktsegment, 'none') segment FROM customer c WHERE (:P_SEGMENT IS NULL OR c.c_mktsegment = :P_SEGMENT) ORDER BY c.c_name;

Q_ORDERS
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o, nation n WHERE o.o_custkey = :C_CUSTKEY AND n.n_nationkey(+) = 1;
"""


def _sample() -> ReportDef:
    return sql_source.report("SAMPLE", sql_source.named(SAMPLE))


def _sample_with(**parts: object) -> ReportDef:
    return replace(_sample(), **parts)


def _ran_sample(spark: SparkSession, sf: str, **parts: object) -> engine.Result:
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return engine.run(_sample_with(**parts), spark)


def _rows_of(done: engine.Result) -> DataFrame:
    """(dataset, n_rows) of a run."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows") for name, df in done.datasets.items()]
    return reduce(DataFrame.union, counts)


source("a11_dual", "SELECT c.c_custkey, d.one, d.text, (SELECT 2 FROM DUAL) two FROM customer c, (SELECT 1 one, 'x' || NULL text FROM DUAL) d", "SELECT c_custkey, 1 AS one, 'x' AS text, 2 AS two FROM customer")


@query("a04_sql_text_source", "SELECT 'Q_CUSTOMER' AS dataset, c_custkey AS k, coalesce(c_mktsegment, 'none') AS v FROM customer UNION ALL SELECT 'Q_ORDERS', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of both datasets of a text of named statements."""
    done = _ran_sample(spark, sf).datasets
    first = done["Q_CUSTOMER"].select(F.lit("Q_CUSTOMER").alias("dataset"), F.col("c_custkey").alias("k"), F.col("segment").alias("v"))
    return first.union(done["Q_ORDERS"].select(F.lit("Q_ORDERS"), "o_orderkey", F.col("o_custkey").cast("string")))


def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(d.name, ",".join(i.name for i in d.items)) for d in _sample().datasets], "dataset string, columns string")


@query("j08_inferred_link", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A count over the columns that the link was found to join on."""
    link = _sample().links[0]
    return links.lookup_count(table(spark, sf, "customer"), table(spark, sf, "orders"), link.pairs, "n").select("c_custkey", "n")


def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(link.parent, link.child, ",".join(f"{a}={b}" for a, b in link.pairs)) for link in _sample().links], "parent string, child string, pairs string")


@query("w05_master_detail_run", f"SELECT c_custkey, c_name, coalesce(c_mktsegment, 'none') AS segment, count(o_orderkey) AS n_q_orders, CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2, 3")
def _(spark: SparkSession, sf: str) -> DataFrame:
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast(MONEY)).createOrReplaceTempView("orders")
    report = replace(_sample(), summaries=(Summary("spent", "o_totalprice", "sum", "report"),))
    out = engine.run(report, spark, P_SEGMENT="BUILDING").main
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return out.withColumn("spent", F.col("spent").cast("double"))


@query("r14_fidelity_score", "SELECT CAST(0.8571 AS DOUBLE) AS score, 'assisted' AS tier, count(*) AS n_rows FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What of the definition is among the columns of its run, and how many rows that has."""
    main = _ran_sample(spark, sf).main
    score = quality.fidelity(_sample(), [*main.columns, "o_orderkey", "o_custkey"])
    return main.agg(F.count("*").alias("n_rows")).select(F.lit(score).alias("score"), F.lit(quality.effort("READY", score)).alias("tier"), "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    score = quality.fidelity(_sample(), ["c_custkey", "c_name", "segment", "o_orderkey", "o_custkey"])
    return spark.createDataFrame([(score, quality.effort("READY", score))], "score double, tier string")


@query("r16_complexity", "SELECT 12 AS score, (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n_rows")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The score of a definition beside the rows that its queries read."""
    return _rows_of(_ran_sample(spark, sf)).agg(F.sum("n_rows").alias("n_rows")).select(F.lit(quality.complexity(_sample())).alias("score"), "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(quality.complexity(_sample()),)], "score int")


@query("r17_report_diff", "SELECT * FROM (VALUES ('query', 'Q_ORDERS', 'changed', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P'), (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')), ('query', 'Q_CUSTOMER', 'removed', (SELECT count(*) FROM customer), 0), ('formula', 'CF_1', 'added', 0, 0)) AS t(part, name, change, rows_gone, rows_new)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The changed parts of a definition, and for a query the rows that only one of its two forms gives."""
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    q = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> '{}'"
    old = ReportDef("R", datasets=(Dataset("Q_ORDERS", q.format("O")), Dataset("Q_CUSTOMER", "SELECT c_custkey FROM customer")))
    new = ReportDef("R", datasets=(Dataset("Q_ORDERS", q.format("P")),), formulas=(Formula("CF_1", "begin return 1; end;"),))
    return quality.changed_rows(spark, old, new)


def _(spark: SparkSession, sf: str) -> DataFrame:
    old = _sample()
    new = replace(old, datasets=(replace(old.datasets[0], sql="SELECT 1 FROM DUAL"),), formulas=(Formula("CF_1", "begin return 1; end;"),))
    return spark.createDataFrame(quality.diff(old, new), "part string, name string, change string")


@query("r20_leftover_lint", "SELECT text, leftover, n_rows FROM (VALUES ('source', 'NVL'), ('source', '(+)')) AS t(text, leftover), (SELECT count(*) AS n_rows FROM customer)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the source dialect before and after translation, beside the rows that the translation gives."""
    rows = [("source", x) for d in _sample().datasets for x in quality.lint(d.sql)]
    rows += [("translated", x) for d in _sample().datasets for x in quality.lint(Dialect().query(d.sql))]
    total = _ran_sample(spark, sf).main.agg(F.count("*").alias("n_rows"))
    return spark.createDataFrame(rows, "text string, leftover string").crossJoin(F.broadcast(total))


def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("source", x) for d in _sample().datasets for x in quality.lint(d.sql)]
    rows += [("translated", x) for d in _sample().datasets for x in quality.lint(Dialect().query(d.sql))]
    return spark.createDataFrame(rows, "text string, leftover string")


@query("r23_preflight", "SELECT 'READY' AS verdict, 'Q_CUSTOMER' AS dataset, count(*) AS n_rows FROM customer UNION ALL SELECT 'READY', 'Q_ORDERS', count(*) FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of the checks that come before a run, and what the run then gives."""
    done = _rows_of(_ran_sample(spark, sf))
    return done.select(F.lit(quality.preflight(_sample(), spark)[0]).alias("verdict"), "dataset", "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.createDataFrame([(quality.preflight(_sample(), spark)[0],)], "verdict string")


@query("a09_stub_table", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS a FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A table beside one that is missing and gets an empty stand-in."""
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    tables.stub(spark, "not_there", ["a", "b"])
    return binds.run(spark, "SELECT c.c_custkey, x.a FROM customer c, not_there x WHERE TO_CHAR(c.c_custkey) = x.b(+)")


def _(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.stub(spark, "not_there", ["a", "b"])
    return df.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(df.columns)))


@query("a12_fuller_dataset", "SELECT n_nationkey, n_name FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the fuller of two forms of one dataset."""
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    chosen = sql_source.better(Dataset("Q", "SELECT n_nationkey FROM nation WHERE n_nationkey IS NOT NULL"), Dataset("Q", "SELECT n_nationkey, n_name FROM nation"))
    return binds.run(spark, chosen.sql)


def _(spark: SparkSession, sf: str) -> DataFrame:
    chosen = sql_source.better(Dataset("Q", "SELECT a FROM t WHERE a IS NOT NULL"), Dataset("Q", "SELECT a, b FROM t"))
    return spark.createDataFrame([(chosen.sql,)], "chosen string")


@query("a13_synthetic_rows", "SELECT CAST(range + 1 AS INT) AS ID, 'NAME ' || range AS NAME FROM range((SELECT count(*) FROM customer))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """As many made-up rows as a table has."""
    return tables.synthetic(spark, [Item("ID", "number", precision=9), Item("NAME")], table(spark, sf, "customer").count())


def _(spark: SparkSession, sf: str) -> DataFrame:
    return tables.synthetic(spark, [Item("ID", "number", precision=9), Item("NAME")], 5)


@query("p03_realias_by_name", "SELECT CAST(n_nationkey AS INT) AS nation_key, n_name FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("NATION_KEY"))
    return tables.declared(rows, [Item("nation_key", "number", precision=9), Item("n_name")])


@query("w04_link_decorrelation", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LEFT JOIN nation ON n_nationkey = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A detail's statement without the predicate that became the join, run for all parents at once."""
    for t in ("orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    report = _sample()
    return spark.sql(Dialect().query(engine.without_link(report.dataset("Q_ORDERS"), report)))


def _(spark: SparkSession, sf: str) -> DataFrame:
    report = _sample()
    text = Dialect().query(engine.without_link(report.dataset("Q_ORDERS"), report))
    return spark.createDataFrame([(text,)], "text string")


@query("w14_lexical_without_value", "SELECT count(*) AS n, 'RED: &P_WHERE has no value, its rows are not filtered' AS note FROM nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").createOrReplaceTempView("nation")
    dialect = Dialect()
    return spark.sql(dialect.query("SELECT COUNT(*) n FROM nation WHERE &P_WHERE")).withColumn("note", F.lit(dialect.notes[0]))


@query("w19_parameter_trigger", "SELECT r_regionkey, FALSE AS is_visible FROM region")
def _(spark: SparkSession, sf: str) -> DataFrame:
    text = plsql.visibility("begin if :P_DETAIL = 'N' then return (FALSE); end if; return (TRUE); end;", lambda n: "'N'")
    return table(spark, sf, "region").select("r_regionkey", F.expr(text).alias("is_visible"))  # a constant, folded by the optimizer


@query("w21_package_constant", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    registry = standard()
    registry.constants["K_FINAL"] = "F"
    return binds.run(spark, "SELECT o_orderkey FROM orders WHERE o_orderstatus = Pkg.F_Val('K_FINAL')", registry=registry)


@query("j16_main_dataset", "SELECT 'Q_CUSTOMER' AS main, count(*) AS n_rows FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset that the report repeats, and its rows."""
    name = _sample().main().name
    return _rows_of(_ran_sample(spark, sf)).where(F.col("dataset") == name).select(F.col("dataset").alias("main"), "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_sample().main().name,)], "main string")


@query("g10_unbound_summary", "SELECT 'CS_X: nothing to sum for no_column' AS note, count(*) AS n_rows FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A summary without its column is noted, and the rows come all the same."""
    done = _ran_sample(spark, sf, summaries=(Summary("CS_X", "no_column"),))
    note = next(n for n in done.notes if n.startswith("CS_X"))
    return done.main.agg(F.count("*").alias("n_rows")).select(F.lit(note).alias("note"), "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    notes = engine.run(replace(_sample(), summaries=(Summary("CS_X", "no_column"),)), spark).notes
    return spark.createDataFrame([(n,) for n in notes if n.startswith("CS_X")], "note string")


@query("g11_reset_scope", f"SELECT n_regionkey, n_name, CAST(sum(CAST(c_acctbal AS {MONEY})) AS DOUBLE) AS at_nation, CAST(sum(sum(CAST(c_acctbal AS {MONEY}))) OVER (PARTITION BY n_regionkey) AS DOUBLE) AS at_region FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name")
def _(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).withColumn("v", F.col("c_acctbal").cast(MONEY))
    report = ReportDef("R", datasets=(Dataset("Q", "", groups=(Group("G_REGION", ("n_regionkey",)), Group("G_NATION", ("n_name",)))),))
    nation = breaks.summary(rows, "sum", "v", report.level("G_NATION"), "at_nation")
    region = breaks.summary(rows, "sum", "v", report.level("G_REGION"), "at_region")
    return _doubles(nation.join(region, "n_regionkey"), "at_nation", "at_region")


@query("n07_page_scoped_print", f"SELECT o_orderkey, page_no > 1 AS is_printed FROM (SELECT o_orderkey, floor(({ROW_NO} - 1) / 25) + 1 AS page_no FROM orders)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return present.print_on(present.paged(_numbered(spark, sf), 25), "allButFirstPage").select("o_orderkey", "is_printed")


source("e09_named_arguments", "SELECT o_orderkey, F_Add_Delimiter(p_text => o_orderstatus, p_mark => ';') v FROM orders", "SELECT o_orderkey, o_orderstatus || ';' AS v FROM orders")


@query("e16_parameter_placeholder", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'From ' || year(o_orderdate) || ' for FINAL' ELSE 'All' END AS heading FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The placeholder that a parameter trigger sets, for the values of each row."""
    body = "begin if :P_STATUS = 'F' then :CP_TITLE := 'From ' || :P_YEAR || ' for FINAL'; else :CP_TITLE := 'All'; end if; return (TRUE); end;"
    values = {"P_STATUS": "o_orderstatus", "P_YEAR": "year(o_orderdate)"}
    return table(spark, sf, "orders").select("o_orderkey", F.expr(plsql.Compiler(Dialect(), values.__getitem__).compile(body).placeholders["CP_TITLE"]).alias("heading"))


def _(spark: SparkSession, sf: str) -> DataFrame:
    body = "begin if :P_STATUS = 'F' then :CP_TITLE := 'From ' || :P_YEAR || ' for FINAL'; else :CP_TITLE := 'All'; end if; return (TRUE); end;"
    values = {"P_STATUS": "'F'", "P_YEAR": "1997"}
    return spark.range(1).select(F.expr(plsql.Compiler(Dialect(), values.__getitem__).compile(body).placeholders["CP_TITLE"]).alias("heading"))


@query("r06_drill_child_run", "SELECT c_custkey, count(o_orderkey) AS n_q_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 42 GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    for t in ("customer", "orders", "nation"):
        table(spark, sf, t).createOrReplaceTempView(t)
    return drill.filtered(engine.run(_sample(), spark).main, {"P_C_CUSTKEY": 42}).select("c_custkey", "n_q_orders")


@query("r08_burst_detection", "SELECT c_custkey, count(*) AS n_rows FROM customer GROUP BY 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each recipient, by the key that the report is cut by; no rows unless it is made for distribution."""
    report = ReportDef("R", (Param("P_DISTRIBUTE"),))
    rows = table(spark, sf, "customer")
    key = burst.burst_key(rows.columns)
    return rows.where(F.lit(burst.is_burst(report) and not burst.is_drill_through(report, ["P_X"]))).groupBy(key).agg(F.count("*").alias("n_rows"))


def _(spark: SparkSession, sf: str) -> DataFrame:
    report = ReportDef("R", (Param("P_DISTRIBUTE"),))
    row = (burst.is_burst(report), burst.is_drill_through(report, ["P_X"]), burst.burst_key(["CF_1", "NAME", "CUST_ID"]))
    return spark.createDataFrame([row], "is_burst boolean, is_drill boolean, key string")


@query("r13_batch", "SELECT 'SAMPLE' AS report, 'READY' AS verdict, 12 AS complexity, count(*) AS n_rows FROM customer UNION ALL SELECT 'BROKEN', 'BLOCKER', 7, CAST(NULL AS BIGINT)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Several definitions: those that pass the checks are run."""
    out = []
    for r in (_sample(), ReportDef("BROKEN", datasets=(Dataset("Q", "SELECT a FROM t, u WHERE a = b(+)"),))):
        verdict = quality.preflight(r)[0]
        rows = _ran_sample(spark, sf).main if verdict == "READY" else spark.range(0)
        n = F.count("*") if verdict == "READY" else F.lit(None).cast("long")
        out.append(rows.agg(n.alias("n_rows")).select(F.lit(r.name).alias("report"), F.lit(verdict).alias("verdict"), F.lit(quality.complexity(r)).alias("complexity"), "n_rows"))
    return out[0].union(out[1])


def _(spark: SparkSession, sf: str) -> DataFrame:
    reports = [_sample(), ReportDef("BROKEN", datasets=(Dataset("Q", "SELECT a FROM t, u WHERE a = b(+)"),))]
    return spark.createDataFrame([(r.name, quality.preflight(r)[0], quality.complexity(r)) for r in reports], "report string, verdict string, complexity int")


@query("r15_coverage", "SELECT 'c_name' AS field, 'shown' AS status, count(c_name) AS n_values FROM customer UNION ALL SELECT 'missing_field', 'missing', 0 UNION ALL SELECT 'nothing', 'hollow', 0")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Each visible field: whether the output has its column, and how many values that has."""
    done = _ran_sample(spark, sf, fields=(Field("F_1", "c_name"), Field("F_2", "missing_field"), Field("F_3", "gone", visible=False), Field("F_4", "nothing")))
    return quality.field_values(_sample_with(fields=(Field("F_1", "c_name"), Field("F_2", "missing_field"), Field("F_3", "gone", visible=False), Field("F_4", "nothing"))), done.main.withColumn("nothing", F.lit(None).cast("string")))


def _(spark: SparkSession, sf: str) -> DataFrame:
    report = replace(_sample(), fields=(Field("F_1", "c_name"), Field("F_2", "missing_field"), Field("F_3", "gone", visible=False)))
    return spark.createDataFrame([(m,) for m in quality.coverage(report, ["c_custkey", "c_name"])], "missing string")


@query("r18_document_drift", "SELECT CAST(0.3333 AS DOUBLE) AS drift, TRUE AS is_other_query, count(*) AS n_rows FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The share of documented columns that a run does not give."""
    main = _ran_sample(spark, sf).main
    score = quality.drift(["c_custkey", "c_name", "c_phone"], main.columns)
    return main.agg(F.count("*").alias("n_rows")).select(F.lit(score).alias("drift"), F.lit(score > 0.3).alias("is_other_query"), "n_rows")


def _(spark: SparkSession, sf: str) -> DataFrame:
    score = quality.drift(["c_custkey", "c_name", "c_phone"], [i.name for i in _sample().datasets[0].items])
    return spark.createDataFrame([(score, score > 0.3)], "drift double, is_other_query boolean")


@query("r19_audit_trail", "SELECT 'Q_CUSTOMER' AS dataset, 'NVL' AS rewritten, count(*) AS n_rows FROM customer UNION ALL SELECT 'Q_ORDERS', '(+)', count(*) FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """What was rewritten in each dataset's statement, beside the rows that it gives."""
    rows = [(d.name, x) for d in _sample().datasets for x in quality.audit(d.sql, Dialect().query(d.sql))]
    return spark.createDataFrame(rows, "dataset string, rewritten string").join(_rows_of(_ran_sample(spark, sf)), "dataset")


def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(d.name, x) for d in _sample().datasets for x in quality.audit(d.sql, Dialect().query(d.sql))]
    return spark.createDataFrame(rows, "dataset string, rewritten string")


@query("r25_no_rows_message", "SELECT 'No rows match' AS message")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus = 'none'")
    return spark.range(1 if quality.hollow(rows) else 0).select(F.lit("No rows match").alias("message"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from bandwright import catalog_definitions, catalog_details  # noqa: F401  they add their queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from bandwright import catalog_definitions, catalog_details  # noqa: F401

    return dict(_oracles)
