"""Details run for each parent row, the order of evaluation, scans, intervals and matrices on small frames."""

import random
from decimal import Decimal

import pytest
from bandwright import catalog, catalog_details  # noqa: F401
from bandwright.operators import breaks, links, matrix, pages, present
from bandwright.plans import detail, engine
from bandwright.plans.model import Dataset, Formula, Group, Link, Matrix, ReportDef, Summary
from bandwright.sources import xml_source
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def masters(spark):
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int").createOrReplaceTempView("masters")
    spark.createDataFrame([(1, 10, "a"), (1, 11, "x"), (2, 20, "a"), (2, 21, "b"), (None, 30, "a")], "mid int, v int, t string").createOrReplaceTempView("details")
    spark.createDataFrame([(1, 11), (2, 20)], "mid int, v int").createOrReplaceTempView("others")


def lists(spark, sql, pairs=(("ID", ""),), **values):
    """The values of a detail's column v by master."""
    report = ReportDef("R", datasets=(Dataset("P", "SELECT id FROM masters"), Dataset("D", sql)), links=(Link("P", "D", pairs),))
    done = engine.run(report, spark, **values)
    column = next(c for c in done.datasets["D"].columns if c.startswith("_link_") or c.lower() == "mid")
    out = {}
    for r in done.datasets["D"].collect():
        out.setdefault(r[column], []).append(r.v)
    assert {r.id: r.n_d for r in done.main.collect()} == {i: len(out.get(i, [])) for i in (1, 2, 3, None)} or column.lower() == "mid"
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT d.v FROM details d WHERE d.mid = :id AND ROWNUM <= 1 AND d.t = 'a'", {1: [10], 2: [20]}),
        ("SELECT d.v FROM details d WHERE d.mid = :id ORDER BY d.v DESC FETCH FIRST 1 ROWS ONLY", {1: [11], 2: [21]}),
        ("SELECT d.v FROM details d WHERE d.mid = :id ORDER BY d.v DESC OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", {1: [10], 2: [20]}),
        ("SELECT * FROM (SELECT d.v FROM details d WHERE d.mid = :id ORDER BY d.v) WHERE ROWNUM < 2", {1: [10], 2: [20]}),
        ("SELECT ROW_NUMBER() OVER (ORDER BY d.v) v FROM details d WHERE d.mid = :id", {1: [1, 2], 2: [1, 2]}),
        ("SELECT d.v FROM details d WHERE d.t = 'x' OR d.mid = :id", {1: [10, 11], 2: [11, 20, 21], 3: [11], None: [11]}),
        ("SELECT d.v FROM details d WHERE NOT (d.mid = :id)", {1: [20, 21], 2: [10, 11], 3: [10, 11, 20, 21]}),
        ("SELECT d.v FROM details d WHERE NVL(d.mid, 3) = :id", {1: [10, 11], 2: [20, 21], 3: [30]}),
        ("SELECT d.v FROM details d WHERE d.mid + 0 = :id", {1: [10, 11], 2: [20, 21]}),
        ("SELECT d.v FROM details d WHERE EXISTS (SELECT 1 FROM others o WHERE o.v = d.v AND o.mid = :id)", {1: [11], 2: [20]}),
        ("SELECT d.v FROM details d WHERE d.v IN (SELECT o.v FROM others o WHERE o.mid = :id)", {1: [11], 2: [20]}),
        ("SELECT d.v FROM (SELECT e.v FROM details e WHERE e.mid = :id) d WHERE EXISTS (SELECT 1 FROM others o WHERE o.mid = :id AND o.v = d.v)", {1: [11], 2: [20]}),
        ("SELECT d.v + :id v FROM details d WHERE d.mid = :id", {1: [11, 12], 2: [22, 23]}),
        ("SELECT d.v FROM details d WHERE (:id IS NULL OR d.mid = :id) AND d.t <> 'b'", {1: [10, 11], 2: [20], None: [10, 11, 20, 30]}),
        ("SELECT d.v FROM details d WHERE d.mid <= :id", {1: [10, 11], 2: [10, 11, 20, 21], 3: [10, 11, 20, 21]}),
        ("SELECT d.v FROM details d WHERE :id BETWEEN d.mid AND d.mid + 1", {1: [10, 11], 2: [10, 11, 20, 21], 3: [20, 21]}),
        ("SELECT d.v FROM details d WHERE d.mid = :id UNION ALL SELECT o.v FROM others o WHERE o.mid = :id AND ROWNUM = 1", {1: [10, 11, 11], 2: [20, 20, 21]}),
    ],
)
def test_a_detail_is_run_for_each_parent_row(spark, masters, sql, want):
    assert lists(spark, sql) == want


@pytest.mark.parametrize(
    ("sql", "least", "most"),
    [
        ("SELECT v FROM many WHERE mid = :id ORDER BY w DESC, v FETCH FIRST 1 ROWS ONLY", 0, 1),
        ("SELECT v FROM many m WHERE m.mid = :id ORDER BY m.w DESC, v OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY", 1, 3),
        ("SELECT * FROM (SELECT m.v FROM many m WHERE m.mid = :id ORDER BY m.w DESC, m.v) WHERE ROWNUM <= 2", 0, 2),
        ("SELECT d.v + 0 v FROM (SELECT * FROM (SELECT m.v FROM many m WHERE m.mid = :id ORDER BY -m.w, 1) x) d WHERE ROWNUM <= 2 AND d.v >= 0 ORDER BY d.v", 0, 2),
        ("SELECT SUM(d.v) v FROM (SELECT m.v, m.w weight FROM many m WHERE m.mid = :id ORDER BY weight DESC, m.v) d WHERE ROWNUM <= 1", 0, 1),
    ],
)
def test_a_limit_of_each_parent_row_is_by_sort_keys_that_are_not_selected(spark, masters, sql, least, most):
    rows = [(1 + v % 2, v, v * 7919 % 997) for v in range(3000)]
    spark.createDataFrame(rows, "mid int, v int, w int").repartition(7).createOrReplaceTempView("many")
    want = {k: sorted(v for _, v, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[least:most]) for k in (1, 2)}
    report = ReportDef("R", datasets=(Dataset("P", "SELECT id FROM masters"), Dataset("D", sql)), links=(Link("P", "D", (("ID", ""),)),))
    done = engine.run(report, spark)
    got = lists(spark, sql) if "SUM" not in sql else {r["_link_id"]: [r.v] for r in done.datasets["D"].where("v IS NOT NULL").collect()}
    assert got == want
    plan = done.datasets["D"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and ("w#" in plan or "bw_o0" in plan)  # the rows are numbered by the keys, not by what a sort before a shuffle leaves


def test_a_declared_link_is_part_of_a_limited_detail(spark, masters):
    assert lists(spark, "SELECT d.mid, d.v FROM details d WHERE d.t = 'a' OR d.t = 'b' ORDER BY d.v DESC FETCH FIRST 1 ROWS ONLY", (("ID", "mid"),)) == {1: [10], 2: [21]}


def test_which_details_a_join_can_take():
    keys = {"ID"}
    assert detail.is_plain("SELECT v FROM d WHERE d.mid = :ID AND d.t = 'x' ORDER BY v", keys)
    for sql in ("SELECT v FROM d WHERE mid = :ID OR v = 1", "SELECT v FROM d WHERE v BETWEEN 1 AND mid = :ID", "SELECT v FROM d WHERE mid = :ID AND ROWNUM = 1", "SELECT v FROM (SELECT v FROM d WHERE mid = :ID)", "SELECT :ID v FROM d WHERE mid = :ID"):
        assert not detail.is_plain(sql, keys)
    assert detail.interval("SELECT v FROM d WHERE :ID BETWEEN a AND b OR v = 1", "ID") is None
    assert detail.interval("SELECT COUNT(*) FROM d WHERE :ID BETWEEN a AND b", "ID") is None
    assert detail.interval("SELECT v FROM d WHERE a <= :ID AND :ID < NVL(b, :ID) AND v > 1", "ID").is_open


def report_of(formulas=(), summaries=(), body="SELECT g, h, id, v FROM amounts"):
    groups = (Group("G", ("g",), "Q"), Group("H", ("h",), "Q"), Group("I", ("id", "v"), "Q"))
    return ReportDef("R", datasets=(Dataset("Q", body, groups=groups),), formulas=tuple(Formula(n, f"begin return {x}; end;", "Q") for n, x in formulas), summaries=summaries)


def test_formulas_run_in_the_order_of_need(spark):
    spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 2, 30), ("b", 1, 3, 5), ("b", 1, 4, None)], "g string, h int, id int, v int").createOrReplaceTempView("amounts")
    sums = (Summary("CS_G", "v", "sum", "G", "G"), Summary("CS_H", "v", "sum", "H"), Summary("CS_MAX", "CS_H", "maximum", "G"), Summary("CS_ALL", "CS_MAX", "sum", "report"))
    done = engine.run(report_of((("CF_A", ":CF_B + 1"), ("CF_B", ":CF_C * 2"), ("CF_C", ":v + :CS_G"), ("CF_T", ":CS_ALL")), sums), spark)
    assert {r.id: (r.CF_A, r.CF_T) for r in done.main.collect()} == {1: (101, 35), 2: (141, 35), 3: (21, 35), 4: (None, 35)}
    assert {r.g: r.CS_MAX for r in done.totals["CS_MAX"].collect()} == {"a": 30, "b": 5}
    assert done.totals["CS_ALL"].first().CS_ALL == 35


def test_cycles_are_noted(spark):
    spark.createDataFrame([("a", 1, 1, 10)], "g string, h int, id int, v int").createOrReplaceTempView("amounts")
    done = engine.run(report_of((("CF_A", ":CF_B + 1"), ("CF_B", ":CF_A + 1"), ("CF_OK", ":v + 1"))), spark)
    row = done.main.first()
    assert (row.CF_A, row.CF_B, row.CF_OK) == (None, None, 11)
    assert any("a cycle" in n for n in done.notes)


def test_one_aggregation_a_link(spark, masters):
    report = ReportDef("R", datasets=(Dataset("P", "SELECT id FROM masters"), Dataset("D", "SELECT d.mid, d.v, d.t FROM details d WHERE d.mid = :id")), links=(Link("P", "D", (("ID", "mid"),)),), summaries=tuple(Summary(f"S{i}", "v", f) for i, f in enumerate(("sum", "minimum", "maximum", "average", "first"))))
    main = engine.run(report, spark).main
    assert {r.id: (r.S0, r.S1, r.S2, r.S3, r.S4, r.n_d) for r in main.collect()}[1] == (21, 10, 11, 10.5, 10, 2)
    plan = main._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1


@pytest.mark.parametrize("function", ["sum", "count", "min", "max"])
def test_running_totals_over_many_partitions(spark, function):
    random.seed(3)
    rows = [(i, random.choice("aaaaab") if i % 7 else None, random.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for reset in ([], ["g"]):
            got = {r.i: r.x for r in breaks.running(df, "v", "x", ["i"], reset, function).collect()}
            seen = {}
            for i, g, v in rows:
                have = seen.setdefault(g if reset else 0, [])
                have += [v] if v is not None else []
                want = len(have) if function == "count" else {"sum": sum, "min": min, "max": max}[function](have) if have else None
                assert got[i] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = breaks.running(df, "v", "x", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    present.let_go()


def test_empty_frames(spark):
    none = spark.createDataFrame([], "i int, g string, v int")
    assert breaks.running(none, "v", "x", ["i"], ["g"]).count() == 0
    assert pages.flowed(none, ["g"], ["g", "i"], 3).count() == 0
    assert links.interval_join(none, none.select(F.col("i").alias("a"), F.col("v").alias("b")), "v", "a", "b").count() == 0


def test_pages_flow_by_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)] + [(None, 0)], "g string, i int")
    got = {(r.g, r.i): (r.page_no, r.page_of_group) for r in pages.flowed(df, ["g"], [F.col("g").asc_nulls_last(), "i"], 2).collect()}
    assert got == {("a", 0): (1, 1), ("a", 1): (1, 1), ("a", 2): (2, 2), ("a", 3): (2, 2), ("a", 4): (3, 3), ("b", 0): (4, 1), ("b", 1): (4, 1), (None, 0): (5, 1)}


@pytest.mark.parametrize("is_open", [False, True])
def test_interval_join_is_a_nested_loop_without_one(spark, is_open):
    random.seed(5)
    points = [(i, random.choice([None, 0, random.randint(-50, 50), random.random() * 1000])) for i in range(150)]
    spans = []
    for i in range(150):
        a = random.choice([None, random.randint(-60, 60), random.random() * 1000])
        spans.append((i, a, None if random.random() < 0.1 else (a or 0) + random.choice([-1, 0, 0.001, 3, 700])))
    p = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in points], "i int, at double")
    s = spark.createDataFrame([(j, None if a is None else float(a), None if b is None else float(b)) for j, a, b in spans], "j int, low double, high double")
    joined = links.interval_join(p, s, "at", "low", "high", high_is_open=is_open)
    want = sorted((i, j) for i, v in points for j, a, b in spans if v is not None and (a is None or a <= v) and (b is None or (v < b if is_open else v <= b)) and (a is None or b is None or a <= b))
    assert sorted((r.i, r.j) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matrix_of_nested_columns_keeps_null(spark):
    df = spark.createDataFrame([("r", "x", 1, 5), ("r", "x", None, 7), ("q", None, 1, 2)], "a string, c string, d int, m int")
    df.createOrReplaceTempView("cells")
    report = ReportDef("R", datasets=(Dataset("Q", "SELECT a, c, d, m FROM cells"),), matrices=(Matrix("X", ("a",), "c", (), "m", columns=("c", "d"), cells=(("m", "sum"), ("m", "count"))), Matrix("Y", ("nope",), "c", (), "m")))
    done = engine.run(report, spark)
    got = {r.a: r.asDict() for r in done.matrices["X"].collect()}
    assert (got["r"]["x/1 sum m"], got["r"]["x/(null) sum m"], got["q"]["(null)/1 sum m"], got["r"]["(null)/1 count m"]) == (5, 7, 2, 0)
    assert any("no column nope" in n for n in done.notes)
    margins = matrix.crosstab(df, ["a"], ["c", "d"], [("x", 1), ("x", None), (None, 1)], [("m", "sum", "")], margins=True)
    totals = {r.a: r.asDict() for r in margins.collect()}
    assert (totals["r"]["x total"], totals[None]["row_total"], totals["q"]["(null) total"]) == (12, 14, 2)


def test_several_cells_and_the_band_come_from_the_layout():
    data = b"""<report name="M"><data><dataSource name="Q"><select>SELECT a, b, c, m, n FROM v</select><group name="G_B"><dataItem name="b"/></group><group name="G_A"><dataItem name="a"/><dataItem name="c"/></group></dataSource>
<summary name="CS" source="n" function="average"/></data><layout><repeatingFrame source="G_B"><matrix name="X"><matrixRow><field source="a"/></matrixRow><matrixCol><field source="c"/><field source="m"/></matrixCol><matrixCell><field source="m"/><field source="CS"/></matrixCell></matrix></repeatingFrame></layout></report>"""
    m = xml_source.parse(data).matrices[0]
    assert (m.band, m.across, m.measures) == (("b",), ("c", "m"), (("m", "sum"), ("n", "average")))


# ---- hierarchies, files
def test_ways_of_a_hierarchy(spark):
    from bandwright.plans import binds
    from bandwright.plans.dialect import Unsupported

    spark.createDataFrame([(1, None, "r"), (2, 1, "b"), (3, 1, "a"), (4, 2, "z"), (5, 3, "y"), (6, 3, None)], "i int, p int, n string").createOrReplaceTempView("tree")
    rows = binds.run(spark, "SELECT t.i, LEVEL, SYS_CONNECT_BY_PATH(n, '/') way, CONNECT_BY_ROOT n, CONNECT_BY_ISLEAF leaf, PRIOR i up FROM tree t WHERE t.i <> 3 START WITH t.p IS NULL CONNECT BY PRIOR t.i = t.p ORDER SIBLINGS BY n DESC").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "/r", "r", 0, None), (2, 2, "/r/b", "r", 0, 1), (4, 3, "/r/b/z", "r", 1, 2), (6, 3, "/r/a/", "r", 1, 3), (5, 3, "/r/a/y", "r", 1, 3)]
    limited = binds.run(spark, "SELECT i FROM tree START WITH i = 1 CONNECT BY PRIOR i = p AND LEVEL < :P_N AND n <> 'b'", {"P_N": 3})
    assert sorted(r.i for r in limited.collect()) == [1, 3]
    for sql in ("SELECT i FROM tree CONNECT BY LEVEL > 2", "SELECT i FROM (SELECT i FROM tree START WITH i = 1 CONNECT BY NOCYCLE PRIOR i = p)"):
        with pytest.raises(Unsupported):
            binds.run(spark, sql)


@pytest.mark.parametrize("folder", [False, True])
def test_a_forest_is_climbed_without_ways(spark, tmp_path, monkeypatch, folder):
    """One table of (row, ancestor, distance) is kept, and no list of rows; rows below a cycle are not found."""
    from bandwright.operators import hierarchy
    from bandwright.plans import binds

    monkeypatch.setattr(hierarchy, "connect_by", None)
    if folder:
        monkeypatch.setattr(hierarchy, "_folder", lambda _: str(tmp_path / "c"))
    chain = [(k, k - 1 if k % 50 else None, f"n{k}") for k in range(120)]
    rows = [*chain, (500, 501, "x"), (501, 500, "y"), (502, 500, "z"), (600, 999, "no parent"), (700, 3, "twig")]
    spark.createDataFrame(rows, "i int, p int, n string").repartition(3).createOrReplaceTempView("chains")
    sql = "SELECT i, LEVEL depth, CONNECT_BY_ROOT n top, CONNECT_BY_ISLEAF leaf, PRIOR i up FROM chains START WITH p IS NULL CONNECT BY PRIOR i = p"
    want = sorted([(k, k % 50 + 1, f"n{k - k % 50}", int(k % 50 == 49 or k == 119), p) for k, p, _ in chain] + [(700, 5, "n0", 1, 3)], key=str)
    assert sorted((tuple(r) for r in binds.run(spark, sql).collect()), key=str) == want
    short = [(i, d, t, int(leaf or d == 6), u) for i, d, t, leaf, u in want if d <= 6]
    assert sorted((tuple(r) for r in binds.run(spark, f"{sql} AND LEVEL <= 6").collect()), key=str) == sorted(short, key=str)
    if folder:
        assert len(list((tmp_path / "c").iterdir())) == 2 * 3  # of each run the rows, the edges and the last round


def test_several_ways_to_a_row_are_all_found(spark):
    from bandwright.plans import binds

    spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 6)], "i int, p int").createOrReplaceTempView("dag")
    sql = "SELECT i, LEVEL depth, CONNECT_BY_ROOT i top FROM dag {} CONNECT BY PRIOR i = p"
    assert sorted(map(tuple, binds.run(spark, sql.format("START WITH i = 1")).collect())) == [(1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 3, 1), (4, 3, 1), (5, 4, 1), (5, 4, 1)]
    assert sorted(map(tuple, binds.run(spark, sql.format("START WITH i IN (2, 4)")).collect())) == [(2, 1, 2), (4, 1, 4), (4, 1, 4), (4, 2, 2), (5, 2, 4), (5, 2, 4), (5, 3, 2)]


def test_loops_are_found(spark):
    from bandwright.operators.hierarchy import Loop
    from bandwright.plans import binds

    spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a int, b int").createOrReplaceTempView("graph")
    got = binds.run(spark, "SELECT a, b, CONNECT_BY_ISCYCLE c FROM graph START WITH a = 1 CONNECT BY NOCYCLE PRIOR b = a").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0), (2, 3, 0), (3, 1, 1), (3, 4, 0)]
    with pytest.raises(Loop):
        binds.run(spark, "SELECT a FROM graph START WITH a = 1 CONNECT BY PRIOR b = a").collect()


def test_rows_of_files(spark, tmp_path):
    from bandwright.plans.model import Item
    from bandwright.sources import files

    (tmp_path / "x.xml").write_text("<all><r><ID> 1 </ID><NAME>a</NAME><MORE>z</MORE></r><r><ID>two</ID></r></all>")
    (tmp_path / "x.csv").write_text("id|name\n1|a\n2|\n")
    d = Dataset("Q", "", items=(Item("id", "number", precision=9), Item("name")))
    upper = Dataset("Q", "", items=(Item("ID", "number", precision=9), Item("NAME")))
    assert [tuple(r) for r in files.read(spark, upper, str(tmp_path / "x.xml"), "xml", "r").collect()] == [(1, "a"), (None, None)]
    assert [tuple(r) for r in files.read(spark, d, str(tmp_path / "x.csv"), "text", separator="|").collect()] == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        files.read(spark, d, "x", "tape")


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    from bandwright.operators import burst

    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") < 900, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("k"), "id")
    got = {r.k: r for r in burst.write(df, str(tmp_path / "o"), "k", name=burst.file_name("f_<K>.txt", ["k", "id"]), rows_per_file=60).collect()}
    assert got["hot"].n_files > 3 and got["hot"].n_rows == 500 and got["hot"].file_name == "f_hot.txt"
    assert sum(r.n_rows for r in got.values()) == 950 and None not in got


def spans_and_points():
    """Points and intervals with NULLs, equal values, reversed and empty intervals; the pairs of them."""
    rng = random.Random(3)
    some = lambda: rng.choice([None, *range(12)] + [rng.uniform(-1, 13) for _ in range(8)])
    spans = [(k, None if (a := some()) is None else float(a), None if (b := some()) is None else float(b), rng.choice([None, k, 10**16])) for k in range(150)]
    points = [(k, None if (a := some()) is None else float(a), rng.choice([None, k, -(10**16)])) for k in range(200)]
    return spans, points


def held(spans, points, is_open):
    return [(s, p) for s in spans for p in points if p[1] is not None and (s[1] is None or s[1] <= p[1]) and (s[2] is None or (p[1] < s[2] if is_open else p[1] <= s[2])) and (None in s[1:3] or s[1] <= s[2])]


def added(values):
    known = [v for v in values if v is not None]
    return len(values), len(known), sum(known) if known else None


@pytest.mark.parametrize("is_open", [False, True])
def test_totals_of_intervals_are_those_of_the_pairs(spark, is_open):
    spans, points = spans_and_points()
    s = spark.createDataFrame(spans, "k int, low double, high double, w bigint")
    p = spark.createDataFrame(points, "pk int, at double, v bigint").repartition(5)
    got = {r.k: (r["_n"], r["_count0"], r["_sum0"]) for r in links.totals_of_intervals(s, p, "at", "low", "high", ["v"], is_open).collect()}
    pairs = held(spans, points, is_open)
    assert got == {k: added([y[2] for x, y in pairs if x[0] == k]) for k in {x[0] for x, _ in pairs}}


def test_the_interval_query_makes_no_pairs(spark, tmp_path):
    """A supplier without a balance holds nobody; the plan has no join of customers with suppliers."""
    customers = [(k, float(k % 7)) for k in range(50)] + [(99, None)]
    suppliers = [(1, 3.0), (2, None), (40, 5.0), (2000, -500.0), (40, 5.0)]
    for name, rows, schema in (("customer", customers, "c_custkey bigint, c_acctbal double"), ("supplier", suppliers, "s_suppkey bigint, s_acctbal double")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    done = catalog.queries()["j19_interval_join"](spark, str(tmp_path))
    want = {}
    for k, b in suppliers:
        for c, v in customers:
            if b is not None and v is not None and b - k <= v < b + 10:
                n, total = want.get(k, (0, 0))
                want[k] = (n + 1, total + c)
    assert {r.s_suppkey: (r.n, r.total) for r in done.collect()} == want
    assert "_plevel" not in done._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("is_open", [False, True])
def test_totals_at_points_are_those_of_the_pairs(spark, is_open):
    spans, points = spans_and_points()
    s = spark.createDataFrame([(*x[:3], None if x[3] is None else Decimal(x[3]) / 100) for x in spans], "k int, low double, high double, w decimal(20,2)").repartition(5)
    p = spark.createDataFrame(points, "pk int, at double, v bigint")
    done = links.totals_at_points(p, s, "at", "low", "high", ["w"], is_open)
    assert dict(done.dtypes)["_sum0"] == "decimal(30,2)"
    pairs = held(spans, points, is_open)
    assert {r["at"]: (r["_n"], r["_count0"], r["_sum0"]) for r in done.collect()} == {at: added([None if x[3] is None else Decimal(x[3]) / 100 for x, y in pairs if y == first]) for at in {y[1] for _, y in pairs} for first in [next(y for _, y in pairs if y[1] == at)]}


@pytest.mark.parametrize(("function", "is_paired"), [("sum", False), ("count", False), ("maximum", True)])
def test_an_interval_detail_is_added_up_without_pairs(spark, function, is_paired):
    spark.createDataFrame([(k, float(k % 5)) for k in range(20)] + [(20, None)], "id int, at double").createOrReplaceTempView("places")
    spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 2.0), (3, 3.0, 1.0), (None, 4.0, 9.0), (5, None, 9.0)], "v int, a double, b double").createOrReplaceTempView("bounds")
    report = ReportDef("R", datasets=(Dataset("P", "SELECT id, at FROM places"), Dataset("D", "SELECT v FROM bounds WHERE :at BETWEEN a AND b")), summaries=(Summary("CS", "v", function, "report"),), links=(Link("P", "D", (("AT", ""),)),))
    main = engine.run(report, spark).main
    values = {0.0: [1], 1.0: [1], 2.0: [1, 2], 3.0: [], 4.0: [None], None: []}
    make = {"sum": lambda v: sum(v) if v else None, "count": len, "maximum": lambda v: max(v, default=None)}[function]
    want = {k: (len(values[at]), make([x for x in values[at] if x is not None]) if values[at] else None) for k, at in [(k, float(k % 5)) for k in range(20)] + [(20, None)]}
    assert {r.id: (r.n_d, r.CS) for r in main.collect()} == want
    assert ("_plevel" in main._jdf.queryExecution().optimizedPlan().toString()) == is_paired
