import pytest
from pyspark.sql import functions as F

from bandwright.operators import breaks, burst, drill, links, matrix, present
from bandwright.plans.model import Formula, Param, ReportDef


@pytest.fixture(scope="module")
def detail(spark):
    return spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, "c", 4.0), (None, "d", 5.0)], "k int, v string, n double")


def test_lookup_first_and_none(spark, detail):
    master = spark.createDataFrame([(1,), (3,), (None,)], "id int")
    got = {r.id: r.x for r in links.lookup(master, detail, [("id", "k")], {"x": "v"}, ["v"]).collect()}
    assert got == {1: "a", 3: None, None: None}


def test_lookup_list_is_in_order(spark, detail):
    master = spark.createDataFrame([(1,), (3,)], "k int")
    got = {r.k: r.all for r in links.lookup_list(master, detail, [("k", "k")], "v", "all", ["v"], ",").collect()}
    assert got == {1: "a,b", 3: None}


def test_first_fetch_takes_the_largest_of_ties(spark):
    master = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(1, 5, "x"), (1, 5, "z"), (1, None, "zz"), (1, 4, "zzz")], "k int, o int, v string")
    got = links.first_fetch(master, child, [("id", "k")], "v", "x", [F.col("o").desc_nulls_last()]).first()
    assert got.x == "z"


def test_infer_pairs():
    class M:
        columns = ["Cust_Id", "Name"]

    assert links.infer_pairs(M, ["CUST_ID", "P_X"]) == [("Cust_Id", "Cust_Id")]
    assert links.infer_pairs(M, ["CUST_ID"], [("NAME", "c_name")]) == [("Name", "c_name")]


def test_levels_and_labels(spark, detail):
    got = breaks.labelled(breaks.levels(detail, ["k"], [F.sum("n").alias("t")]), ["k"], "All")
    assert {(r.row_label, r.t, r.row_type) for r in got.collect()} == {("1", 5.0, "group"), ("2", 4.0, "group"), ("", 5.0, "group"), ("All", 14.0, "grand total")}


def test_summary_of_missing_column(detail):
    with pytest.raises(breaks.UnboundSummary):
        breaks.summary(detail, "sum", "nope", [], "x")
    with pytest.raises(ValueError):
        breaks.aggregate("first", F.col("v"))


def test_matrix_margins(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r string, c string, v int")
    got = {(r.r, r.is_total): (r.x, r.y, r.row_total) for r in matrix.matrix(df, ["r"], "c", ["x", "y"], "v", margins=True).collect()}
    assert got == {("a", False): (1, 2, 3), ("b", False): (3, None, 3), (None, True): (4, 2, 6)}
    assert matrix.chart(df, "nope", "v") is None


def test_numbering_is_total_and_ordered(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(1000).repartition(7).withColumn("x", F.col("id") % 10).withColumn("pad", F.lit("p"))
    got = present.numbered(df, [F.col("x"), F.col("id").desc()]).orderBy("row_no").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.row_no for r in got] == list(range(1, 1001))
    assert [(r.x, -r.id) for r in got] == sorted((i % 10, -i) for i in range(1000))


@pytest.mark.parametrize(("label", "n"), [("n > '3'", 2), ("v = 'a' OR (n BETWEEN 4 AND 5)", 3), ("k IS NULL", 1), ("NOT v LIKE 'a%' AND n < 4", 1), ("k > 100", 0)])
def test_condition_labels(detail, label, n):
    assert detail.where(present.condition(label)).count() == n


@pytest.mark.parametrize("label", ["n >", "(n > 1", "n > 1 n", "> 3", "n ? 1"])
def test_bad_labels(label):
    with pytest.raises(present.BadCondition):
        present.condition(label)


def test_first_style_wins(detail):
    rules = [("n >= 4", {"c": "red"}), ("n >= 3", {"c": "blue"})]
    got = {r.v: (r.s or {}).get("c") for r in detail.select("v", present.styled(rules).alias("s")).collect()}
    assert got == {"a": "blue", "b": None, "c": "red", "d": "red"}


def test_burst(spark):
    report = ReportDef("r", (Param("P_AS_PATH"),), formulas=(Formula("CF", ":P_AS_PATH"),))
    assert burst.is_burst(report) and burst.is_drill_through(report, ["P_AS_PATH"])
    assert burst.burst_key(["CF_X", "REGION_NAME", "CUST_ID"]) == "CUST_ID"
    assert burst.burst_key(["REGION_NAME", "X"], "'a'||:X") == "X"
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    people = spark.createDataFrame([(1, "a@x.example"), (2, None)], "p int, mail string")
    assert {r.k: r.can_send for r in burst.recipients(rows, people, "k", "p", "mail").collect()} == {1: True, 2: False}


def test_pending_gives_up_after_three_tries(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    history = spark.createDataFrame([(1, True), (2, False), (2, False), (2, False), (3, False)], "k int, delivered boolean")
    assert [r.k for r in burst.pending(keys, history, "k").collect()] == [3]


def test_burst_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    burst.write(df, str(tmp_path / "out"), "k")
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 1").count() == 2


def test_drill(spark, detail):
    assert drill.filtered(detail, {"P_K": 1, "P_OTHER": 3, "P_V": None}).count() == 2
    row = detail.select(drill.link("R", {"P_K": "k"}).alias("l")).where("l.params['P_K'] = '2'").first()
    assert row.l.report == "R"


def test_resend_stream(spark, tmp_path):
    from bandwright.streaming.resend import deliver

    sent = []

    def send(keys):
        sent.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("delivered", F.lit(True))

    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    for part in ([(1,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(part, "k int").write.mode("append").parquet(source)
        deliver(spark.readStream.schema("k int").parquet(source), "k", history, str(tmp_path / "check"), send).awaitTermination()
    assert sent == [[1, 2], [3]]
