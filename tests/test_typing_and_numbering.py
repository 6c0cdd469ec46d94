"""Numbering, the CSV dialect, typing without loss and type-driven sums."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlet.operators import charts as C
from martlet.operators import clean as CL
from martlet.operators import insights as I
from martlet.operators import limits as L
from martlet.operators import profile as PR
from martlet.operators import rollups as R
from martlet.operators import star as S
from martlet.plans.numbering import with_ordered_ids
from martlet.sources import files as SRC
from martlet.sources import sinks as SNK


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ordered_ids_cover_every_row_once(spark, coalesce, reuse):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.exchange.reuse")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (coalesce, reuse)):
            spark.conf.set(n, v)
        rows = spark.range(400_000).select(
            (F.hash("id") % 100_000).alias("key"), "id", F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"))
        out = with_ordered_ids(rows, [F.col("key")], "n")
        r = out.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("ids"), F.min("n").alias("lo"),
                    F.max("n").alias("hi"), F.count_distinct("id").alias("kept"),
                    F.count_if(F.col("payload") != F.concat(F.lit("payload "), F.col("id").cast("string"))).alias("torn")).first()
        assert tuple(r) == (400_000, 400_000, 1, 400_000, 400_000, 0)
        by_id = out.select("n", "key").orderBy("n").limit(50_000).collect()
        assert [x["key"] for x in by_id] == sorted(x["key"] for x in by_id)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


QUOTED = 'name,note\n"a","5"" pipe, long"\n"b","two\nlines"\nc,plain\n'


def test_quoted_fields_and_newlines(spark, tmp_path):
    (tmp_path / "q.csv").write_text(QUOTED)
    df, _, sep = SRC.read_delimited(spark, str(tmp_path / "q.csv"))
    assert sep == "," and sorted(map(tuple, df.collect())) == [("a", '5" pipe, long'), ("b", "two\nlines"), ("c", "plain")]


def test_rows_with_other_field_counts_are_counted(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3,4,5\n6\n7,8\n")
    path = str(tmp_path / "m.csv")
    df, _, _ = SRC.read_delimited(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 4
    assert SRC.malformed_rows(spark, path) == 2


def test_export_reads_back_equal(spark, tmp_path):
    rows = [("x", 'say "hi", now'), ("y", "a\nb"), ("z", "back\\slash"), ("w", ";,|")]
    SNK.export_csv(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "out"))
    df, _, _ = SRC.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, df.collect())) == sorted(rows)


def test_split_reader_types_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x,ok\n1,2.5,true\n2,3,false\n")
    df = SRC.read_split(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean"]


def test_integers_beyond_64_bits_stay_text(spark):
    big = "12345678901234567890123"
    df = CL.infer_column_types(spark.createDataFrame([(big, big, " 2021"), ("1", None, " 2022")], "a string, b string, y string"))
    assert [t for _, t in df.dtypes] == ["string", "string", "bigint"]
    assert {r["a"] for r in df.collect()} == {big, "1"} and [r["y"] for r in df.collect()] == [2021, 2022]


@pytest.mark.parametrize("text, want", [
    ("May 6 2024", dt.datetime(2024, 5, 6)), ("2024 05 06", dt.datetime(2024, 5, 6)), ("20240506", dt.datetime(2024, 5, 6)),
    ("06.05.2024", dt.datetime(2024, 6, 5)), ("5/6/2024 3:07 PM", dt.datetime(2024, 5, 6, 15, 7)),
    ("5/6/2024 12:00 AM", dt.datetime(2024, 5, 6)), ("May 2024", dt.datetime(2024, 5, 1)),
    ("2024/5/6 7:8", dt.datetime(2024, 5, 6, 7, 8)), ("2024-03-10 02:30:00", dt.datetime(2024, 3, 10, 2, 30)),
    ("2024-05-06T07:08:09", dt.datetime(2024, 5, 6, 7, 8, 9)), ("6-May-2024", dt.datetime(2024, 5, 6)),
    ("5/6/2024 25:00", None), ("5/6/2024 13:00 PM", None), ("13/13/2024", None), ("soon", None), ("", None)])
def test_dates_pass_no_time_zone(spark, text, want):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = spark.createDataFrame([(text,)], "t string").select(CL.parse_date(F.col("t")).alias("d")).first()["d"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want


def test_normalised_names_stay_unique(spark):
    assert CL.normalize_column_names(spark.createDataFrame([(1, 2)], ["A B", "a-b"])).columns == ["a_b", "a_b_2"]


def test_sums_follow_the_type(spark):
    small = spark.range(1000).select(F.lit("x").alias("d"), F.lit(0.004).alias("v"), F.lit(5e10).alias("w"), "id")
    assert R.top_n(small, "d", "v").first()["total_revenue"] == 4.0
    assert R.generic_rollup(small, "d", "w").first()["total"] == 5e13
    assert R.generic_rollup(small, "d", "id").schema["total"].dataType.simpleString() == "bigint"


def test_averages_skip_missing_values(spark):
    rows = [("a", 10.0), ("a", None), ("a", 20.0), ("b", 10.0), ("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "d string, v double")
    assert {r["d"]: (r["orders"], r["avg_value"]) for r in R.segment_breakdown(df, "d", "v").collect()} == {
        "a": (3, 15.0), "b": (3, 10.0)}
    orders = df.select(F.lit(1).alias("o_custkey"), F.when(~F.isnan("v"), F.col("v")).alias("o_totalprice"), "d").where("d = 'a'")
    customer = spark.createDataFrame([(1, "s")], "c_custkey int, c_mktsegment string")
    assert S.aov_by_segment(orders, customer).first()["avg_order_value"] == 15.0


def test_nan_counts_as_missing(spark):
    rows = [(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 9])] + [(9, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double").select("v", "k")
    found = I.detect_anomaly(df, "k").first()
    assert found["value"] == 9.0 and "`5` deviates" in found["message"]
    spread = R.distribution(df, "v").first()
    assert (spread["n"], spread["max_value"]) == (6, 9.0)


def test_messages_print_numbers_plainly(spark):
    one = spark.createDataFrame([(1.23456,)], "v double")
    assert "`1.23456`" in I.primary_signal(one).first()["message"]
    assert "`7`" in I.primary_signal(spark.createDataFrame([(7,)], "v int")).first()["message"]
    two = spark.createDataFrame([("a", 205.0), ("b", 1.0)], "k string, v double")
    assert "`205.0`" in I.primary_signal(two, "k").first()["message"]
    alone = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5, 900)], "v int")
    assert "`row 6`" in I.detect_anomaly(alone, "v").first()["message"]


def test_null_keys_refer_to_nothing(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, ref int")
    parent = spark.createDataFrame([(1,)], "pk int")
    assert [r["id"] for r in PR.check_foreign_key(child, "ref", parent, "pk").collect()] == [3]


def test_line_over_month_names_keeps_the_rows(spark):
    months = ["January", "February", "March"]
    df = spark.createDataFrame([(m, i) for i, m in enumerate(months)], "month_name string, revenue int")
    assert sorted(r["x"] for r in C.chart_points(df).collect()) == sorted(months)
    many = spark.range(60).select(F.concat(F.lit("week "), F.col("id").cast("string")).alias("month_name"), F.col("id").alias("v"))
    assert C.chart_points(many).count() == 60


def test_table_chart_gives_the_rows(spark):
    got = C.chart_points(spark.createDataFrame([("a", "b")], "x string, z string"))
    assert got.columns == ["chart_type", "x", "z"] and got.count() == 1


@pytest.mark.parametrize("n, over", [(5, True), (10, False), (3, True)])
def test_cap_runs_the_query_once(spark, n, over):
    got = L.capped(spark.range(10).orderBy(F.desc("id")), n).collect()
    assert len(got) == min(n, 10) and {r["overflow"] for r in got} == {over}
    assert {r["id"] for r in got} == set(range(10 - min(n, 10), 10))


@pytest.mark.parametrize("make", [lambda s: S.period_over_period(s, "p", "i", "v"), lambda s: I.moving_average(s, "p", "i", "v")])
def test_periods_need_one_scan_and_no_join(spark, tmp_path, make):
    spark.createDataFrame([("a", 1, 10.0), ("b", 2, 20.0), ("d", 4, 5.0)], "p string, i int, v double").write.parquet(str(tmp_path / "s"))
    out = make(spark.read.parquet(str(tmp_path / "s")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert [r["p"] for r in out.collect()] == ["a", "b", "d"]


def test_profile_reads_and_shuffles_once(spark):
    from paths import SF_SMALL
    from martlet.session import Warehouse
    df = PR.distinct_summary(Warehouse(spark, SF_SMALL).orders)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_columns_are_chosen_by_the_first_rule_met(spark):
    df = spark.createDataFrame([(1, 2.0, "n", "e", 3)], "order_id int, discount double, note string, region string, total int")
    assert PR.rollup_columns(df) == {"metric": "total", "date": None, "dimension": "region"}
    with pytest.raises(ValueError):
        PR.auto_rollup(df, "trend")


def test_compare_uses_two_dimensions(spark):
    rows = [("r%d" % (i % 2), "t%d" % (i % 3), float(i)) for i in range(60)]
    got = PR.auto_compare(spark.createDataFrame(rows, "region string, type string, revenue double")).collect()
    assert {r["dimension"] for r in got} == {"region", "type"} and sum(r["records"] for r in got) == 120
