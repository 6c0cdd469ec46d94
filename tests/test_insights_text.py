"""Insights, charts, SQL audit, routing, reply parsing and scoring on the
reference's unit fixtures."""

import pytest
from pyspark.sql import functions as F

from martlet.operators import charts as C
from martlet.operators import insights as I
from martlet.operators import textjobs as TX


def test_anomaly_reported(spark):
    df = spark.createDataFrame([("North", 100), ("South", 110), ("East", 98), ("West", 102), ("Coastal", 500)],
                               "region_name string, return_amount int")
    out = I.detect_anomaly(df, order_col="region_name").collect()
    assert len(out) == 1 and out[0]["label"] == "Coastal"
    assert abs(out[0]["z_score"] - 2.0) < 0.01


def test_anomaly_needs_five_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 100)], "k string, v int")
    assert I.detect_anomaly(df, order_col="k").count() == 0


def test_trend_and_primary(spark):
    df = spark.createDataFrame([("2024-01", 100.0), ("2024-02", 120.0), ("2024-03", 150.0)],
                               "month string, revenue double")
    t = I.detect_trend(df).first()
    assert t["direction"] == "upward" and abs(t["delta_pct"] - 50.0) < 1e-9
    p = I.primary_signal(df, "month").first()
    assert p["label"] == "2024-03" and p["value"] == 150.0


def test_insights_empty(spark):
    df = spark.createDataFrame([], "month string, revenue double")
    rows = I.insights(df, "trend", "month").collect()
    assert [r["kind"] for r in rows] == ["empty"]


def test_chart_month_is_line(spark):
    df = spark.createDataFrame([("Jan", 1), ("Feb", 2), ("Mar", 3)], "month_name string, revenue int")
    spec = C.infer_chart(df)
    assert spec.chart_type == "line" and spec.y_field == "revenue"


def test_chart_category_is_bar(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "category string, revenue int")
    spec = C.infer_chart(df)
    assert spec.chart_type == "bar" and spec.x_field == "category"


def test_line_collapse_to_months(spark):
    df = spark.range(60).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,id)").alias("d"),
                                F.lit(1.0).alias("v"))
    pts = C.line_points(df, "d", "v").collect()
    assert [(r["x"], r["y"]) for r in pts] == [("2024-01", 31.0), ("2024-02", 29.0)]


def test_sql_audit(spark):
    df = spark.createDataFrame([(1, "SELECT category, SUM(net_amount) FROM fact_orders GROUP BY category"),
                                (2, "DELETE FROM fact_orders"), (3, "   "),
                                (4, "SELECT * FROM t;"), (5, "select updated_at from x")], "id int, sql string")
    r = {x["id"]: x for x in TX.audit_sql(df, "sql").collect()}
    assert r[1]["is_valid"] and r[1]["errors"] == []
    assert not r[2]["is_valid"] and any("delete" in e for e in r[2]["errors"])
    assert r[3]["errors"] == [TX.MSG_EMPTY]
    assert r[4]["is_valid"] and r[4]["warnings"] == [TX.MSG_STAR]
    assert r[5]["is_valid"]  # updated_at is not the keyword update


def test_routes(spark):
    df = spark.createDataFrame([("Show the top 10 products by revenue.",), ("Show the monthly sales trend.",)], "q string")
    r = df.select(TX.route_template("q").alias("t")).withColumn("c", TX.route_chart(F.col("t"))).collect()
    assert [(x["t"], x["c"]) for x in r] == [("top_products", "bar"), ("trend", "line")]


def test_intent_quirks(spark):
    df = spark.createDataFrame([("why did sales drop",), ("quarter results",), ("compare a vs b",), ("hello",)], "q string")
    assert [r[0] for r in df.select(TX.classify_intent("q")).collect()] == \
        ["anomaly", "trend", "comparison", "summary"]


def test_payload_paths(spark):
    df = spark.createDataFrame([(1, '```json\n{"sql": "SELECT 1", "chart_hint": "bar"}\n```'),
                                (2, 'text {"sql": "SELECT 2"} more'),
                                (3, '{"sql": "SELECT a,\\n b FROM t", "x": "cut'),
                                (4, "nothing here")], "id int, reply string")
    r = {x["id"]: x for x in TX.extract_payload(df, "reply").collect()}
    assert (r[1]["method"], r[1]["sql"], r[1]["chart_hint"]) == ("json", "SELECT 1", "bar")
    assert (r[2]["method"], r[2]["sql"]) == ("block", "SELECT 2")
    assert (r[3]["method"], r[3]["sql"]) == ("sql_field", "SELECT a,\n b FROM t")
    assert r[4]["method"] == "error"


def test_exact_match(spark):
    gold = spark.createDataFrame([(1, "SELECT a FROM t"), (2, "SELECT b FROM t")], "k int, sql string")
    same = spark.createDataFrame([(1, "select  a from T"), (2, "SELECT b FROM t")], "k int, sql string")
    diff = spark.createDataFrame([(1, "SELECT b FROM t"), (2, "SELECT a FROM t")], "k int, sql string")
    empty = spark.createDataFrame([], "k int, sql string")
    assert TX.exact_match(same, gold, "k", "sql").first()["score"] == 1.0
    assert TX.exact_match(diff, gold, "k", "sql").first()["score"] == 0.0
    assert TX.exact_match(same, empty, "k", "sql").first()["score"] == 0.0


def test_slug(spark):
    df = spark.createDataFrame([(1, "  Top Products: 2024! "), (2, "!!!"), (3, "x" * 80)], "id int, t string")
    r = {x["id"]: x["slug"] for x in TX.slug_keys(df, "t", "id").collect()}
    assert r == {1: "top_products_2024", 2: "analysis", 3: "x" * 50}


def test_primary_ignores_null_metric(spark):
    df = spark.createDataFrame([("a", None), ("b", 5.0), ("c", 3.0)], "k string, v double")
    assert I.primary_signal(df, "k").first()["label"] == "b"


@pytest.mark.parametrize("case", ["spread", "hot", "tiny", "two", "fallback"])
def test_exact_quantiles_match_numpy(spark, case, monkeypatch):
    import numpy as np
    from martlet.operators import rollups as R
    rng = np.random.default_rng(7)
    if case == "hot":
        vals = np.concatenate([np.full(3000, 42.0), rng.integers(0, 500, 6000).astype(float)])
    elif case == "tiny":
        vals = np.array([5.0])
    elif case == "two":
        vals = np.array([1.0, 9.0])
    else:
        vals = rng.normal(100, 30, 20000).round(2)
    if case == "fallback":
        monkeypatch.setattr(R, "QUANTILE_BRACKET", 0.0)
        monkeypatch.setattr(R, "QUANTILE_SKETCH_ACCURACY", 10)
    full_sorts = []
    real = R._ranked_values
    monkeypatch.setattr(R, "_ranked_values", lambda *a: full_sorts.append(1) or real(*a))
    df = spark.createDataFrame([(float(x),) for x in vals] + [(None,)], "m double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = R.exact_quantiles(df, "m", probs)
    want = np.quantile(vals, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    if case in ("spread", "hot", "fallback"):  # tiny inputs may take either exact path
        assert bool(full_sorts) == (case == "fallback")


def test_result_match_counts_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "w")], "kk int, vv string")
    r = TX.result_match(a, b).first()
    assert (r["rows_a"], r["rows_b"]) == (5, 4)
    assert r["only_in_a"] == a.exceptAll(b.toDF("k", "v")).count() == 3
    assert r["only_in_b"] == b.toDF("k", "v").exceptAll(a).count() == 2
    assert r["same"] is False
    same = TX.result_match(a, a.orderBy("k")).first()
    assert same["same"] is True and same["only_in_a"] == 0
    empty = TX.result_match(a.limit(0), b.limit(0)).first()
    assert (empty["rows_a"], empty["only_in_b"], empty["same"]) == (0, 0, True)


def test_unsafe_keywords_one_pass_equals_word_regex(spark):
    from martlet.functions import fixed
    from martlet.operators.textjobs import _WORD_EDGE_L, _WORD_EDGE_R
    texts = ["drop delete", "insert;update", "update", "x merge", "alter\ttable", "dropdown update_x",
             "über drop", "dropé", "select 1", "", "grant,truncate,create", "creates 2drop drop2 _drop",
             "DELETE from t", "a-merge-b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sql_id int, sql string")
    got = {r["sql_id"]: sorted(e for e in r["errors"] if "keyword" in e) for r in TX.audit_sql(df, "sql").collect()}
    low = F.lower(F.col("sql"))
    want_df = df.select("sql_id", *[low.rlike(_WORD_EDGE_L + k + _WORD_EDGE_R).alias(k) for k in fixed.UNSAFE_KEYWORDS])
    for r in want_df.collect():
        want = sorted(f"Unsafe SQL keyword detected: {k}." for k in fixed.UNSAFE_KEYWORDS if r[k])
        assert got[r["sql_id"]] == want, texts[r["sql_id"]]
    assert len(got[0]) == 2 and len(got[1]) == 2


def test_rank_tables_keyword_order_then_catalogue(spark):
    df = spark.createDataFrame([(1, "Show Revenue by region"), (2, "nothing here"), (3, "monthly returns")],
                               "qid int, question string")
    got = {}
    for r in TX.rank_tables(df, "question", "qid").orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["table_name"])
    assert got[1][:5] == ["fact_orders", "fact_order_items", "dim_date", "dim_region", "fact_returns"]
    assert got[2] == TX.WAREHOUSE_TABLE_ORDER
    assert got[3][:5] == ["fact_returns", "fact_order_items", "fact_orders", "dim_region", "dim_date"]
    assert all(sorted(v) == sorted(TX.WAREHOUSE_TABLE_ORDER) for v in got.values())


def test_warnings_json_text_like_json_dumps(spark):
    import json
    from martlet.sources.sinks import json_list_text
    rows = [(["a", "b"],), ([],), (['q"x', "back\\slash", "tab\there", "n\nl", "sl/ash"],), (["one"],)]
    df = spark.createDataFrame(rows, "w array<string>")
    got = [r["j"] for r in df.select(json_list_text(F.col("w")).alias("j")).collect()]
    assert got == [json.dumps(w) for (w,) in rows]


def test_kmeans_recovers_blobs_and_is_a_fixed_point(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    centers = [(0, 0, 0), (50, 50, 0), (0, 50, 50), (50, 0, 50)]
    rows = [(i * 4 + b, *(np.array(c) + rng.normal(0, 1, 3)).tolist())
            for i in range(30) for b, c in enumerate(centers)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    out = I.cluster_entities(df, "id", ["a", "b", "c"], k=4).toPandas()
    out["blob"] = out["id"] % 4
    assert out.groupby("blob")["cluster"].nunique().eq(1).all() and out["cluster"].nunique() == 4
    x = out[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    means = np.stack([z[out["cluster"] == k].mean(0) for k in range(4)])
    nearest = ((z[:, None, :] - means[None, :, :]) ** 2).sum(-1).argmin(1)
    assert (nearest == out["cluster"].to_numpy()).all()


def test_cluster_customers_query_is_a_kmeans_fixed_point(spark):
    """Brute-force check of the registered k-means query (no SQL oracle):
    every customer with orders appears once and sits in the cluster whose
    standardised mean is nearest."""
    import duckdb
    import numpy as np
    from paths import SF_SMALL
    from martlet.suite import QUERIES
    out = QUERIES["cluster_customers"](spark, SF_SMALL).toPandas()
    want = duckdb.connect().execute(
        f"SELECT count(DISTINCT o_custkey) FROM read_parquet('{SF_SMALL}/orders.parquet') o "
        f"JOIN read_parquet('{SF_SMALL}/customer.parquet') c ON o.o_custkey = c.c_custkey").fetchone()[0]
    assert len(out) == out["c_custkey"].nunique() == want
    x = out[["total_spend", "orders", "c_acctbal"]].to_numpy(dtype=float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    ks = sorted(out["cluster"].unique())
    means = np.stack([z[out["cluster"] == k].mean(0) for k in ks])
    nearest = np.array(ks)[((z[:, None, :] - means[None, :, :]) ** 2).sum(-1).argmin(1)]
    assert len(ks) == 4 and (nearest == out["cluster"].to_numpy()).all()


def test_kmeans_goes_on_until_it_converges(spark):
    """Many clusters on an even line take more than 100 iterations."""
    import numpy as np
    import pytest
    df = spark.range(20000, numPartitions=1).selectExpr("id", "double(id) AS a")
    with pytest.raises(RuntimeError, match="did not converge in 100"):
        I.cluster_entities(df, "id", ["a"], k=60, max_iter=100)
    out = I.cluster_entities(df, "id", ["a"], k=60).toPandas()
    assert len(out) == out["id"].nunique() == 20000 and out["cluster"].nunique() == 60
    x = out["a"].to_numpy()
    z = (x - x.mean()) / x.std(ddof=1)
    c = out["cluster"].to_numpy()
    far = np.abs(z[:, None] - np.array([z[c == j].mean() for j in range(60)])[None, :])
    # the last step moved no center by more than 1e-4
    assert (far[np.arange(len(c)), c] <= far.min(1) + 3e-4).all()


def test_kmeans_without_a_bound_refuses_what_cannot_converge(spark):
    import pytest
    rows = [(i, float(i % 7), float(i)) for i in range(50)]
    for odd in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="NaN"):
            I.cluster_entities(spark.createDataFrame(rows + [(50, odd, 1.0)], "id int, a double, b double"), "id", ["a", "b"])
    same = spark.createDataFrame([(i, 2.0) for i in range(50)], "id int, a double")
    assert I.cluster_entities(same, "id", ["a"]).count() == 50


def test_exact_quantiles_sort_only_a_small_subset(spark, monkeypatch):
    import numpy as np
    from martlet.operators import rollups as R
    sorted_rows = []
    real = R.with_ordered_ids
    monkeypatch.setattr(R, "with_ordered_ids", lambda df, *a, **k: sorted_rows.append(df.count()) or real(df, *a, **k))
    vals = np.random.default_rng(11).normal(0, 1, 20000)
    df = spark.createDataFrame([(float(x),) for x in vals], "m double")
    got = R.exact_quantiles(df, "m", [0.25, 0.5, 0.75])
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]), rtol=0, atol=1e-12)
    assert len(sorted_rows) == 1 and sorted_rows[0] < 0.05 * len(vals)
