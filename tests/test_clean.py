"""Name cleaning, reading, coercion, roles and blueprint: the reference's
unit cases re-expressed on small Spark inputs."""

import os

import pytest

from martlet.operators import clean as CL
from martlet.operators import profile as PR
from martlet.operators import ingest as IG
from martlet.sources import files as SRC


@pytest.mark.parametrize("raw,expected", [
    ("First Name", "first_name"), ("2024_revenue", "col_2024_revenue"), ("select", "col_select"),
    ("", "column"), ("Unit$Price!", "unit_price"), ("Revenue (€)", "revenue"),
    ("  Total   Sales ", "total_sales"),
])
def test_snake_names(raw, expected):
    assert CL.snake_name(raw) == expected


@pytest.mark.parametrize("name,is_id", [
    ("customer_id", True), ("product_key", True), ("id", True), ("phone_number", True),
    ("postal_code", True), ("total_revenue", False), ("unit_price", False),
    ("rating", True), ("private", True), ("protein", True),  # unanchored third branch
])
def test_id_pattern(spark, name, is_id):
    df = spark.createDataFrame([(1,)], f"`{name}` int")
    prof = PR.classify_roles(PR.profile_columns(df)).first()
    assert (prof["role"] == "id") == is_id


def test_unique_names_advance_past_taken():
    assert CL.unique_names(["a", "a", "a"]) == ["a", "a_2", "a_3"]
    assert CL.unique_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert len(set(CL.unique_names(["a_2", "a", "a"]))) == 3


def test_sanitize_map(spark):
    df = spark.createDataFrame([(1, 2.0)], "`Order ID` int, `Unit Price` double")
    out, m = CL.sanitize_columns(df)
    assert out.columns == ["order_id", "unit_price"]
    assert m == {"Order ID": "order_id", "Unit Price": "unit_price"}


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Order ID` int, `Total Revenue ($)` int")
    assert CL.normalize_column_names(df).columns == ["order_id", "total_revenue_"]


def _write(tmp_path, name, data: bytes):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = _write(tmp_path, "d.csv", f"a{sep}b{sep}c\n1{sep}2{sep}3\n".encode())
    df, enc, found = SRC.read_delimited(spark, path)
    assert found == sep and df.columns == ["a", "b", "c"] and df.count() == 1


def test_latin1_and_bom(spark, tmp_path):
    p1 = _write(tmp_path, "l1.csv", "name,value\ncafé,1\n".encode("latin-1"))
    df, enc, _ = SRC.read_delimited(spark, p1)
    assert enc == "ISO-8859-1" and df.first()["name"] == "café"
    p2 = _write(tmp_path, "bom.csv", "﻿name,value\nx,1\n".encode("utf-8"))
    df2, enc2, _ = SRC.read_delimited(spark, p2)
    assert enc2 == "UTF-8" and df2.columns == ["name", "value"] and df2.count() == 1


def test_repeated_headers(spark, tmp_path):
    path = _write(tmp_path, "r.csv", b"value,value,value\n1,2,3\n")
    df, _, _ = SRC.read_delimited(spark, path)
    named, _ = CL.sanitize_columns(df)
    assert len(set(named.columns)) == 3


def test_empty_file_errors(spark, tmp_path):
    path = _write(tmp_path, "e.csv", b"\n")
    with pytest.raises(ValueError):
        SRC.read_delimited(spark, path)


def _roles(spark, rows, schema):
    raw = spark.createDataFrame(rows, schema)
    cleaned, _, _ = CL.clean_upload(raw)
    prof = PR.classify_roles(PR.profile_columns(cleaned)).collect()
    return {r["name"]: r["role"] for r in prof}, cleaned


def test_currency_is_measure(spark):
    roles, df = _roles(spark, [(f"n{i}", f"${10 + 10 * i}.00") for i in range(11)], "name string, price string")
    assert roles["price"] == "measure"
    assert sorted(r["price"] for r in df.collect())[0] == 10.0


def test_percent_is_measure(spark):
    roles, df = _roles(spark, [(f"n{i}", f"{5 + 5 * i} %") for i in range(11)], "name string, discount string")
    assert roles["discount"] == "measure"
    assert max(r["discount"] for r in df.collect()) == 55.0  # not divided by 100


def test_dates_are_dates(spark):
    roles, _ = _roles(spark, [(f"2024-01-{d:02d}", str(d)) for d in range(1, 12)], "order_date string, amount string")
    assert roles["order_date"] == "date"


def test_na_spellings(spark):
    roles, df = _roles(spark, [("a", "100"), ("b", "N/A"), ("c", "null")], "name string, value string")
    assert roles["value"] == "measure"
    assert sorted((r["value"] is None) for r in df.collect()) == [False, True, True]


def test_empty_column_dropped(spark):
    _, df = _roles(spark, [("a", None, "1"), ("b", None, "2")], "name string, empty string, score string")
    assert "empty" not in df.columns


def test_roles(spark):
    roles, _ = _roles(spark, [(str(i), str(i * 2)) for i in range(5)], "order_id string, total string")
    assert roles == {"order_id": "id", "total": "measure"}
    roles, _ = _roles(spark, [(f"p{i}", f"{i}.5") for i in range(11)], "product_name string, unit_price string")
    assert roles == {"product_name": "dimension", "unit_price": "measure"}
    roles, _ = _roles(spark, [(str(i), ["a", "b", "c"][i % 3], f"{i}.0") for i in range(15)],
                      "product_id string, category string, price string")
    assert roles == {"product_id": "id", "category": "dimension", "price": "measure"}


def test_free_text(spark):
    roles, _ = _roles(spark, [(str(i), f"long description number {i} of the product", "1.0") for i in range(200)],
                      "product_id string, description string, price string")
    assert roles["description"] == "text"


def test_booleans_are_measures(spark):
    raw = spark.createDataFrame([("True",), ("False",), ("True",)], "flag string")
    typed = CL.infer_column_types(raw)
    assert dict(typed.dtypes)["flag"] == "boolean"
    roles = {r["name"]: r["role"] for r in PR.classify_roles(PR.profile_columns(typed)).collect()}
    assert roles["flag"] == "measure"


def test_blueprint_names():
    bp = PR.blueprint_from_roles([("a", "dimension"), ("b", "measure")], "my_sales")
    assert bp.fact_table == "my_sales_fact" and bp.dim_tables == {"dim_a": "a"}
    bp2 = PR.blueprint_from_roles([("col", "dimension"), ("COL", "dimension"), ("value", "measure")], "x")
    assert len(bp2.dim_tables) == 2 and len(set(bp2.dim_tables)) == 2


def test_header_only_errors(spark, tmp_path):
    path = _write(tmp_path, "h.csv", b"name,value\n")
    df, _, _ = SRC.read_delimited(spark, path)
    with pytest.raises(ValueError):
        IG.build_star(df, "h", str(tmp_path / "out"))


def test_high_null_drop(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a int, b int")
    out = CL.drop_high_null_columns(df, 0.9)
    assert out.columns == ["a"]


def test_dimension_ids_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "seg string")
    rows = PR.extract_dimension(df, "seg").orderBy("id").collect()
    assert [(r["id"], r["seg"]) for r in rows] == [(1, "a"), (2, "b"), (3, "c")]


def test_build_star_writes_tables(spark, tmp_path):
    raw = spark.createDataFrame([(f"{i}", ["x", "y"][i % 2], f"${i}.00", "2024-01-0" + str(1 + i % 9))
                                 for i in range(30)] + [(None, None, None, None)],
                                "`Order ID` string, Region string, Amount string, `Order Date` string")
    res = IG.build_star(raw, "Sales Upload", str(tmp_path / "star"))
    assert res.blueprint.fact_table == "sales_upload_fact"
    assert res.blueprint.dim_tables == {"dim_region": "region"}
    assert res.report.rows_kept == 30 and res.report.rows_removed == 1


def test_profile_approx_matches_exact_on_small(spark):
    df = spark.createDataFrame([(i % 7, f"v{i % 5}", float(i) / 4) for i in range(100)] + [(None, None, None)],
                               "a int, b string, c double")
    exact = {r["name"]: r for r in PR.profile_columns(df).collect()}
    approx = {r["name"]: r for r in PR.profile_columns(df, approx=True).collect()}
    for n in ("a", "b", "c"):
        assert exact[n]["n_unique"] == approx[n]["n_unique"]
        assert exact[n]["null_pct"] == approx[n]["null_pct"]
    assert approx["a"]["sample_values"] == ["0", "1", "2"]
    assert approx["b"]["sample_values"] == ["v0", "v1", "v2"]


def test_dimension_values_match_single_column(spark):
    rows = [(["b", "a", "c"][i % 3], [None, "x", "y", "x"][i % 4], ["p", "q"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "s1 string, s2 string, `s 3` string")
    cols = ["s1", "s2", "s 3"]
    vals = PR.dimension_values(df, cols)
    assert vals is not None
    for c in cols:
        got = [tuple(r) for r in PR.dimension_table(vals, cols, c).orderBy("id").collect()]
        want = list(enumerate(sorted({r[cols.index(c)] for r in rows} - {None}), start=1))
        assert got == want
        # the distributed numbering (bound exceeded) gives the same ids
        wide = [tuple(r) for r in PR.extract_dimension(df, c, max_values=1).orderBy("id").collect()]
        assert wide == want


def test_dimension_values_bound_falls_back(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(12)], "c string")
    assert PR.dimension_values(df, ["c"], max_values=10) is None
    assert PR.dimension_values(df, ["c"], max_values=12) is not None


def test_build_star_dimension_content(spark, tmp_path):
    raw = spark.createDataFrame([(f"{i}", ["west", "east", "north"][i % 3], ["a", "b"][i % 2], f"{i}.5")
                                 for i in range(60)] + [("0", "west", "a", "0.5")],
                                "id string, Region string, Tier string, Amount string")
    res = IG.build_star(raw, "s", str(tmp_path / "star"))
    assert res.blueprint.dim_tables == {"dim_region": "region", "dim_tier": "tier"}
    assert res.report.rows_read == 61 and res.report.rows_kept == 60
    reg = [tuple(r) for r in spark.read.parquet(res.tables["dim_region"]).orderBy("id").collect()]
    assert reg == [(1, "east"), (2, "north"), (3, "west")]
    tier = [tuple(r) for r in spark.read.parquet(res.tables["dim_tier"]).orderBy("id").collect()]
    assert tier == [(1, "a"), (2, "b")]


def test_warehouse_profile_counts_long_text_exactly(spark):
    long_a = "a" * 40
    texts = [long_a, long_a, "b" * 33, "short", None, "c" * 32, "c" * 32 + "x", "ü" * 20]
    df = spark.createDataFrame([(t, [1.0, float(i % 3)]) for i, t in enumerate(texts)],
                               "t string, v array<double>")
    got = {r["column_name"]: r for r in PR.warehouse_profile({"x": df}).collect()}
    assert got["t"]["n_unique"] == 6 and got["t"]["null_count"] == 1
    assert got["v"]["n_unique"] == 3 and got["v"]["rows"] == 8
    assert not got["t"]["is_key_candidate"]


def test_roles_by_sketch_equal_roles_by_profile(spark):
    df = spark.range(400).selectExpr(
        "id", "id % 50 AS few", "concat('v', id % 50) AS fifty", "concat('v', id % 51) AS more", "concat('x', id) AS order_ref",
        "date_add(DATE '2024-01-01', CAST(id AS INT)) AS day", "id % 2 = 0 AS flag", "CAST(NULL AS STRING) AS nothing")
    want = PR.classify_roles(PR.profile_columns(df)).select("position", "name", "role").collect()
    assert sorted(PR.column_roles(df).collect()) == sorted(want)
    plan = PR.column_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_build_star_leaves_no_intermediate_tables(spark, tmp_path):
    from martlet.session import _own_folder, scratch_path, scratch_run
    own = _own_folder(spark).removeprefix("file:")
    listed = lambda: set(os.listdir(own)) if os.path.isdir(own) else set()
    before = listed()
    df = spark.createDataFrame([(str(i), f"v{i % 3}", "long text " * 90 + str(i)) for i in range(60)] * 2, "id string, kind string, note string")
    star = IG.build_star(df, "kept", str(tmp_path / "star"))
    assert listed() == before and spark.read.parquet(star.tables["kept_fact"]).count() == 60
    with scratch_run(spark) as folder:
        spark.range(3).write.parquet(scratch_path(spark, "x"))
        assert os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
