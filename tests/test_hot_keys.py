"""Joins and copies under hot keys; groups' quartiles; idempotent appends."""

import math
import random

import pytest
from pyspark.sql import functions as F

from martlet.operators import clean as CL
from martlet.operators import rollups as R
from martlet.operators import textjobs as TX
from martlet.plans import hot_keys as H
from martlet.plans.joins import fits_broadcast, size_probe
from martlet.sources import sinks as SNK
from paths import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=60_000):
    """A third of the rows have one key, a tenth have another, some have none."""
    return spark.range(n, numPartitions=8).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN 8 WHEN id % 101 = 2 THEN NULL ELSE pmod(hash(id), 5000) END AS k")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_join_equals_a_join(spark, how):
    large = skewed(spark)
    other = spark.range(4000).selectExpr("id AS key", "id * 2 AS twice").unionByName(spark.range(7, 9).selectExpr("id AS key", "-1L AS twice"))
    got = H.hot_join(large, other, "k", "key", how, max_rows=10, max_bytes=1 << 20)
    want = large.join(other, F.col("k") == F.col("key"), how)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert "Union" in plan(got) or "Union" in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_partition_of_the_rest_is_much_larger_than_the_others(spark):
    large = skewed(spark)
    hot = H.hot_values(large, "k", partitions=32)
    assert set(hot) >= {7, 8}
    rest = large.where(~F.col("k").isin(hot)).repartition(32, "k")
    sizes = sorted(r["n"] for r in rest.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    whole = large.repartition(32, "k").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r["n"] for r in whole) > 3 * sizes[len(sizes) // 2]


def test_even_keys_and_small_sides_take_the_plain_join(spark):
    even = spark.range(10_000).selectExpr("id", "id % 5000 AS k")
    assert H.hot_values(even, "k", partitions=8) == [] and H.hot_values(even.limit(0), "k") == []
    small = spark.range(10).selectExpr("id AS key")
    assert "BroadcastHashJoin" in plan(H.hot_join(even, small, "k", "key"))


def test_size_probe_moves_no_rows(spark):
    from martlet.session import Warehouse
    p = plan(size_probe(Warehouse(spark, SF_SMALL).lineitem))
    assert "partial_count" in p and "Limit" not in p
    assert fits_broadcast(Warehouse(spark, SF_SMALL).nation) and not fits_broadcast(Warehouse(spark, SF_SMALL).lineitem, max_bytes=64)


def test_quartiles_by_group_are_exact(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", f"g{rng.randrange(20)}", None]), rng.choice([rng.gauss(0, 1), 5.0, None, float("nan")]))
            for _ in range(20_000)] + [("alone", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for k, bracket in ((R.KLL_K, R.KLL_BRACKET), (8, 0.0001)):  # the second: sketches too poor for their brackets
        monkeypatch.setattr(R, "KLL_K", k)
        monkeypatch.setattr(R, "KLL_BRACKET", bracket)
        got = {r["g"]: r for r in R.distribution_by(df, ["g"], "x").collect()}
        assert set(got) == {g for g, _ in rows}
        for g, r in got.items():
            own = sorted(x for h, x in rows if h == g and x is not None and not math.isnan(x))
            assert r["n"] == len(own)
            for p, name in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")):
                at = (len(own) - 1) * p
                want = None if not own else own[math.floor(at)] + (at - math.floor(at)) * (own[math.ceil(at)] - own[math.floor(at)])
                assert r[name] == (None if want is None else pytest.approx(want, abs=2e-6))
    monkeypatch.undo()
    about = {r["g"]: r for r in R.distribution_by(df, ["g"], "x", exact=False).collect()}
    assert about["alone"]["median"] == 3.0 and about["none"]["median"] is None


def test_wide_duplicates(spark):
    rows = [("text " * 300, 1, None), ("text " * 300, 1, None), ("text " * 300, None, 1), ("other", 1, None)] * 5
    df = spark.createDataFrame(rows, "t string, a int, b int").repartition(4)
    assert sorted(CL.drop_exact_duplicates(df).collect(), key=str) == sorted(df.dropDuplicates().collect(), key=str)
    assert CL.drop_exact_duplicates(df.limit(0)).count() == 0
    once = spark.range(50).selectExpr("id", "repeat('x', 2000) AS t")
    assert CL.drop_exact_duplicates(once).count() == 50
    assert "LeftAnti" in plan(CL.drop_exact_duplicates(once, wide=True))


def test_result_fingerprints(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, "1", 2.5)], "i int, s string, d double")
    assert TX.same_rows(a, a.orderBy("s").toDF("p", "q", "r")) and TX.result_match(a, a).first()["same"]
    for other in ([(1, "x", None), (None, "1", 2.5), (None, "1", 2.5)], [(1, "x", None), (1, "x", None)],
                  [(1, "x", None), (1, None, None), (None, "1", 2.5)], []):
        b = spark.createDataFrame(other, a.schema)
        assert not TX.same_rows(a, b)
        r = TX.result_match(a, b).first()
        assert not r["same"] and r["rows_b"] == len(other) and r["only_in_a"] == a.exceptAll(b).count()
    swapped = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    assert not TX.same_rows(swapped, spark.createDataFrame([(1, None), (None, 2)], "a int, b int"))


def test_appends_land_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "n int")
    for batch, values in (("a", (1, 2)), ("b", (3,)), ("a", (1, 2)), ("b", (3, 4))):
        SNK.append_batch(rows(*values), path, batch)
    assert sorted(r["n"] for r in SNK.read_batches(spark, path).collect()) == [1, 2, 3, 4]
    more = spark.createDataFrame([(9, "a"), (5, "c"), (6, "c")], "n int, batch string")
    for _ in range(2):
        SNK.append_new_batches(more, path, "batch")
    assert sorted(r["n"] for r in SNK.read_batches(spark, path).collect()) == [1, 2, 3, 4, 5, 6]
    SNK.append_new_batches(more, str(tmp_path / "fresh"), "batch")
    assert SNK.read_batches(spark, str(tmp_path / "fresh")).count() == 3


def test_replace_keeps_the_old_rows_until_the_new_are_there(spark, tmp_path):
    path = str(tmp_path / "t")
    SNK.replace_table(spark.range(5), path)
    SNK.replace_table(spark.read.parquet(path).selectExpr("id + 1 AS id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception):
        SNK.replace_table(spark.range(5).selectExpr("raise_error('no') AS id"), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []
