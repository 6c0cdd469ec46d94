"""Plan shape checks: pushdown, pruning, partial aggregation, broadcast of
bounded dimensions, no Python evaluation in any registered query."""

import pytest

from paths import SF_SMALL
from martlet.suite import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushdown_and_pruning(spark):
    p = plan(QUERIES["src_parquet_scan"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def test_partial_aggregation_before_join(spark):
    p = plan(QUERIES["q_return_rate_by_region"](spark, SF_SMALL))
    assert "partial_count" in p or "partial_sum" in p
    assert "BroadcastHashJoin" in p


def test_top_k_is_take_ordered(spark):
    p = plan(QUERIES["q_top_customers"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_profile_uses_partial_top_k(spark):
    from martlet.operators import profile as PR
    from martlet.session import Warehouse
    p = plan(PR.distinct_summary(Warehouse(spark, SF_SMALL).orders))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_udf(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL))
    assert not any(x in p for x in ("EvalPython", "InPandas", "InArrow", "MapPartitions"))


def test_broadcast_only_within_row_and_byte_bounds(spark):
    from martlet.plans.joins import broadcast_if_bounded, fits_broadcast
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS pad")
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=99)
    assert not fits_broadcast(df, max_bytes=5_000)
    src = spark.range(100)
    assert broadcast_if_bounded(src, max_bytes=10) is src
    hinted = broadcast_if_bounded(src)
    assert hinted is not src and "broadcast" in hinted._jdf.queryExecution().analyzed().toString()


def test_dimensions_share_one_scan(spark):
    from martlet.operators import profile as PR
    from martlet.session import Warehouse
    o = Warehouse(spark, SF_SMALL).orders
    vals = PR.dimension_values(o, ["o_orderstatus", "o_orderpriority"])
    sets = o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").count()
    q = plan(sets)
    assert q.count("FileScan parquet") == 1 and "Expand" in q and "partial_count" in q
    assert vals is not None and vals.count() == 3 + 5


def test_scale_conf_sizes_partitions():
    from martlet.session import scale_conf
    small = scale_conf(37 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    big = scale_conf(100 << 40, 8000)
    parts = int(big["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and (100 << 40) / parts <= 256 << 20
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
