import math

import numpy as np
import pytest

from conftest_paths import SF
from martlet.llm import vptree


def by_hand(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")


@pytest.mark.parametrize("shard_rows, block_rows", [(100_000, 100_000), (120, 2)])
def test_factor_one_is_exact(spark, rows, shard_rows, block_rows):
    some = [(r.vec_id, [float(x) for x in r.embedding]) for r in rows.collect()]
    asked = [x for x in some if x[0] % 100 == 0]
    got = found(vptree.nearest(rows, rows.where("vec_id % 100 = 0"), shard_rows=shard_rows, block_rows=block_rows))
    want = by_hand(some, asked)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (a, _), (b, _) in zip(got[q], want[q]))


def test_relaxed_factor_skips_work_and_keeps_recall():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.3, (400, 6)) for c in range(8)])
    ids = np.arange(len(points))
    tree = vptree.Tree(points, ids, leaf=32)
    asked = np.arange(0, len(points), 100)
    truth = []
    for q in asked:
        d = vptree.distances(points, points[[q]])[0]
        d[q] = np.inf
        truth.append(set(np.lexsort((ids, d))[:10]))
    exact = tree.search(points[asked], asked, 10, 1.0)
    assert [set(found) for _, found in exact] == truth
    relaxed = tree.search(points[asked], asked, 10, 0.7)
    assert sum(len(t & set(found)) for t, (_, found) in zip(truth, relaxed)) >= 0.9 * 10 * len(asked)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(vptree.nearest(df, df.where("vec_id % 100 = 0")))
    assert got == {0: [(0.0, 7), (0.0, 7), (1.0, 8), (math.sqrt(2), 100)],
                   100: [(math.sqrt(2), 0), (math.sqrt(2), 7), (math.sqrt(2), 7), (math.sqrt(5), 8)]}
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_a_repeated_query_loses_no_neighbour(spark):
    import duckdb
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [0.0, 1.0])] * 5 + [(200, [0.0, 2.0]), (200, [9.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", vptree.F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in vptree.nearest(df, df.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert [r[2] for r in got if r[0] == 100] == [1, 200, 2, 3, 4, 5, 6, 7, 8, 9]
    assert len([r for r in got if r[0] == 200]) == 20
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toArrow())
    want = con.execute(vptree.NEAREST_SQL).fetchall()
    assert [(q, k, v, pytest.approx(s)) for q, k, v, s in sorted(want)] == got


def test_many_equal_vectors():
    points = np.ones((1000, 3))
    d, ids = vptree.Tree(points, np.arange(1000)).search(points[:1], np.array([0]), 10, 1.0)[0]
    assert ids.tolist() == list(range(1, 11)) and not d.any()
