"""Nearest neighbours by vantage-point trees, one per shard.

The vectors are dealt to shards by a hash of their id. In each shard a tree is
built: a node takes a vantage point, the others are cut at their median
distance to it, and each half keeps its least and greatest distance. All
queries of a block go through a tree together: each first sees the leaf it
falls into, which gives it a k-th best distance (tau), then the whole tree,
skipping halves whose distances lie more than ``factor * tau`` away from the
query's. The triangle inequality allows that for factor one: the search is
exact then. A smaller factor skips more and finds less.

Queries are replicated to the shards in blocks; each (shard, block) cell
returns the best k of its shard per query, and the k best of all shards are
taken per query.

Scale: cells hold at most about ``SHARD_ROWS`` vectors and ``BLOCK_ROWS``
queries; both numbers of groups follow the input. The hash spreads equal
vectors evenly.

Distances are double precision, summed component by component in order, on
the original vectors. Ties go to the smaller id.

Defined cases: vectors that are null, empty, zero, or hold a null or a
non-finite component take no part as query or candidate; only vectors of
equal length are compared (each length has trees of its own). Repeated ids
are candidates of their own, except that a query never finds a row with its
own id. Equal query rows ask once; an id that asks with several vectors has a
list for each. A null id takes no part. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import materialise

LEAF = 256
SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
FACTOR = 1.0


def usable(vector: Column) -> Column:
    """Vectors that take part: components known and finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per query; components are added in order."""
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        d = points[:, j][None, :] - queries[:, j][:, None]
        d *= d
        total += d
    return np.sqrt(total, out=total)


class Tree:
    """A vantage-point tree over ``points`` (rows), kept as arrays."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.points, self.ids = np.asfortranarray(points), ids
        self.order = np.arange(len(ids))
        rng = np.random.default_rng(seed)
        self.nodes: list[list] = []  # [begin, end] or [vantage row, inner, its bounds, outer, its bounds]
        todo = [(0, len(ids), None, 0)]
        while todo:
            a, b, parent, slot = todo.pop()
            here = len(self.nodes)
            if parent is not None:
                self.nodes[parent][slot] = here
            if b - a <= leaf:
                self.nodes.append([a, b])
                continue
            rows = self.order[a:b]
            pick = int(rng.integers(b - a))
            rows[0], rows[pick] = rows[pick], rows[0]
            d = distances(self.points[rows[1:]], self.points[rows[:1]])[0]
            rank = np.argsort(d, kind="stable")
            rows[1:] = rows[1:][rank]
            d = d[rank]
            half = len(d) // 2
            self.nodes.append([int(rows[0]), -1, d[0], d[half - 1], -1, d[half], d[-1]])
            todo.append((a + 1 + half, b, here, 4))
            todo.append((a + 1, a + 1 + half, here, 1))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int,
               factor: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distances and ids of the ``k`` best found for each query, nearest
        first; rows with the query's ``own`` id are left out."""
        m = len(queries)
        best = [(np.zeros(0), np.zeros(0, self.ids.dtype)) for _ in range(m)]
        tau = np.full(m, np.inf)

        def offer(qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = distances(self.points[rows], queries[qs])
            ids = self.ids[rows]
            for i in np.flatnonzero((d <= tau[qs][:, None]).any(axis=1)):
                q = qs[i]
                use = (d[i] <= tau[q]) & (ids != own[q])
                all_d, all_id = np.concatenate([best[q][0], d[i][use]]), np.concatenate([best[q][1], ids[use]])
                top = np.lexsort((all_id, all_d))[:k]
                best[q] = all_d[top], all_id[top]
                if len(top) == k:
                    tau[q] = all_d[top[-1]]
            return d

        home = np.zeros(m, dtype=np.int64)
        todo: list[tuple] = [(0, np.arange(m))]
        while todo:  # the leaf that each query falls into
            node, qs = todo.pop()
            n = self.nodes[node]
            if len(n) == 2:
                home[qs] = node
                offer(qs, self.order[n[0]:n[1]])
                continue
            inside = distances(self.points[[n[0]]], queries[qs])[:, 0] <= n[3]
            todo += [(child, part) for child, part in ((n[1], qs[inside]), (n[4], qs[~inside])) if len(part)]
        todo = [(0, np.arange(m), np.zeros(m))]
        while todo:  # the rest, as far as the bounds don't exclude it
            node, qs, gap = todo.pop()
            qs = qs[gap <= factor * tau[qs]]
            n = self.nodes[node]
            if len(n) == 2:
                qs = qs[home[qs] != node]
                if len(qs):
                    offer(qs, self.order[n[0]:n[1]])
            elif len(qs):
                v = offer(qs, np.array([n[0]]))[:, 0]
                for child, low, high in ((n[4], n[5], n[6]), (n[1], n[2], n[3])):
                    todo.append((child, qs, np.maximum(np.maximum(low - v, v - high), 0.0)))
        return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of
    ``vectors(vec_id, embedding)`` for each row of ``queries(vec_id,
    embedding)`` but those with the query's own id."""

    def ready(rows: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        return (rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
                .where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")))

    vectors = materialise(ready(vectors), "vectors")
    # equal rows ask once; one id with several vectors asks for each of them
    queries = materialise(ready(queries).dropDuplicates(["vec_id", "v"]).withColumn("asks", F.xxhash64("v")), "queries")
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    salt = F.xxhash64("vec_id", "v")  # equal ids and equal vectors spread alike

    def cell(shard: Column, block: Column) -> Column:
        return F.xxhash64("dim", shard.cast("int"), block.cast("int"))

    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    points = (vectors.withColumn("own", F.pmod(salt, F.lit(shards))).withColumn("other", each_block)
              .select(cell(F.col("own"), F.col("other")).alias("cell"), "vec_id", "v"))
    asked = (queries.withColumn("own", F.pmod(salt, F.lit(blocks))).withColumn("other", each_shard)
             .select(cell(F.col("other"), F.col("own")).alias("cell"), "vec_id", "asks", "v"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy().reshape(len(flat), -1)

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and others.num_rows:
            own = own.sort_by("vec_id")  # the same tree whatever order the rows came in
            tree = Tree(matrix(own["v"]), own["vec_id"].to_numpy())
            asked_ids = others["vec_id"].to_numpy()
            found = tree.search(matrix(others["v"]), asked_ids, k, factor)
            for q, asks, (d, ids) in zip(asked_ids, others["asks"].to_pylist(), found):
                out.append((np.full(len(d), q, np.int64), np.full(len(d), asks, np.int64), ids, d))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "asks", "vec_id", "score"), columns)))

    found = points.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(
        run, "query_id long, asks long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id", "asks").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(c.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                          lambda a, b: a + b)) AS score
             , q.e AS asks
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, asks ORDER BY score, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
