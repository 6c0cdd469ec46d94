"""Similarity self-join of documents on word n-grams by chosen paths.

A document is the set of its distinct shingles (``SHINGLE`` consecutive words;
a shorter text is one shingle of all its words). Two documents are linked when
the Jaccard similarity of their sets is at least ``SIMILARITY``.

Candidates (chosen-path join). In each of several independent runs every set
picks, level by level, each of its shingles with probability
``1 / (SIMILARITY * size)``; sets that picked the same shingle share a node,
and a node is split again by the next level's picks until it holds at most
``BUCKET`` sets. A pick depends on the whole path to its node, so every node
draws anew. Two similar sets share at least one picked shingle per node on
average, so the chance to meet at depth d falls only like 1 / d; the number of
runs follows from that chance at the last level, the sketches' own loss and
the wanted recall (``runs_for``). Small nodes are compared pair by pair. A large node is first
compared with a few of its sets (``PIVOTS``): if at least half of it is
similar to the largest group of similar pivots, the node is dense (near
copies), splitting it would not help, and all of it becomes one candidate
group, whose pairs the exact check compares once for all runs. Other large
nodes are split. What even the last level leaves large is cut into blocks and
every pair of blocks is compared in a cell of its own, so nothing is capped.
Comparisons inside nodes use 64-byte min-hash sketches with a wide margin and
give only a spanning forest of each node's similar sets.

Exact check. The forests' connected components are candidate groups. Inside
each group, in blocks where it is large, the whole shingle sets are compared
exactly: that gives every document's number of links and the exact edges
(again as forests), and the components of those are the classes.

No step lists all pairs of a group: rows passed on are linear in the
documents, the levels and the block pairs. Exact copies are one member with a
count throughout; texts are told apart by a 64-bit hash.

Results: one row per document with ``class_id`` (the smallest ``doc_id`` of
its class) and ``n_links`` (other documents, copies included, at or above the
similarity).

Defined cases: a null text, or one without any word, has no shingle and links
to nothing; its class is itself. Repeated rows are copies of each other.
A null ``doc_id`` still takes part; if a class has no other id, its class id
is null. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm import textkit
from martlet.llm.common import lean, materialise
from martlet.plans.joins import broadcast_if_bounded

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.999
LEVELS = 3
BUCKET = 48
PIVOTS = 8
BLOCK = 192
SKETCH = 64
SKETCH_MARGIN = 0.16
BATCH_BYTES = 512 << 10
DRAWS = 256 << 10
_HAS_WORD = r"[^\x20\x09-\x0D]"


def sketch_loss(similarity: Fraction = SIMILARITY) -> float:
    """Chance that the sketches of a pair at the similarity agree in too few
    positions: equal minima, or different ones with equal bytes."""
    agree = float(similarity) + (1 - float(similarity)) / 256
    least = math.ceil((float(similarity) - SKETCH_MARGIN) * SKETCH)
    return sum(math.comb(SKETCH, i) * agree ** i * (1 - agree) ** (SKETCH - i) for i in range(least))


def runs_for(recall: float = RECALL, levels: int = LEVELS, similarity: Fraction = SIMILARITY) -> int:
    """Runs so that a pair at the similarity meets and its sketches agree with
    probability ``recall`` although it may have to meet on every level: each
    shared node has about a Poisson number of common picks with mean at least
    one, drawn independently of other nodes."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    missed = 1 - recall / (1 - sketch_loss(similarity))
    if missed <= 0:
        raise ValueError(f"sketches of {SKETCH} bytes can't give a recall of {recall}")
    return math.ceil(math.log(missed) / math.log(1 - p))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a batch, text after text, and
    the number before each text."""
    starts, ends, before = textkit.word_spans(data, offsets)
    words = textkit.span_hashes(data, starts, ends)
    n_texts, counts = len(offsets) - 1, np.diff(before)
    text_of = np.repeat(np.arange(n_texts), counts)
    windows = textkit.window_hashes(words, size)
    at = np.flatnonzero(text_of[:len(windows)] == text_of[size - 1:]) if len(windows) else np.zeros(0, np.int64)
    hashes, owner = [windows[at]], [text_of[at]]
    for n in range(1, size):  # shorter texts: one shingle of all n words
        short = np.flatnonzero(counts == n)
        if len(short):
            at = before[short]
            hashes.append(textkit.mix64(textkit.window_hashes(words, n)[at] + np.uint64(n)))
            owner.append(short)
    h, o = np.concatenate(hashes), np.concatenate(owner)
    keep = ~pd.Series(textkit.mix64(h + textkit.mix64(o.astype(np.uint64)))).duplicated().to_numpy()
    h, o = h[keep], o[keep]
    order = np.argsort(o, kind="stable")
    return h[order], np.searchsorted(o[order], np.arange(n_texts + 1))


def _multipliers(n: int, salt: int) -> np.ndarray:
    return textkit.mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def _draw(h: np.ndarray, before: np.ndarray, bound: np.ndarray, owner: np.ndarray,
          node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What sets pick at their nodes: for each pick the place in ``owner, node``
    and that of the shingle in ``h``, in order. ``before`` and ``bound`` are by set."""
    sizes, by = np.diff(before)[owner], textkit.mix64(node) | np.uint64(1)
    ends = np.cumsum(sizes)
    found, i = [(np.zeros(0, np.int64),) * 2], 0
    while i < len(owner):
        base = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, base + DRAWS, side="right")))
        n, upto, own = sizes[i:j], ends[i:j] - base, owner[i:j]
        at = np.arange(upto[-1]) + np.repeat(before[own] - (upto - n), n)
        hit = np.flatnonzero(h[at] * np.repeat(by[i:j], n) < np.repeat(bound[own], n))
        found.append((i + np.searchsorted(upto, hit, side="right"), at[hit]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found))


def features(docs: DataFrame, runs: int, levels: int = LEVELS, similarity: Fraction = SIMILARITY,
             shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct text with a word: ``k, size, sketch`` and for each
    level the nodes of its picks ``nodes<l>``; ``from<l>`` beside them is the
    place in ``nodes<l-1>`` of the node that a pick splits."""
    rows = docs.select(text_key(F.col("text")).alias("k"), F.col("text")).where(F.col("text").rlike(_HAS_WORD))
    names = ["nodes1", *[f"{n}{level}" for level in range(2, levels + 1) for n in ("from", "nodes")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies inside one task are one row
        roots, sketch_by = _multipliers(runs, 11), _multipliers(SKETCH, 23)
        for b in batches:
            keys = b.column(0).to_pylist()
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            keys, texts = [keys[i] for i in fresh], b.column(1).take(pa.array(fresh, pa.int64()))
            for first, data, off in textkit.utf8_batches(texts, BATCH_BYTES):
                h, before = shingle_sets(data, off, shingle)
                sizes = np.diff(before)
                bound = np.minimum(2.0 ** 64 / (float(similarity) * sizes), float(2 ** 64 - 2048)).astype(np.uint64)
                out: list[pa.Array] = [pa.array(keys[first:first + len(sizes)], pa.int64()), pa.array(sizes, pa.int32())]
                sketch = np.stack([np.minimum.reduceat((h ^ (m >> np.uint64(7))) * m >> np.uint64(32), before[:-1])
                                   for m in sketch_by], axis=1).astype(np.uint8)
                out.append(pa.array([s.tobytes() for s in sketch], pa.binary()))
                owner, node = np.repeat(np.arange(len(sizes)), runs), np.tile(roots, len(sizes))
                for level in range(levels):
                    path, at = _draw(h, before, bound, owner, node)
                    place = path - np.searchsorted(owner, owner[path])
                    owner, node = owner[path], textkit.mix64(node[path] * np.uint64(0x9E3779B97F4A7C15) + h[at])
                    cuts = pa.array(np.searchsorted(owner, np.arange(len(sizes) + 1)), pa.int32())
                    if level:
                        out.append(pa.ListArray.from_arrays(cuts, pa.array(place, pa.int32())))
                    out.append(pa.ListArray.from_arrays(cuts, pa.array(node.view(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["k", "size", "sketch", *names])

    picks = ", ".join(f"{n} array<{'int' if n.startswith('from') else 'bigint'}>" for n in names)
    return rows.mapInArrow(lean(run), f"k long, size int, sketch binary, {picks}").dropDuplicates(["k"])


def _nodes(rows: DataFrame, label: str) -> DataFrame:
    """``node, at, k, n`` of the nodes with company; counts combine on the map
    side, and a node with very many sets is a skewed join that Spark splits."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(rows.join(counts, "node"), label)


def _matches(sketch: np.ndarray, size: np.ndarray, others: np.ndarray, other_size: np.ndarray,
             similarity: Fraction) -> np.ndarray:
    """Which sets are similar to which others, by sketches and sizes."""
    least, ratio = (float(similarity) - SKETCH_MARGIN) * SKETCH, float(similarity)
    out = np.empty((len(sketch), len(others)), dtype=bool)
    for j in range(len(others)):
        near = np.minimum(size, other_size[j]) >= ratio * np.maximum(size, other_size[j]) - 1e-9
        out[:, j] = near & (np.count_nonzero(sketch == others[j], axis=1) >= least)
    return out


def _sketches(column: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    blobs = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, SKETCH)


def _by_node(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """Rows of each node of a batch, and the sets in its ``others`` column."""
    node = batch.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    cuts = [*np.flatnonzero(np.concatenate([[True], np.diff(node[order]) != 0])).tolist(), len(node)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield order[i:j], batch.column("others")[int(order[i])].as_py()


def _settle(large: DataFrame, sets: DataFrame, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """Compare large nodes with pivots: ``a, b`` edges of the dense nodes, one
    per member, and the rows ``node, at, n, k`` of the other nodes."""
    columns = ["node", "at", "n", "k", "size", "sketch"]
    members = materialise(large.join(sets.select("k", "size", "sketch"), "k").select(columns), "large")

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, size = b.column("k").to_numpy(), b.column("size").to_numpy()
            sketch = _sketches(b.column("sketch"))
            centre, near = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=bool)
            for rows, others in _by_node(b):
                pk, ps = np.array([o["k"] for o in others]), np.array([o["size"] for o in others])
                pv = _sketches([o["sketch"] for o in others])
                root = _roots(len(pk), *np.nonzero(np.triu(_matches(pv, ps, pv, ps, similarity), 1)))
                main = np.bincount(root).argmax()  # the largest group of similar pivots
                own = root == main
                centre[rows] = pk[main]
                near[rows] = _matches(sketch[rows], size[rows], pv[own], ps[own], similarity).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("node", "at", "n", "k")], pa.array(centre), pa.array(near)],
                names=["node", "at", "n", "k", "centre", "near"])

    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "k"), "k"))
    pivots = (members.withColumn("turn", turn).where(F.col("turn") <= PIVOTS).groupBy("node")
              .agg(F.array_sort(F.collect_list(F.struct("k", "size", "sketch"))).alias("others")))
    beside = members.join(broadcast_if_bounded(materialise(pivots, "pivots")), "node").select(*columns, "others")
    compared = materialise(beside.mapInArrow(
        lean(with_pivots), "node long, at int, n long, k long, centre long, near boolean"), "compared")
    dense = compared.groupBy("node").agg(F.count_if("near").alias("near"), F.count(F.lit(1)).alias("all"))
    dense = materialise(dense.where(2 * F.col("near") >= F.col("all")).select("node"), "dense")
    edges = (compared.join(dense, "node", "left_semi").where("centre <> k")
             .select(F.col("centre").alias("a"), F.col("k").alias("b")).distinct())
    return materialise(edges, "edges"), compared.join(dense, "node", "left_anti").select("node", "at", "n", "k")


def chosen_paths(sets: DataFrame, levels: int = LEVELS,
                 similarity: Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node, k`` of the nodes that are small enough, ``a, b`` edges of the
    dense nodes, and ``node, k, n`` of those that the last level leaves large."""
    rows = sets.select("k", F.posexplode("nodes1").alias("at", "node"))
    small = settled = None
    for level in range(1, levels + 1):
        nodes = _nodes(rows, f"paths{level}")
        few = nodes.where(F.col("n") <= BUCKET).select("node", "k")
        small = few if small is None else small.unionByName(few)
        edges, large = _settle(nodes.where(F.col("n") > BUCKET), sets, similarity)
        settled = edges if settled is None else settled.unionByName(edges)
        if level == levels:
            break
        below, splits = F.col(f"nodes{level + 1}"), F.col(f"from{level + 1}")
        own = F.transform(below, lambda x, i: F.struct(F.get(splits, i).alias("from"), i.alias("at"), x.alias("node")))
        rows = (large.join(sets.select("k", own.alias("own")), "k")
                .select("k", F.explode(F.filter("own", lambda x: x["from"] == F.col("at"))).alias("p"))
                .select("k", "p.at", "p.node"))
    return small, settled, large.select("node", "k", "n")


def _cells(rows: DataFrame, group: str, n: Column, member: str) -> DataFrame:
    """``cell, side``: a group of at most ``BLOCK`` members is one cell; a
    larger one is cut into blocks, and each pair of blocks is a cell."""
    blocks = F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("_b", blocks).withColumn("_own", F.expr(f"pmod(xxhash64({member}), _b)").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    rows = rows.withColumn("_other", other)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return (rows.withColumn("cell", F.xxhash64(F.col(group), low, high))
            .withColumn("side", F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1)
                        .otherwise(2).cast("byte"))
            .drop("_b", "_own", "_other"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the least member of its component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole cells from rows sorted by cell (first column)."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        cell = held["cell"].to_numpy()
        cut = int(np.searchsorted(cell, cell[-1], side="left"))
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs(cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside cells (across the two sides where a cell has two), in
    runs of cells with equal numbers of members."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    for n in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(int(n), 1)
        step = max(1, 200_000 // len(a))
        of = starts[sizes == n]
        for i in range(0, len(of), step):
            left = (of[i:i + step, None] + a).ravel()
            right = (of[i:i + step, None] + b).ravel()
            want = (side[left] == 0) | (side[left] != side[right])
            yield left[want], right[want]


def sketch_edges(members: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``a, b``: forests of the similar sets of each cell, by sketches."""
    least = (float(similarity) - SKETCH_MARGIN) * SKETCH
    ratio = float(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            k, size = table["k"].to_numpy(), table["size"].to_numpy()
            sketch = _sketches(table["sketch"])
            found = [(np.zeros(0, np.int64),) * 2]
            for a, b in _pairs(table["cell"].to_numpy(), table["side"].to_numpy()):
                near = np.minimum(size[a], size[b]) >= ratio * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[near], b[near]
                close = np.count_nonzero(sketch[a] == sketch[b], axis=1) >= least
                found.append((a[close], b[close]))
            root = _roots(len(k), *(np.concatenate(x) for x in zip(*found)))
            at = np.flatnonzero(root != np.arange(len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(k[root[at]]), pa.array(k[at])], names=["a", "b"])

    ordered = members.select("cell", "side", "k", "size", "sketch").repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(lean(run), "a long, b long").where("a <> b")


def _contract(edges: DataFrame, label: str) -> DataFrame:
    """Fewer ``edges(a, b)`` with the same components: each vertex keeps its
    least smaller neighbour, and its other smaller neighbours are tied to that
    one instead (many vertices share these ties)."""
    down = materialise(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                       .where("u < v").distinct(), f"{label}-down")
    least = down.groupBy("v").agg(F.min("u").alias("m"))
    ties = down.join(least, "v").where("u > m").select(F.col("m").alias("a"), F.col("u").alias("b"))
    return materialise(least.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(ties).distinct(),
                       f"{label}-fewer")


def components(edges: DataFrame, label: str) -> DataFrame:
    """``k, root`` of every vertex of ``edges(a, b)``: the least vertex of its
    component. The edges are contracted twice, then neighbours' minima spread
    with pointer jumping; each round is written once."""
    edges = _contract(_contract(edges, label), label)
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{label}-both")
    state = materialise(both.groupBy(F.col("a").alias("k")).agg(F.min(F.least("a", "b")).alias("root")), label)
    while True:
        heard = (both.join(state, both["a"] == state["k"]).groupBy(F.col("b").alias("k"))
                 .agg(F.min("root").alias("heard")))
        told = state.join(heard, "k").select("k", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        up = state.select(F.col("k").alias("root"), F.col("root").alias("up"))
        new = materialise(told.join(up, "root").select("k", "before", F.least("root", "up").alias("root")), label)
        if new.where("root <> before").isEmpty():
            return new.select("k", "root")
        state = new.select("k", "root")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True)
        return np.array([[len(sets[0]), len(both)], [len(both), len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    codes, uniques = pd.factorize(np.concatenate(sets))
    used = np.bincount(codes, minlength=len(uniques))[codes] > 1
    codes, owner = pd.factorize(codes[used])[0], owner[used]
    out = np.zeros((n, n))
    for low in range(0, int(codes.max(initial=-1)) + 1, 4096):
        part = (codes >= low) & (codes < low + 4096)
        x = np.zeros((n, 4096), dtype=np.float32)
        x[owner[part], codes[part] - low] = 1
        out += x @ x.T
    return out.round().astype(np.int64)


def exact_links(members: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``k, root, links`` per member and cell: the least member of its exact
    component in the cell, and the number of linked documents in it, of
    ``members(cell, side, k, copies, shingles)``."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell, side = table["cell"].to_numpy(), table["side"].to_numpy()
            k, copies = table["k"].to_numpy(), table["copies"].to_numpy()
            blobs = table["shingles"].to_pylist()
            cuts = [*np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist(), len(k)]
            roots, links = k.copy(), np.zeros(len(k), dtype=np.int64)
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i < 2:
                    continue
                sets = [np.frombuffer(x, np.int64) for x in blobs[i:j]]
                size = np.array([len(s) for s in sets])
                both = _intersections(sets)
                linked = both * (num + den) >= num * (size[:, None] + size[None, :])
                s = side[i:j]
                linked &= (s[:, None] == 0) | (s[:, None] != s[None, :])
                np.fill_diagonal(linked, False)
                links[i:j] = linked @ copies[i:j]
                order = np.argsort(k[i:j])
                a, b = np.nonzero(np.triu(linked[np.ix_(order, order)], 1))
                root = np.empty(j - i, dtype=np.int64)
                root[order] = order[_roots(j - i, a, b)]
                roots[i:j] = k[i:j][root]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(roots), pa.array(links)], names=["k", "root", "links"])

    ordered = (members.select("cell", "side", "k", "copies", "shingles")
               .repartition("cell").sortWithinPartitions("cell"))
    return ordered.mapInArrow(lean(run), "k long, root long, links long")


def _with_shingles(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the shingle set of its last column ``text`` instead of it."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for _, data, off in textkit.utf8_batches(b.column(b.num_columns - 1), BATCH_BYTES):
                h, before = shingle_sets(data, off, size)
                h = h.view(np.int64)
                blobs += [h[i:j].tobytes() for i, j in zip(before[:-1].tolist(), before[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(blobs, pa.binary())],
                                             names=[*b.schema.names[:-1], "shingles"])

    return rows.mapInArrow(lean(run), f"{fields}, shingles binary")


def join(docs: DataFrame, similarity: Fraction = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL,
         levels: int = LEVELS) -> DataFrame:
    """``doc_id, k, root, class_id, n_links`` of every row of ``docs``; ``k`` is
    the hash of its text, ``root`` the least ``k`` of its class (null for a text
    without a word)."""
    sets = materialise(features(docs, runs_for(recall, levels, similarity), levels, similarity, shingle), "sets")
    small, settled, large = chosen_paths(sets, levels, similarity)
    cells = small.withColumn("cell", F.col("node")).withColumn("side", F.lit(0).cast("byte")).select("cell", "side", "k")
    cells = cells.unionByName(_cells(large, "node", F.col("n"), "k").select("cell", "side", "k"))
    edges = settled.unionByName(sketch_edges(cells.join(sets.select("k", "size", "sketch"), "k"), similarity))
    groups = components(edges, "groups")

    rows = materialise(docs.select("doc_id", text_key(F.col("text")).alias("k"),
                                   F.coalesce(F.col("text").rlike(_HAS_WORD), F.lit(False)).alias("has_word")), "rows")
    texts = rows.where("has_word").groupBy("k").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("copies"))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    wanted = broadcast_if_bounded(materialise(
        groups.join(sizes, "root").join(texts, "k").select("k", F.col("root").alias("g"), "n", "rid", "copies"), "wanted"))
    found = (docs.select("doc_id", text_key(F.col("text")).alias("_k"), "text")
             .join(wanted, (F.col("_k") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rid")))
             .select("k", "g", "n", "copies", "text"))
    members = materialise(_with_shingles(found, shingle).dropDuplicates(["k"]), "members")
    checked = materialise(exact_links(_cells(members, "g", F.col("n"), "k"), similarity), "checked")
    exact = components(checked.where("root <> k").select(F.col("root").alias("a"), F.col("k").alias("b")), "classes")
    links = checked.groupBy("k").agg(F.sum("links").alias("links"))

    classed = (texts.join(exact, "k", "left").join(links, "k", "left")
               .select("k", "rid", "copies", F.coalesce("root", "k").alias("root"),
                       F.coalesce("links", F.lit(0)).alias("links")))
    least = classed.groupBy("root").agg(F.min("rid").alias("class_id"))
    answers = materialise(classed.join(least, "root").select(
        F.col("k").alias("_k"), "root", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")), "answers")
    out = rows.join(answers, (rows["k"] == answers["_k"]) & rows["has_word"], "left")
    return out.select("doc_id", "k", "root", F.when(F.col("has_word"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the one with the least ``doc_id``
    (of equal ids the least text hash). Classes with the same id are told apart
    by their text. Rows with a null id, and texts without a word, stay."""
    judged = materialise(join(docs, **options), "judged")
    rows = judged.where("root IS NOT NULL AND doc_id = class_id").groupBy("root", "doc_id", "k").agg(
        F.count(F.lit(1)).alias("n"))
    keep = rows.groupBy("root").agg(F.min(F.struct("k", "doc_id", "n")).alias("first")).select("first.*")
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"),
                         text_key(F.col("text")).alias("_k"))
    bounded = broadcast_if_bounded(materialise(keep, "keep"))
    wordy = F.coalesce(F.col("_text").rlike(_HAS_WORD), F.lit(False))
    kept = packed.where(wordy).join(bounded, (F.col("_id") == F.col("doc_id")) & (F.col("_k") == F.col("k")))
    single = kept.where("n = 1").select("_doc.*")
    # rows that occur more than once: the copies of the kept row go
    repeated = kept.where("n > 1").dropDuplicates(["_id", "_k"]).select("_doc.*")
    others = packed.where(F.col("_id").isNull() | ~wordy).select("_doc.*")
    return single.unionByName(repeated).unionByName(others)
