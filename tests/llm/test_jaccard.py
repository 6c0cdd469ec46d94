import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import odd_rows
from conftest_paths import SF
from martlet.llm import jaccard_join
from martlet.llm import queries as q


def by_hand(rows):
    """``doc_id -> (class, links)`` by comparing whole shingle sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j > i:
                    both[j] += 1
        for j, n in both.items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[top(i)].append(rows[i][0])
    return {rows[i][0]: (min(members[top(i)]), links[i]) for i in range(len(rows))}


def joined(docs):
    return {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.join(docs).collect()}


def test_query_equals_comparing_all_sets(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in q.QUERIES["op9_jaccard_join"](spark, SF).collect()}
    assert got == by_hand(rows)


@pytest.fixture(scope="module")
def hot_rows():
    """A third exact copies, a large group of near copies, a line that all
    share, and unrelated texts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(words[:12])
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(base)))
    for i in range(150, 300):
        near = list(base)
        near[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(near)))
    for i in range(300, 450):
        rows.append((i, line + "\n" + " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))))
    return rows


@pytest.mark.parametrize("bucket, block", [(48, 192), (4, 16)])
def test_hot_groups_keep_every_link(spark, hot_rows, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = spark.createDataFrame(hot_rows, "doc_id long, text string")
    assert joined(docs) == by_hand(hot_rows)


def test_one_of_each_class_stays(spark, hot_rows):
    docs = spark.createDataFrame(hot_rows, "doc_id long, text string")
    want = {c for c, _ in by_hand(hot_rows).values()}
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect()) == sorted(want)


def test_classes_with_the_same_id_both_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, two), (2, one), (3, two + " c"), (1, one), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (1, two), (4, ""), (4, None)], key=str)


def test_odd_rows(spark):
    docs = odd_rows.documents(spark)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jaccard_join.join(docs).collect())
    assert got == [(0, 0, 0), (0, 5, 3), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 3), (5, 5, 3), (6, 5, 3),
                   (7, 7, 0), (8, 8, 0), (9, 9, 1), (10, 9, 1)]
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]
    assert jaccard_join.join(odd_rows.nothing(spark)).count() == 0
    assert jaccard_join.one_of_each(odd_rows.nothing(spark)).count() == 0


def test_runs_follow_the_recall():
    assert jaccard_join.runs_for(0.9, 1) < jaccard_join.runs_for(0.999, 1) < jaccard_join.runs_for(0.999, 4)


def test_pairs_at_the_similarity_meet_on_the_last_level(spark, monkeypatch):
    """No node is small or dense, as where pairs share only hot passages, so
    each pair must share a node of the last level."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 0)
    monkeypatch.setattr(jaccard_join, "_settle", lambda large, sets, similarity: (
        spark.createDataFrame([], "a long, b long"), large))
    texts = []
    for i in range(4000):  # 16 shingles, all of them among the other's 20
        words = [f"p{i}w{j}" for j in range(24)]
        texts += [(2 * i, " ".join(words[:20])), (2 * i + 1, " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = jaccard_join.materialise(jaccard_join.features(docs, jaccard_join.runs_for()), "sets")
    _, _, large = jaccard_join.chosen_paths(sets)
    met = large.select("node", "k").groupBy("node").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    found = met.where("a < b").select("a", "b").distinct().count()
    assert 4000 - found <= 4000 * (1 - jaccard_join.RECALL), f"{4000 - found} of 4000 pairs never meet"


def test_runs_count_the_loss_of_sketches():
    assert 0 < jaccard_join.sketch_loss() < 0.001
    with pytest.raises(ValueError):
        jaccard_join.runs_for(1 - jaccard_join.sketch_loss() / 2)
