"""Exact deduplication against grouping whole texts."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import odd_rows
from conftest_paths import SF
from martlet.llm import chunk_recipes
from martlet.llm import queries as q
from tools.oracle_check import rows_of

COLUMNS = ["doc_id", "group_size", "keep_id", "kept", "text_sha256"]


def by_hand(rows):
    """Rows of ``classes`` for ``(doc_id, text)`` rows, by grouping texts."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: (d is not None, d), reverse=True)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(d, len(ids), ids[0], k == 0, sha) for k, d in enumerate(ids)]
    return rows_of(COLUMNS, out)


def rows(df):
    return rows_of(COLUMNS, [tuple(r) for r in df.select(*COLUMNS).collect()])


def test_query_equals_its_sql(spark):
    df = q.QUERIES["op13_chunk_recipes"](spark, SF)
    cur = duckdb.connect()
    cur.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur.execute(q.ORACLE["op13_chunk_recipes"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns) == COLUMNS
    assert rows(df) == rows_of(names, cur.fetchall())


def test_cuts_follow_the_text_alone():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 31, 64, 100, 5000, 20_000, 70_000)]
    data, off = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = chunk_recipes.cuts(data, off, 6, 64, 400)
    for t, at, ends in zip(texts, off.tolist(), together):
        assert [e - at for e in ends] == chunk_recipes.cuts(t, np.array([0, len(t)]), 6, 64, 400)[0]
        sizes = np.diff([at, *ends])
        assert ends[-1:] == ([at + len(t)] if len(t) else []) and (sizes[:-1] >= 64).all() and (sizes <= 400).all()
    # a passage moved to another text gives the same chunks but for its first and last
    passage = rng.integers(97, 123, 30_000, dtype=np.uint8)
    chunks = []
    for head in (10, 1777):
        t = np.concatenate([rng.integers(97, 123, head, dtype=np.uint8), passage])
        ends = chunk_recipes.cuts(t, np.array([0, len(t)]))[0]
        chunks.append({bytes(t[a:b]) for a, b in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2


def test_a_long_text_is_cut_in_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8)
    whole = chunk_recipes.cuts(data, np.array([0, len(data)]))
    monkeypatch.setattr(chunk_recipes, "BATCH_BYTES", 777)
    assert chunk_recipes.cuts(data, np.array([0, len(data)])) == whole


def test_odd_rows(spark):
    docs = odd_rows.documents(spark).repartition(3)
    assert rows(chunk_recipes.classes(docs)) == by_hand([(r[0], r[1]) for r in odd_rows.ROWS])
    assert chunk_recipes.classes(odd_rows.nothing(spark)).count() == 0
    kept = chunk_recipes.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len({r[1] or "" for r in odd_rows.ROWS})


@pytest.mark.parametrize("held_bytes", [1, 8 << 20])
@pytest.mark.parametrize("values", [1, 3, 1 << 40])
def test_fingerprints_that_collide_are_verified(spark, values, held_bytes):
    """With so few fingerprints nearly all chunks collide, in one task's set and
    across tasks; texts of the same chunks in another order differ, too."""
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcdef \né") for _ in range(n)) for n in (700, 900, 2500, 6000, 40, 0)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(120)] + [None, parts[0]] * 30
    rows_in = [(i if i % 7 else None, t) for i, t in enumerate(texts)]

    def of_chunk(chunk):
        return (int.from_bytes(chunk_recipes.fingerprint(chunk), "big") % values).to_bytes(16, "big")

    docs = spark.createDataFrame(rows_in, "doc_id long, text string").repartition(5)
    assert rows(chunk_recipes.classes(docs, of_chunk=of_chunk, held_bytes=held_bytes)) == by_hand(rows_in)


def test_a_third_of_all_rows_are_copies(spark):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('the same text ', 300) ELSE concat('text ', id div 2) END AS text")
    assert rows(chunk_recipes.classes(docs)) == by_hand([(r[0], r[1]) for r in docs.collect()])


def test_texts_do_not_reach_the_grouping(spark):
    """Lists of identifiers are shuffled, texts and chunks are not."""
    plan = q.QUERIES["op13_chunk_recipes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.replace("content:", "") and "Arrow" not in plan
