"""Importance resampling and its radix sort against SQL, zlib and Python's sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import odd_rows
from conftest_paths import SF
from martlet.llm import importance, textkit
from martlet.llm import queries as q
from martlet.llm.radix_sort import ranked
from tools.oracle_check import rows_of

COLUMNS = ["doc_id", "n_features", "rank", "score", "weight"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def by_hand(docs, target, runs=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, runs)[1])
    t = Counter(bucket(f) for x in target for f in features(x, runs)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for d, text in docs:
        words, own = features(text, runs)
        gains = [math.floor(1000 * math.log(((t[b] + 1) * all_s) / ((s[b] + 1) * all_t))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k for k, r in enumerate(able[:len(able) * percent // 100], 1)}
    return rows_of(["doc_id", "n_features", "weight", "score", "rank"], [(*r[:4], ranks.get(id(r))) for r in rows])


def rows(df):
    assert sorted(df.columns) == COLUMNS
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(q.ORACLE["op11_importance"])
    names = [d[0] for d in cur.description]
    got = rows(q.QUERIES["op11_importance"](spark, SF))
    assert got == rows_of(names, cur.fetchall()) and any(r[2] is not None for r in got)


def test_odd_rows(spark):
    docs = odd_rows.documents(spark).repartition(3)
    target = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (3, "dog X y")], "item_id long, text string")
    pairs = [(r[0], r[1]) for r in odd_rows.ROWS]
    for options in ({"runs": 1, "percent": 100}, {"runs": 3, "buckets": 50, "least_words": 1, "percent": 50}):
        want = by_hand(pairs, [r.text for r in target.collect()], options["runs"], options.get("buckets", 10_000),
                       options.get("least_words", 20), options["percent"])
        assert rows(importance.resample(docs, target, **options)) == want
    empty = odd_rows.nothing(spark)
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(odd_rows.ROWS)
    best = importance.drawn(docs, target, percent=100).orderBy("rank").collect()
    assert [r["rank"] for r in best] == list(range(1, len(best) + 1))


def test_features_and_crc_equal_zlib(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ09 .é中_\n") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["x" * 500]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for runs in (1, 2, 4):
        found, before, words = importance.feature_buckets(data, off, runs, 997)
        for i, t in enumerate(texts):
            own, all_runs = features(t, runs)
            assert words[i + 1] - words[i] == len(own)
            assert sorted(found[before[i]:before[i + 1]].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in all_runs)
    starts = np.array([0, 3, 5, 5, 0]), np.array([0, 70, 6, 40, 200])
    front = np.array([zlib.crc32(x) for x in (b"", b"7:", b"-1:", b"12345:", b"9:")], np.uint32)
    want = [zlib.crc32(bytes(data[a:b]), int(f)) for a, b, f in zip(*starts, front)]
    assert textkit.crc32_spans(data, *starts, front).tolist() == want


@pytest.mark.parametrize("digit_bits,block_rows", [(3, 7), (11, 50), (16, None)])
def test_radix_sort_equals_sorted(spark, digit_bits, block_rows):
    rng = random.Random(digit_bits)
    data = [(rng.choice([None, 5, -3, 2**62, -2**63, 2**63 - 1, rng.randint(-9, 9)]), rng.randint(0, 3), 4, str(i))
            for i in range(400)]
    df = spark.createDataFrame(data, "a long, b int, c long, digit string").repartition(6)
    got = ranked(df, ["b", "c", "a"], digit_bits=digit_bits, block_rows=block_rows).collect()
    key = lambda r: (r[1], r[0] is None, r[0] or 0)
    assert sorted(r["rank"] for r in got) == list(range(400)) and {r["digit"] for r in got} == {x[3] for x in data}
    assert [key(r) for r in sorted(got, key=lambda r: r["rank"])] == sorted(map(key, data))


def test_radix_sort_of_equal_keys_and_of_nothing(spark):
    df = spark.range(1000).selectExpr("id", "CAST(7 AS BIGINT) AS k", "CAST(NULL AS INT) AS none").repartition(4)
    got = ranked(df, ["none", "k"], block_rows=64).collect()
    assert sorted(r["rank"] for r in got) == list(range(1000)) and len({r["id"] for r in got}) == 1000
    assert ranked(df.limit(0), ["k"]).count() == 0


def test_radix_sort_is_stable_and_blocks_stay_small(spark):
    df = spark.range(5000, numPartitions=1).selectExpr("id", "id % 3 = 0 AS hot", "IF(id % 3 = 0, 1, id % 50) AS k")
    got = ranked(df, ["k"], digit_bits=2, block_rows=100).orderBy("rank").collect()
    assert [r["id"] for r in got] == [r["id"] for r in sorted(got, key=lambda r: (r["k"], r["id"]))]
