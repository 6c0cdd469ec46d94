"""Spelling variants against SQL and comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import odd_rows
from conftest_paths import SF
from martlet.llm import queries as q
from martlet.llm import spelling
from tools.oracle_check import rows_of

COLUMNS = ["form", "form_n", "n", "n_near", "root", "word"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_by_hand(docs, corrupt=199, least=6):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if corrupt and h % corrupt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= least
    return +counts


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    for c in letters:
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1:] for i in range(len(w))}
    return out - {w}


def group_by_hand(counts, ratio=5):
    letters = set("".join(counts))
    rows = {}
    for w, n in counts.items():
        near = [v for v in edits(w, letters) if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = [n, len(near), form, counts[form] if form else None]
    out = []
    for w, r in rows.items():
        root = w
        while rows[root][2]:
            root = rows[root][2]
        out.append((w, *r, root))
    return rows_of(["word", "n", "n_near", "form", "form_n", "root"], out)


def rows(df):
    assert sorted(df.columns) == COLUMNS
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(q.ORACLE["op12_spelling"])
    names = [d[0] for d in cur.description]
    got = rows(q.QUERIES["op12_spelling"](spark, SF))
    assert got == rows_of(names, cur.fetchall()) and any(r[0] is not None for r in got)


def test_counts_equal_counting_by_hand():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abAÉé÷×ÿ 中😀\n-") for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["", "x" * 300]
    for corrupt, least in ((2, 1), (199, 6), (None, 2)):
        want = count_by_hand(enumerate(texts), corrupt, least)
        got = spelling.count_in_batch(texts, [str(i) for i in range(len(texts))], corrupt, least)
        assert got == dict(want)


def test_odd_rows(spark, monkeypatch):
    docs = odd_rows.documents(spark).unionByName(odd_rows.documents(spark)).repartition(3)
    pairs = [(r[0], r[1]) for r in odd_rows.ROWS] * 2
    for options in ({"corrupt": 2, "least_letters": 1, "least_count": 1, "ratio": 2}, {}):
        counts = count_by_hand(pairs, options.get("corrupt", 199), options.get("least_letters", 6))
        counts = {w: n for w, n in counts.items() if n >= options.get("least_count", 5) and w}
        assert rows(spelling.variants(docs, **options)) == group_by_hand(counts, options.get("ratio", 5))
    assert spelling.variants(odd_rows.nothing(spark)).count() == 0


@pytest.mark.parametrize("chunk_letters", [40, 8 << 10])
def test_groups_equal_comparing_all_words(spark, chunk_letters):
    """Many words share a half, so that with small chunks a half has many cells."""
    rng = random.Random(11)
    counts = {}
    for _ in range(700):
        tail = "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
        counts[rng.choice(["common" + tail, tail + "ending", tail, tail * 2])] = rng.choice([5, 5, 6, 30, 31, 200, 1500])
    for w in ("aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdef", "abcdfe", "y" * 3000, "y" * 2999 + "z", "y" * 3001):
        counts[w] = rng.choice([5, 25, 125])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert rows(spelling.group(words, chunk_letters=chunk_letters)) == group_by_hand(counts)


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(x, y) == (y in edits(x, "ab"))


def test_chains_of_forms_are_followed(spark):
    """26 steps, each to a word five times as frequent."""
    chain = {"a" * (6 + i): 5 ** (i + 1) for i in range(26)}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert rows(spelling.group(words)) == group_by_hand(chain)
