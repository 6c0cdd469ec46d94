import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import odd_rows
from conftest_paths import SF
from martlet.llm import mixing, quality_rules
from martlet.llm import queries as q
from tools.oracle_check import rows_of


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_counts_equal_counting_by_hand(monkeypatch):
    import random
    rng = random.Random(5)
    texts = [None, "", "\n", "a", "a a a", "\n\na\n\na\n a", *("".join(
        rng.choice("ab é\n\t#|") for _ in range(rng.randint(0, 60))) for _ in range(800))]
    monkeypatch.setattr(quality_rules, "BATCH_BYTES", 400)
    got = quality_rules.count_texts(pa.array(texts))
    fields = quality_rules._COUNT_FIELDS[:5]
    assert [tuple(int(got[f][i]) for f in fields) for i in range(len(texts))] == [counts_by_hand(t) for t in texts]


def connection(table=None):
    con = duckdb.connect()
    if table is None:
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    else:
        con.register("documents", table)
    return con


@pytest.mark.parametrize("key", ["op1_quality_rules", "op5_mix_sources", "op7_nearest"])
def test_query_equals_its_sql(spark, key):
    df = q.QUERIES[key](spark, SF)
    cur = connection().execute(q.ORACLE[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("judge, sql", [
    (lambda d: quality_rules.judge(d, least_docs=200), quality_rules.JUDGE_SQL), (mixing.mix_sizes, mixing.MIX_SIZES_SQL)])
def test_odd_rows_equal_the_sql(spark, judge, sql):
    docs = odd_rows.documents(spark)
    cur = connection(docs.select("doc_id", "text", "lang", "source").toArrow()).execute(sql)
    names = [d[0] for d in cur.description]
    got = judge(docs).select(*names)
    assert rows_of(names, [tuple(r) for r in got.collect()]) == rows_of(names, cur.fetchall())


def test_empty_tables(spark):
    assert quality_rules.judge(odd_rows.nothing(spark)).count() == 0
    assert mixing.mix_sizes(odd_rows.nothing(spark)).count() == 0
    assert mixing.mixed(odd_rows.nothing(spark)).count() == 0


def test_filter_and_mix_keep_the_columns(spark):
    docs = odd_rows.documents(spark)
    assert quality_rules.kept_documents(docs).columns == docs.columns
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_repeats_rows_as_counted_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = mixing.mix_sizes(docs)
    copies = {r.doc_id: r.copies for r in sizes.collect()}
    assert Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect()) == {d: n for d, n in copies.items() if n}
    assert copies == {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect()}
    assert max(copies.values()) <= 2


def test_repeated_ids_meet_the_target(spark):
    """A source whose rows repeat one id, with equal and with different texts."""
    words = "w " * 100
    docs = spark.range(1000).selectExpr("id AS doc_id", f"concat('{words}', id) AS text", "'s1' AS source").unionByName(
        spark.range(2000).selectExpr("-1L AS doc_id", f"IF(id % 2 = 0, '{words} x', concat('{words}', id)) AS text", "'s2' AS source"))
    rows = mixing.mix_sizes(docs.repartition(4))
    per = {r.source: r for r in rows.groupBy("source").agg(*[mixing.F.sum("taken").alias("taken"), mixing.F.max("target").alias("target"),
                                                             mixing.F.max("copies").alias("most")]).collect()}
    assert all(abs(r.taken - r.target) <= 0.03 * r.target and r.most <= 2 for r in per.values())
    again = {tuple(r): n for r, n in Counter(mixing.mix_sizes(docs.repartition(7)).collect()).items()}
    assert again == {tuple(r): n for r, n in Counter(rows.collect()).items()}
    assert mixing.mixed(docs).where("source = 's2'").count() == rows.where("source = 's2'").agg(mixing.F.sum("copies")).first()[0]


def test_level_equals_resharing_the_excess(spark):
    """The water level against the contract's iteration."""
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 50), ("d", 3), (None, 7)], "source string, size long")
    size = {r.source: r["size"] for r in sized.collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5.0, 2.0, 1.0, 5.0, 2.0]))
    stopped, left = {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in size if s not in stopped]
        share = {s: (left - sum(stopped.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * size[s]]
        if not above:
            break
        stopped |= {s: 2.0 * size[s] for s in above}
    want = stopped | share
    got = {r.source: r.target for r in mixing.source_rates(sized).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 * want[s] for s in want)
