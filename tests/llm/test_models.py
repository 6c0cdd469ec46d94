import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import odd_rows
from conftest_paths import SF, SF_CHECK
from martlet.llm import kneser_ney, toxicity
from martlet.llm import queries as q


def symbols(text, order):
    fold = [max(ord(c), 3) if ord(c) < 3840 else 3840 + (ord(c) & 255) for c in text or ""]
    return [1] * (order - 1) + fold + [2]


class ByHand:
    """Interpolated modified Kneser-Ney probabilities from nested dictionaries."""

    def __init__(self, texts, scored, order):
        self.order = order
        grams = Counter(tuple(s[i:i + order]) for s in (symbols(t, order) for t in texts) for i in range(len(s) - order + 1))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.held = {}, {}, {}
        for k, c in self.counts.items():
            n = [sum(v == i for v in c.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = (1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0,
                 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
            self.discount[k] = [0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]
            self.total[k], self.held[k] = defaultdict(float), defaultdict(float)
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.held[k][g[:-1]] += self.discount[k][min(v, 3)]

    def p(self, gram):
        k = len(gram)
        rest = self.p(gram[1:]) if k > 1 else 1 / 4096
        total = self.total[k].get(gram[:-1], 0)
        if not total:
            return rest
        v = self.counts[k].get(gram, 0)
        return (v - self.discount[k][min(v, 3)]) / total + self.held[k][gram[:-1]] / total * rest

    def log_prob(self, text):
        s = symbols(text, self.order)
        return sum(math.log(self.p(tuple(s[i:i + self.order]))) for i in range(len(s) - self.order + 1))


def test_scores_equal_a_model_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(
        odd_rows.documents(spark).where("doc_id <> 7").select("doc_id", "text", "lang", "source", "n_chars")
        .withColumn("doc_id", -odd_rows.F.col("doc_id")))
    rows = docs.collect()
    trusted = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id % 3 == 1]
    model = ByHand([r.text for r in rows if r.doc_id in trusted], None, 3)
    ids = spark.createDataFrame([(d,) for d in [*trusted, None, trusted[0]]], "doc_id long")
    got = kneser_ney.score(docs, ids, order=3).collect()
    want = sorted((r.doc_id or 0, model.log_prob(r.text)) for r in rows)
    assert len(got) == len(want)
    for (d, x), (e, y) in zip(sorted((r.doc_id or 0, r.log_prob) for r in got), want):
        assert d == e and abs(x - y) < 1e-4 * abs(y) + 1e-6


def test_probabilities_of_a_context_sum_to_one():
    model = ByHand(["abracadabra", "banana"], None, 3)
    context = tuple(symbols("abr", 3)[2:4])
    assert abs(sum(model.p((*context, c)) for c in range(4096)) - 1) < 1e-9


def test_quality_query_agrees_with_labels(spark):
    got = q.QUERIES["op10_quality_model"](spark, SF_CHECK)
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    rows = got.join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2
    assert got.count() == 1000


def test_a_rare_language_keeps_its_clean_documents(spark):
    rng = np.random.default_rng(4)
    words = ["".join(chr(c) for c in rng.integers(0x430, 0x450, rng.integers(2, 9))) for _ in range(300)]
    rare = [(-i, " ".join(rng.choice(words, 80)), lang) for i, lang in enumerate(["ru"] * 20 + [None] * 15 + ["xx"], 1)]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = kneser_ney.judge(docs, labels.where("quality = 1").select("doc_id"))
    assert [r.doc_id for r in got.where("doc_id < 0 AND NOT kept").collect()] == []


def test_held_out_documents_do_not_train(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    got = kneser_ney.materialise(kneser_ney.judge(docs, trusted), "judged")
    held = got.where("held_out").select("doc_id")
    assert 0 < held.count() < trusted.count() and got.where("held_out AND trusted = 0").count() == 0
    alone = {r.doc_id: r.log_prob for r in kneser_ney.score(docs, trusted.join(held, "doc_id", "left_anti")).collect()}
    assert {r.doc_id: r.log_prob for r in got.collect()} == pytest.approx(alone)


def test_a_rejected_row_takes_no_other_with_its_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good, bad = docs.join(labels, "doc_id").where("lang = 'en'").first().text, "zqxj#vk%wq " * 60
    odd = spark.createDataFrame([(-1, good, "en"), (-1, bad, "en"), (None, bad, "en")], docs.schema)
    kept = kneser_ney.kept_documents(docs.unionByName(odd), labels).where("doc_id = -1 OR doc_id IS NULL").collect()
    assert [(r.doc_id, r.text) for r in kept] == [(-1, good)]


def test_quality_odd_rows(spark):
    docs, labels = odd_rows.documents(spark), odd_rows.labels(spark)
    trusted = labels.where("quality = 1").select("doc_id")
    got = kneser_ney.judge(docs, trusted)
    assert got.count() == len(odd_rows.ROWS)
    kept = kneser_ney.kept_documents(docs, trusted)
    assert kept.columns == docs.columns and kept.where("doc_id IN (5, 6)").count() == 3
    assert kneser_ney.judge(odd_rows.nothing(spark), trusted).count() == 0
    assert kneser_ney.judge(docs, trusted.limit(0)).where("kept").count() == len(odd_rows.ROWS)


def test_nnpu_finds_the_marker():
    rng = np.random.default_rng(0)
    n, markers = 900, 4
    toxic = rng.random(n) < 0.2
    positive = np.concatenate([np.ones(200, bool), np.zeros(n, bool)])
    truth = np.concatenate([np.ones(200, bool), toxic])
    doc, feature = [], []
    for i, t in enumerate(truth):
        for f in {*rng.integers(markers, 60, 8), *(rng.integers(0, markers, 2) if t else [])}:
            doc.append(i)
            feature.append(f)
    w = toxicity.fit_nnpu(positive, np.array(doc), np.array(feature), np.ones(len(doc)), 60, 0.2, seed=1)
    z = np.bincount(doc, weights=w[feature], minlength=len(truth)) + w[-1]
    assert ((z > 0) == truth).mean() > 0.95


def test_toxicity_held_out(spark):
    got = q.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) >= 0.9 and np.mean(clean) <= 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_learns_no_held_out_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic"))
                                .otherwise(toxicity.F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_odd_rows(spark):
    docs = odd_rows.documents(spark)
    for labels in (odd_rows.labels(spark), odd_rows.labels(spark).limit(0)):
        got = toxicity.judge(docs, labels).collect()
        assert len(got) == len(odd_rows.ROWS) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert toxicity.clean_documents(docs, odd_rows.labels(spark)).columns == docs.columns
    assert toxicity.judge(odd_rows.nothing(spark), odd_rows.labels(spark)).count() == 0


@pytest.mark.parametrize("word", ["idiot", "ä", "x" * 30])
def test_words_hold_their_borders(word):
    grams = toxicity.grams_of(word)
    assert f"<{word}>" in grams and all(g in f"<{word}>" for g in grams)


def test_positive_labels_alone_do_not_flag_the_rest(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.judge(docs, labels.where("toxic = 1")).where("held_out").collect()}
    clean = [r.doc_id for r in labels.where("toxic = 0").collect() if r.doc_id in predicted]
    toxic = [r.doc_id for r in labels.where("toxic = 1").collect() if r.doc_id in predicted]
    assert sum(predicted[d] for d in clean) <= 0.05 * len(clean) and sum(predicted[d] for d in toxic) >= 0.8 * len(toxic)


def test_the_sample_holds_one_text_of_each_id(spark):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 1, id) AS doc_id", "concat('text ', id % 7) AS text")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80) if i % 3], "doc_id long, toxic int")
    sample = toxicity._examples(docs, labels, 5, 9)
    assert {r.positive: r.n for r in sample.groupBy("positive").agg(toxicity.F.count("text").alias("n")).collect()} == {1: 5, 0: 9}


def test_scores_equal_a_plain_sum_over_words_and_grams(spark):
    """Features by brute force: every n-gram of every distinct word."""
    import math as m
    weights = {"<ba": 0.5, "bad>": 1.25, "<bad>": -0.25, "ugl": 2.0, "<an": 0.125, "ooo": 4.0}
    texts = [None, "", "Bad bad BAD!", "an ugly, baddie; ooooo", "good 123 ugl", "àn bad-ugly"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.Model(weights, -1.0)).collect()}
    for i, t in enumerate(texts):
        z = -1.0 + sum(weights.get(g, 0.0) for w in toxicity.words_of(t) for g in toxicity.grams_of(w))
        assert abs(got[i] - 1 / (1 + m.exp(-z))) < 1e-12
