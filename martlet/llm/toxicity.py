"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic examples (P) and unlabelled text (U), where U is
text taken whatever its label, so it holds toxic texts at the class prior. The
risk of a classifier with margin z is
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` with the logistic loss:
the negative risk is estimated from U corrected by the prior, and where the
estimate goes below zero (overfitting) its gradient is reversed, as published
for non-negative PU learning.

A text's features are its distinct words (runs of letters, lower case) seen
through character n-grams with word borders, so that inflected or
compounded forms of a marker share features. A feature's value is the number
of distinct words of the text that hold it, so a word's contribution is the
same in every text and each task computes it once per word.

Bounds: training takes at most ``MOST_POSITIVE`` confirmed examples and
``MOST_UNLABELLED`` unlabelled texts (parameters of ``train``), drawn by a seeded
hash of the id, one text of each id, and keeps at most ``MOST_FEATURES`` features by their likelihood ratio between P
and U. Candidate features are counted in Spark; each of ``CLASSIFIERS``
numpy classifiers is trained in a task of its own on a resampled P and U, and
their weights are averaged. Scoring covers every whole text.

The class prior is a parameter; without it, the share of confirmed toxic among
the labelled, or, where only toxic ones are labelled, an estimate from P and U:
every n-gram is in U at least the prior times as often as in P, so the least
such ratio (with three standard errors) bounds the prior.

Defined cases: null or empty texts have no words and get the score of the
intercept. Without confirmed examples every score is the prior (0 without
labels). Repeated ids count once as examples; repeated rows are scored alike.
A null id is never held out and has no label. An empty table gives an empty
result. Language, source, id and labels are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import lean, materialise, release

MOST_POSITIVE = 4000
MOST_UNLABELLED = 8000
MOST_FEATURES = 20_000
LEAST_RATIO = 15.0
CLASSIFIERS = 3
STEPS = 300
SEED = 29
GRAM_SIZES = (3, 4, 5, 6)
CACHED_WORDS = 400_000
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def grams_of(word: str) -> set[str]:
    w = f"<{word}>"
    found = {w[i:i + n] for n in GRAM_SIZES for i in range(len(w) - n + 1)}
    found.add(w)
    return found


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


class GramFinder:
    """Finds the known n-grams of a word, each once, in one pass over it."""

    def __init__(self, values: dict[str, float]):
        self.automaton = ahocorasick.Automaton() if values else None
        for gram, v in values.items():
            self.automaton.add_word(gram, (len(gram), gram, v))
        if values:
            self.automaton.make_automaton()

    def of(self, word: str) -> dict[str, float]:
        if self.automaton is None:
            return {}
        w = f"<{word}>"
        # longer n-grams than the sizes are whole words; inside another word they don't count
        return {g: v for _, (n, g, v) in self.automaton.iter(w) if n <= GRAM_SIZES[-1] or n == len(w)}


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def finder(self) -> GramFinder:
        return GramFinder(self.weights)


def _examples(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int) -> DataFrame:
    """The bounded training sample, one text of each id: ``positive, text``."""
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    p = (labels.where(usable & (F.col("toxic") == 1)).select("doc_id").distinct()
         .orderBy(order, "doc_id").limit(most_positive).withColumn("positive", F.lit(1)))
    u = (docs.where(usable).select("doc_id").distinct()
         .orderBy(order, "doc_id").limit(most_unlabelled).withColumn("positive", F.lit(0)))
    chosen = F.broadcast(p.unionByName(u))  # at most most_positive + most_unlabelled ids
    found = docs.select("doc_id", "text").join(chosen, "doc_id")
    # rows of an id combine on the map side
    return found.groupBy("positive", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("positive", "text")


def _count_grams(sample: DataFrame) -> DataFrame:
    """``gram, p, u``: texts of P and of U that hold each n-gram. A task
    expands each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        of_word: dict[str, tuple[int, ...]] = {}
        counts = np.zeros((2, 1 << 16), dtype=np.int64)
        for b in batches:
            for positive, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held: set[int] = set()
                for w in words_of(text):
                    ids = of_word.get(w)
                    if ids is None:
                        ids = of_word[w] = tuple(place.setdefault(g, len(place)) for g in grams_of(w))
                    held.update(ids)
                while counts.shape[1] < len(place):
                    counts = np.concatenate([counts, np.zeros_like(counts)], axis=1)
                counts[1 - positive, np.fromiter(held, np.int64, len(held))] += 1
        grams = list(place)
        for i in range(0, len(grams), 50_000):
            g = grams[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), *[pa.array(counts[side, i:i + len(g)]) for side in (0, 1)]], names=["gram", "p", "u"])

    return sample.mapInArrow(lean(run), "gram string, p long, u long").groupBy("gram").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u"))


def _likelihood_ratio(p: Column, u: Column, n_p: int, n_u: int) -> Column:
    """Log-likelihood ratio of an n-gram being as common in P as in U."""
    both, share = p + u, F.lit(n_p / (n_p + n_u))

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    return 2 * (term(p, both * share) + term(u, both * (1 - share))
                + term(n_p - p, (n_p + n_u - both) * share) + term(n_u - u, (n_p + n_u - both) * (1 - share)))


def fit_nnpu(positive: np.ndarray, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n_features: int,
             prior: float, seed: int, steps: int = STEPS, decay: float = 1e-4) -> np.ndarray:
    """Weights and intercept (last) of one classifier; ``doc, feature, value``
    are the non-zero entries, ``positive`` marks P among the documents."""
    rng = np.random.default_rng(seed)
    draws = rng.poisson(1.0, len(positive)).astype(np.float64)  # a resampled P and U
    for side in (positive, ~positive):
        if not draws[side].sum():
            draws[side] = 1.0
    in_p = np.where(positive, draws, 0.0) / draws[positive].sum()
    in_u = np.where(positive, 0.0, draws) / draws[~positive].sum()
    w = np.zeros(n_features + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(doc, weights=w[feature] * value, minlength=len(positive)) + w[-1], -30, 30)
        up, down = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)  # gradient of the loss at -1, loss at -1
        negative = in_u @ down - prior * (in_p @ down)
        g_negative = (in_u - prior * in_p) * up
        g = -g_negative if negative < 0 else g_negative - prior * in_p * (1 - up)
        grad = np.append(np.bincount(feature, weights=g[doc] * value, minlength=n_features), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _prior_bound(counted: DataFrame, n_p: int, n_u: int) -> float:
    """The least ratio of an n-gram's share in U to its share in P, over n-grams
    that a tenth of P holds."""
    u = F.col("u") + 3 * F.sqrt(F.col("u")) + 3
    ratio = (u / n_u) / (F.col("p") / n_p)
    return counted.where(F.col("p") >= max(5, n_p / 10)).agg(F.min(ratio)).first()[0] or 0.5


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE,
          most_unlabelled: int = MOST_UNLABELLED) -> Model:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    seen = known.agg(F.avg(F.col("toxic").cast("double")).alias("share"), F.min("toxic").alias("least")).first()
    if not seen["share"]:
        return Model({}, -30.0)
    guess = prior is None and seen["least"] == 1  # only toxic ones are labelled
    prior = min(max(seen["share"] if prior is None else prior, 0.001), 0.9)
    sample = materialise(_examples(docs, labels, most_positive, most_unlabelled), "toxic-sample")
    spread = sample.repartition(24)
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model({}, math.log(prior / (1 - prior)))
    counted = _count_grams(spread).where("p + u >= 5")
    if guess:
        counted = materialise(counted, "toxic-grams")
        prior = min(max(_prior_bound(counted, n_p, n_u), 0.001), 0.5)
    best = (counted.withColumn("ratio", _likelihood_ratio(F.col("p"), F.col("u"), n_p, n_u))
            .where(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc("ratio"), "gram").limit(MOST_FEATURES).select("gram").collect())
    place = {r["gram"]: i for i, r in enumerate(best)}
    if not place:
        return Model({}, math.log(prior / (1 - prior)))
    n_features = len(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = GramFinder(place)
        for b in batches:
            found, digests = [], []
            for positive, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = sorted(Counter(i for w in words_of(text) for i in finder.of(w).values()).items())
                found.append(([f for f, _ in c], [v for _, v in c]))
                digests.append(xxhash.xxh64_intdigest(repr((positive, c))) >> 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f for f, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.int32())), pa.array(digests, pa.int64())],
                names=["positive", "feature", "value", "digest"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("digest", "ascending")])  # whatever order the rows came in
        feature = [np.array(x, np.int64) for x in table["feature"].to_pylist()]
        value = [np.array(x, np.float64) for x in table["value"].to_pylist()]
        doc = np.repeat(np.arange(len(feature)), [len(f) for f in feature])
        seed = table["seed"][0].as_py()
        w = fit_nnpu(table["positive"].to_numpy() == 1, doc, np.concatenate(feature), np.concatenate(value),
                     n_features, prior, seed)
        del feature, value, doc
        release()
        return pa.table({"seed": pa.array([seed], pa.int32()), "weights": pa.array([w], pa.list_(pa.float64()))})

    encoded = spread.mapInArrow(lean(encode), "positive int, feature array<int>, value array<int>, digest long")
    copies = encoded.withColumn("seed", F.explode(F.array(*[F.lit(SEED + k) for k in range(CLASSIFIERS)])))
    fitted = copies.groupBy("seed").applyInArrow(fit, "seed int, weights array<double>").collect()
    w = np.mean([r["weights"] for r in sorted(fitted, key=lambda r: r["seed"])], axis=0)
    return Model({g: float(w[i]) for g, i in place.items()}, float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of each whole text. The model is bounded
    by ``MOST_FEATURES`` and goes to every task with the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        finder = model.finder()
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(b.num_columns - 1)):
                z = model.intercept
                for w in words_of(text.as_py()):
                    s = known.get(w)
                    if s is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        s = known[w] = sum(finder.of(w).values())
                    z += s
                out[i] = 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(run), f"{fields}, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below ``threshold``, with their own
    columns: each row is filtered by its own score, no join."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_toxic_text"))
    scored = score(packed, train(docs, labels), text_col="_toxic_text", keep=("_doc",))
    return scored.where(F.col("score") < threshold).select("_doc.*")
