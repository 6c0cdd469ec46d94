"""Importance resampling towards a target distribution: documents are drawn
without replacement with odds that follow how much likelier their n-grams are
in the target texts than in the corpus.

1. Features are runs of 1 to ``runs`` consecutive words; a feature's bucket is
   its CRC-32 modulo ``buckets``. Corpus and target are counted per bucket in
   one scan each: a task adds up one array and sends its non-zero entries.
2. The gains of all buckets are one array of ``buckets`` whole numbers (the only
   thing that goes through the driver; its size is a parameter), and a second
   scan scores each text by it: its weight is the mean gain of its features.
3. Weight plus a seeded Gumbel draw is the score; the best ``share`` of the
   documents long enough are the sample. Their order is a distributed radix sort
   over score and id (``radix_sort``), whose final ranks decide who is drawn.

Scale: texts never move; a hot source, text or word is no key of any shuffle but
a bucket's count, of which each task sends one. What is sorted is five numbers a
document.

Defined cases: a null text counts as empty; without features the weight is 0;
target texts that are null or empty add nothing; a null id draws as the empty
string and comes after other ids; equal scores go to the smaller id, then to
fewer features; repeated rows have the same score and consecutive ranks; an
empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm import textkit
from martlet.llm.common import materialise
from martlet.llm.radix_sort import ranked

RUNS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
BATCH_BYTES = 256 << 10

#: A word holds digits, letters and bytes of characters beyond ASCII; only A-Z are lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[48:58] = _OUTSIDE[97:123] = _OUTSIDE[128:] = False


def feature_buckets(data: np.ndarray, offsets: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: the bucket of every feature, the number of features
    before each text, and the number of words before each text."""
    data = _LOWER[data]
    starts, ends, words = textkit.word_spans(data, offsets, _OUTSIDE)
    if runs == 1:
        return textkit.crc32_spans(data, starts, ends) % np.uint32(buckets), words, words
    # words with one space after each; a run of words is then one span
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[np.repeat(at[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = data[
        np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    found, of_text = [], []
    for k in range(1, runs + 1):
        n = max(0, len(starts) - k + 1)
        same = text[:n] == text[len(text) - n:]
        first, last = at[:n][same], (at[:-1] + lengths)[len(text) - n:][same]
        found.append(textkit.crc32_spans(joined, first, last))
        of_text.append(text[:n][same])
    every, of_text = np.concatenate(found), np.concatenate(of_text)
    order = np.argsort(of_text, kind="stable")
    before = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(offsets) - 1))])
    return every[order] % np.uint32(buckets), before, words


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """``bucket, n`` of all features of ``texts`` (buckets without any left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, off in textkit.utf8_batches(b.column(0), BATCH_BYTES):
                total += np.bincount(feature_buckets(data, off, runs, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return texts.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS,
                 text_col: str = "text") -> np.ndarray:
    """The gain of every bucket, in thousandths of natural logarithms, with one
    added to each count; at most ``buckets`` rows of each side are collected."""
    sides = []
    for texts in (docs, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, runs, buckets, text_col).collect():
            counts[r["bucket"]] = r["n"]
        sides.append(counts.tolist())
    s, t = sides
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((y + 1.0) * all_s) / ((x + 1.0) * all_t))) for x, y in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, runs: int = RUNS, keep: tuple[str, ...] = ("doc_id",),
          text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_features`` and ``weight`` of each document."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data, off in textkit.utf8_batches(b.column(b.num_columns - 1), BATCH_BYTES):
                found, before, words = feature_buckets(data, off, runs, buckets)
                n = np.diff(before)
                weight = np.where(n > 0, textkit.sums_by_text(gains[found], before) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(i, len(n)) for c in b.columns[:-1]], pa.array(np.diff(words), pa.int64()),
                     pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                    names=[*keep, "n_words", "n_features", "weight"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(
        run, f"{fields}, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int):
    """A seeded Gumbel draw in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """Per document: ``doc_id, n_features, weight, score, rank`` (1, 2, ... of
    the documents drawn, else null)."""
    gains = bucket_gains(docs, target, runs, buckets)
    weighed = weigh(docs, gains, runs)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialise(scored.withColumn("worse", -F.col("score")), "scored")
    long_enough = F.col("n_words") >= least_words
    n_drawn = F.lit(scored.where(long_enough).count() * percent // 100)
    order = ranked(scored.where(long_enough), ["worse", "doc_id", "n_features"], "place")
    rows = order.withColumn("rank", F.when(F.col("place") < n_drawn, F.col("place") + 1)).drop("place")
    rows = rows.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``rank`` and ``doc_id`` of the sample, best first."""
    return resample(docs, target, **options).where("rank IS NOT NULL").select("rank", "doc_id")


RESAMPLE_SQL = """
WITH """ + textkit.CRC_SQL.strip() + """,
texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, coalesce(text, '') FROM benchmark),
word_lists AS (
  SELECT side, doc_id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
words AS (SELECT side, r, unnest(words) AS word FROM word_lists),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(octet_length(encode(word))),
             lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc_table),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE)
                              / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
sums AS (
  SELECT r, sum(gain)::BIGINT AS total FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
weighed AS (
  SELECT doc_id, len(words)::BIGINT AS n_features,
         CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM word_lists LEFT JOIN sums USING (r) WHERE side = 'd'),
scored AS (
  SELECT doc_id, n_features, weight,
         weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
           PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place,
         (SELECT count(*) FROM scored WHERE n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""
