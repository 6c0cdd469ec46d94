"""Quality classifier: an interpolated modified Kneser-Ney model of character
n-grams, trained on trusted documents.

An n-gram is a whole number of 12 bits per character, so its context and its
suffix are a shift and a mask. Code points 3 to 3839 stand for themselves; the
others share 256 classes; 1 and 2 mark a text's beginning and end.

1. Each chunk of documents lists its distinct n-grams with their number in
   the chunk's trusted documents (one pass over all texts).
2. Counts are summed per n-gram over all chunks; order by order, the
   continuation counts, the discounts D1, D2, D3+ (from the counts of counts)
   and the context totals follow by aggregations and joins on the n-gram,
   sharded by Spark, from the shortest order up.
3. The log-probabilities join back to each chunk's n-grams, and each chunk's
   documents, compressed, meet them (a cogroup on the chunk): every position
   takes its value, and a document's sum gives its perplexity.

Limits are taken from trusted documents that did not train the model: about
one text in ``HELD_OUT``, chosen by its hash (copies together), stays out of
the counts. A score is the mean negative log-probability per character, drawn
towards the language's median as if the text had ``PRIOR_CHARS`` more
characters of that median, so that a few odd words don't reject a short text.
A document is rejected if its score is above its language's limit: the
``QUANTILE`` of the held-out documents' scores plus ``MARGIN`` times the
median. A language with fewer than ``LEAST_TRUSTED`` held-out documents has the
median of all its own documents, trusted or not, and takes the quantile of all
held-out documents' scores relative to their language's median: the model may
know it badly, so its level is always its own.

Scale: what is gathered (n-grams of every chunk) follows the input; an n-gram
travels once per chunk however frequent it is. No table of the model is
collected or broadcast; the driver sees the counts of counts (20 numbers).

Defined cases: a null text counts as empty; an empty text has only the end
mark to score; null language is a group of its own. Without any trusted
document every probability is uniform, and without any held-out one there is
no limit: all documents are kept.
Repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import materialise, release, repeatable
from martlet.llm.wordtable import PACKED_SCHEMA, chunks, pack_documents
from martlet.plans.joins import broadcast_if_bounded

ORDER = 4
BITS = 12
PRIOR_CHARS = 150
QUANTILE = 0.99
MARGIN = 0.05
LEAST_TRUSTED = 50
HELD_OUT = 4
BATCH_CHARS = 512 << 10
CHUNK_CHARS = 16 << 20


def gram_keys(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys of all texts (each text's characters and its end mark), and
    the number of keys before each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    pad = order - 1
    points = np.frombuffer(("\x01" * pad).join(["", *[t + "\x02" for t in texts]]).encode("utf-32-le"), "<u4")
    code = np.where(points < 3840, np.maximum(points, 3), 3840 + (points & 255)).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1 + pad)])
    for k in range(pad):
        code[begins[:-1] + k] = 1
    code[begins[1:] - 1] = 2
    key = code.copy()
    for k in range(1, order):
        key[k:] |= code[:-k] << (BITS * k)
    real = np.ones(len(code), dtype=bool)
    for k in range(pad):
        real[begins[:-1] + k] = False
    return key[real], np.concatenate([[0], np.cumsum(lengths + 1)])


def _text_runs(table: pa.Table) -> Iterator[tuple[int, int, list[str]]]:
    texts = pc.fill_null(table.column(table.num_columns - 1), "").to_pylist()
    total = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_CHARS, side="right")) - 1)
        yield i, j, texts[i:j]
        i = j


def list_grams(docs: DataFrame, order: int) -> DataFrame:
    """``chunk, gram, n``: the distinct n-grams of each chunk of
    ``docs(..., trusted, text)`` and their number in its documents with 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches, CHUNK_CHARS):
            trusted = table["trusted"].to_numpy() == 1
            keys, counts = [], []
            for i, j, texts in _text_runs(table):
                key, before = gram_keys(texts, order)
                codes, uniques = pd.factorize(key)
                keys.append(uniques)
                weight = np.repeat(trusted[i:j], np.diff(before))
                counts.append(np.bincount(codes[weight], minlength=len(uniques)))
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
            for a in range(0, len(key), 100_000):
                k = key[a:a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), chunk)), pa.array(k), pa.array(n[a:a + 100_000])],
                    names=["chunk", "gram", "n"])
            release()

    return docs.mapInArrow(run, "chunk long, gram long, n long")


def _discounts(levels: dict[int, DataFrame]) -> dict[int, tuple[float, float, float]]:
    """D1, D2, D3+ of each order from its counts of counts."""
    rows = None
    for k, level in levels.items():
        one = level.agg(F.lit(k).alias("k"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        rows = one if rows is None else rows.unionByName(one)
    out = {}
    for r in rows.collect():
        n1, n2, n3, n4 = r["n1"], r["n2"], r["n3"], r["n4"]
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
        d2 = 2 - 3 * y * n3 / n2 if n2 else 1.0
        d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
        # counts of counts that aren't falling (tiny or degenerate text) can leave the valid range
        out[r["k"]] = (min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95))
    return out


def probabilities(types: DataFrame, order: int) -> DataFrame:
    """``gram, logp`` of every n-gram of ``types(gram, c)``, where ``c`` is
    its count in trusted text (0 if it only occurs elsewhere)."""
    levels = {order: types}
    for k in range(order - 1, 0, -1):
        mask = F.lit((1 << (BITS * k)) - 1)
        levels[k] = materialise(
            levels[k + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram"))
            .agg(F.count_if(F.col("c") > 0).alias("c")), f"order{k}")
    discounts = _discounts(levels)
    lower = None
    for k in range(1, order + 1):
        d1, d2, d3 = discounts[k]
        c = F.col("c")
        cut = F.when(c == 0, 0.0).when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        rows = levels[k].withColumn("context", F.shiftright("gram", BITS)).withColumn("cut", cut)
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("held"))
        rows = rows.join(contexts, "context")
        if k == 1:
            rest: Column = F.lit(1.0 / (1 << BITS))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1)))
            rows = rows.join(lower, "suffix")
            rest = F.col("p_lower")
        p = F.when(F.col("total") > 0,
                   (c - F.col("cut")) / F.col("total") + F.col("held") / F.col("total") * rest).otherwise(rest)
        lower = rows.select(F.col("gram").alias("suffix"), p.alias("p_lower"))
    return lower.select(F.col("suffix").alias("gram"), F.log("p_lower").cast("float").alias("logp"))


def score(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER,
          keep: tuple[str, ...] = ("doc_id", "lang"), text_col: str = "text", held_out: int | None = None) -> DataFrame:
    """``keep`` columns, ``trusted``, ``n_chars``, ``log_prob`` and
    ``perplexity`` of each document. ``trusted_ids(doc_id)``: the documents
    that train the model; with ``held_out`` about one text in so many of them
    has ``trusted = 2`` and doesn't train."""
    ids = trusted_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    ids = broadcast_if_bounded(materialise(ids, "trusted"))
    marked = docs.select(*keep, F.col("doc_id").alias("_doc"), F.col(text_col).alias("_text"))
    held = F.lit(False) if held_out is None else F.pmod(F.xxhash64(F.coalesce("_text", F.lit("")), F.lit(17)), F.lit(held_out)) == 0
    trusted = F.when(F.col("_id").isNull(), 0).when(held, 2).otherwise(1)
    marked = marked.join(ids, F.col("_doc") == F.col("_id"), "left").select(*keep, trusted.alias("trusted"), "_text")
    marked = repeatable(marked)

    grams = materialise(list_grams(marked, order), "grams")
    types = materialise(grams.groupBy("gram").agg(F.sum("n").alias("c")), "types")
    model = materialise(probabilities(types, order), "model")
    values = grams.select("chunk", "gram").join(model, "gram")

    def meet(documents: pa.Table, known: pa.Table) -> pa.Table:
        gram, at = np.unique(known["gram"].to_numpy(), return_index=True)
        logp = known["logp"].to_numpy()[at].astype(np.float64)
        out = []
        for blob in documents["documents"].to_pylist():
            table = pa.ipc.open_stream(blob).read_all()
            sums, sizes = [], []
            for _, _, texts in _text_runs(table):
                key, before = gram_keys(texts, order)
                codes, uniques = pd.factorize(key)
                place = np.searchsorted(gram, uniques)
                if not np.array_equal(gram[np.minimum(place, len(gram) - 1)], uniques):
                    raise RuntimeError("a chunk holds n-grams that were not listed: its input changed")
                total = np.concatenate([[0.0], np.cumsum(logp[place][codes])])
                sums.append(np.diff(total[before]))
                sizes.append(np.diff(before))
            rows = table.drop_columns(["_text"])
            rows = rows.append_column("n_chars", pa.array(np.concatenate(sizes).astype(np.int64)))
            out.append(rows.append_column("log_prob", pa.array(np.concatenate(sums))))
        release()
        return pa.concat_tables(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    packed = marked.mapInArrow(lambda batches: pack_documents(batches, CHUNK_CHARS), PACKED_SCHEMA)
    scored = packed.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(
        meet, f"{fields}, trusted int, n_chars long, log_prob double")
    return scored.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_chars")))


def judge(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE,
          margin: float = MARGIN, prior_chars: int = PRIOR_CHARS) -> DataFrame:
    """Per document: ``doc_id, lang, trusted, held_out, n_chars, log_prob,
    perplexity, score, limit, kept``."""
    return _judged(docs, trusted_ids, ("doc_id", "lang"), order, quantile, margin, prior_chars)


def _judged(docs: DataFrame, trusted_ids: DataFrame, keep: tuple[str, ...], order: int = ORDER,
            quantile: float = QUANTILE, margin: float = MARGIN, prior_chars: int = PRIOR_CHARS) -> DataFrame:
    scored = materialise(score(docs, trusted_ids, order, keep, held_out=HELD_OUT), "scored")
    held = F.col("trusted") == 2

    def quantile_of(measure: Column, q: float) -> Column:
        return F.percentile_approx(measure, q, 10_000)

    rate = -F.col("log_prob") / F.col("n_chars")
    medians = scored.groupBy(F.col("lang").alias("_lang")).agg(
        F.count_if(held).alias("n_held"), quantile_of(F.when(held, rate), 0.5).alias("held_median"),
        quantile_of(rate, 0.5).alias("any_median"))
    enough = F.col("n_held") >= LEAST_TRUSTED
    medians = medians.select("_lang", enough.alias("enough"),
                             F.when(enough, F.col("held_median")).otherwise(F.col("any_median")).alias("median"))
    medians = broadcast_if_bounded(materialise(medians, "medians"))
    rows = scored.join(medians, scored["lang"].eqNullSafe(medians["_lang"])).drop("_lang")
    rows = rows.withColumn("score", (F.lit(prior_chars) * F.col("median") - F.col("log_prob"))
                           / (F.col("n_chars") + F.lit(prior_chars)))
    every = rows.agg(quantile_of(F.when(held, F.try_divide("score", "median")), quantile)).first()[0]
    tops = rows.groupBy(F.col("lang").alias("_lang")).agg(
        quantile_of(F.when(held, F.col("score")), quantile).alias("top"))
    tops = broadcast_if_bounded(materialise(tops, "limits"))
    rows = rows.join(tops, rows["lang"].eqNullSafe(tops["_lang"])).drop("_lang")
    top = F.when(F.col("enough"), F.col("top")).otherwise(F.lit(every).cast("double") * F.col("median"))
    kept = F.coalesce(F.col("score") <= F.col("limit"), F.lit(True))
    return rows.withColumn("limit", top + F.lit(margin) * F.col("median")).select(
        *keep, F.least("trusted", F.lit(1)).alias("trusted"), held.alias("held_out"), "n_chars", "log_prob",
        "perplexity", "score", "limit", kept.alias("kept"))


def kept_documents(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns. A document
    is known by its id, language and text together, nulls included."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    judged = _judged(docs.select("doc_id", "lang", "text", key.alias("_key")), trusted_ids, ("doc_id", "lang", "_key"), **options)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.col("lang").alias("_gone_lang"), "_key").distinct()
    gone = broadcast_if_bounded(materialise(gone, "gone"))  # else the texts would move
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & docs["lang"].eqNullSafe(gone["_gone_lang"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_key"])
    return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
