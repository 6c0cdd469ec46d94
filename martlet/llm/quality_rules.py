"""Quality rules with adaptive thresholds.

Each document gets counts (words, characters in words, symbols, duplicate
lines, words in repeated 3-word windows). Fixed base rules fail the obvious
cases. For the rest, per-mille ratios of the counts are judged by fences that
are learnt from the data: for each (language, source) a mergeable quantile
sketch of every ratio gives its quartiles, and the fence is
``upper quartile + reach * max(upper - lower quartile, least spread)``.

The sketch is a histogram over integer buckets: values below 64 have a bucket
each, larger ones keep their top six bits, so a quantile is exact to one part
in 32 and sketches merge by adding counts. A (language, source) group with
fewer than ``least_docs`` documents merges up: it uses its language's sketch,
and that, if still too small, the sketch of all documents. Thresholds are one
row per group and are joined back to the counts (never to the texts).

Scale: one scan of the texts gives the counts, which are written once; the
sketches are sums per (language, source, ratio, bucket), combined on the map
side, so a source with a third of all rows costs a few hundred partial rows
per task.

Defined cases: null text is an empty text; both fail the base rule (fewer
than 50 words). Null language or source is a group of its own. Repeated rows
are judged alike, each by itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm import textkit
from martlet.llm.common import materialise
from martlet.plans.joins import broadcast_if_bounded

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
REACH = 3
LEAST_DOCS = 200
#: Per-mille ratios that are judged, and the least spread of each.
LEAST_SPREAD = {"symbols": 60, "dup_lines": 200, "repeats": 200, "shouting": 150}
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BATCH_BYTES = 1 << 20

_COUNT_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                 "n_repeat_words long, n_lines long, n_upper long, n_letters long")
_COUNT_FIELDS = [f.split()[0] for f in _COUNT_SCHEMA.split(",")]
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, dtype=bool)
_IS_LOWER[97:123] = True


def _repeated_words(hashes: np.ndarray, words_before: np.ndarray) -> np.ndarray:
    """Per text: words inside 3-word windows that occur twice or more in it."""
    n_texts = len(words_before) - 1
    n = len(hashes)
    if n < 3:
        return np.zeros(n_texts, dtype=np.int64)
    text_of = np.repeat(np.arange(n_texts), np.diff(words_before))
    windows = textkit.window_hashes(hashes, 3)
    valid = np.flatnonzero(text_of[:-2] == text_of[2:])
    key = textkit.mix64(windows[valid] + textkit.mix64(text_of[valid].astype(np.uint64)))
    codes, uniques = pd.factorize(key)
    twice = valid[np.bincount(codes, minlength=len(uniques))[codes] > 1]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return textkit.sums_by_text(covered, words_before)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line; lines with a word."""
    n_texts, n = len(offsets) - 1, len(data)
    is_end = np.zeros(n + 1, dtype=bool)
    is_end[:n] = data == 10
    breaks = np.flatnonzero(is_end)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < n]
    ends = np.minimum(np.append(starts[1:], n), n)
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if n else ends
    has_word = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[has_word], ends[has_word]
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    h = textkit.span_hashes(data, starts, ends)
    key = textkit.mix64(h + textkit.mix64(text_of.astype(np.uint64)))
    later = pd.Series(key).duplicated().to_numpy()
    return (np.bincount(text_of[later], minlength=n_texts).astype(np.int64),
            np.bincount(text_of, minlength=n_texts).astype(np.int64))


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``_COUNT_FIELDS`` for each text."""
    parts: list[list[np.ndarray]] = []
    for _, data, off in textkit.utf8_batches(texts, BATCH_BYTES):
        starts, ends, before = textkit.word_spans(data, off)
        cont = (data & 0xC0) != 0x80
        word_byte = ~textkit._IS_SPACE[data]
        dup, lines = _duplicate_lines(data, off, starts)
        parts.append([
            np.diff(before), textkit.sums_by_text(cont & word_byte, off), textkit.sums_by_text(_IS_SYMBOL[data], off),
            dup, _repeated_words(textkit.span_hashes(data, starts, ends), before), lines,
            textkit.sums_by_text(_IS_UPPER[data], off),
            textkit.sums_by_text(_IS_UPPER[data] | _IS_LOWER[data], off)])
    return {f: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
            for i, f in enumerate(_COUNT_FIELDS)}


def with_counts(docs: DataFrame, text_col: str = "text", keep=("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and the counts of each text."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_texts(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array(v.astype(np.int64)) for v in counts.values()]],
                names=[*b.schema.names[:-1], *counts])

    return rows.mapInArrow(run, f"{fields}, {_COUNT_SCHEMA}")


def _per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN (1000 * {part}) div {whole} ELSE 0 END").cast("bigint")


def _ratios() -> dict[str, Column]:
    return {"symbols": _per_mille("n_symbols", "n_words"), "dup_lines": _per_mille("n_dup_lines", "n_lines"),
            "repeats": _per_mille("n_repeat_words", "n_words"), "shouting": _per_mille("n_upper", "n_letters")}


def bucket_floor(v: Column) -> Column:
    """Least value of the sketch bucket of a non-negative integer: values below
    64 stay, others keep their six highest bits."""
    bits = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(
        F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits)).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches: ``lang, source, ratio, bucket, n`` of the documents
    that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket_floor(v).alias("bucket"))
                                for k, v in _ratios().items()]))
    return (counts.where("NOT base_failed").select("lang", "source", pairs.alias("p"))
            .groupBy("lang", "source", F.col("p.ratio").alias("ratio"), F.col("p.bucket").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def _quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """``lo`` and ``hi``: the first bucket at which a quarter, or three
    quarters, of the group's documents are reached. The running sum needs the
    buckets of one group and ratio only, a few hundred rows."""
    keys = [*group, "ratio"]
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    buckets = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    whole = merged.groupBy(*keys).agg(buckets.alias("b"), F.sum("n").alias("docs"))

    def at(quarters: int) -> Column:
        reached = F.expr(
            "aggregate(b, named_struct('s', 0L, 'at', cast(null as bigint)), (a, x) -> named_struct("
            f"'s', a.s + x.n, 'at', coalesce(a.at, if(4 * (a.s + x.n) >= {quarters} * docs, x.bucket, null)))).at")
        return reached

    return whole.select(*keys, "docs", at(1).alias("lo"), at(3).alias("hi"))


def thresholds(sketch: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS,
               least_spread: dict[str, int] | None = None) -> DataFrame:
    """One row per (lang, source) with a fence per ratio."""
    spread = least_spread or LEAST_SPREAD
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("l"), F.col("ratio").alias("r"), F.col("docs").alias("ld"),
        F.col("lo").alias("llo"), F.col("hi").alias("lhi"))
    overall = _quartiles(sketch, []).select(
        F.col("ratio").alias("ar"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    j = (own.join(by_lang, own["lang"].eqNullSafe(by_lang["l"]) & (own["ratio"] == by_lang["r"]))
         .join(F.broadcast(overall), F.col("ratio") == F.col("ar")))  # one row per ratio

    def pick(a: str, b: str, c: str) -> Column:
        return (F.when(F.col("docs") >= least_docs, F.col(a)).when(F.col("ld") >= least_docs, F.col(b))
                .otherwise(F.col(c)))

    lo, hi = pick("lo", "llo", "alo"), pick("hi", "lhi", "ahi")
    least = F.element_at(F.create_map(*[F.lit(x) for kv in spread.items() for x in kv]), F.col("ratio"))
    fence = hi + F.lit(reach) * F.greatest(hi - lo, least)
    return j.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("ratio") == k, fence)).alias(f"most_{k}") for k in spread])


def judge(docs: DataFrame, reach: int = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per document: the counts, the ratios, the group's fences, ``base_failed``
    and ``kept``."""
    failed = ((F.col("n_words") < LEAST_WORDS)
              | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    counts = materialise(with_counts(docs).withColumn("base_failed", failed), "counts")
    fences = materialise(thresholds(sketches(counts), reach, least_docs), "fences")
    fences = broadcast_if_bounded(fences.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    rows = counts.join(fences, counts["lang"].eqNullSafe(fences["_lang"])
                       & counts["source"].eqNullSafe(fences["_source"]), "left")
    within = F.lit(True)
    for k, v in _ratios().items():
        rows = rows.withColumn(f"pm_{k}", v)
        within = within & (F.col(f"pm_{k}") <= F.col(f"most_{k}"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    return rows.withColumn("kept", kept).drop("_lang", "_source")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns, by a joined
    filter on the rejected ids; rows with a null id can't be joined and stay."""
    gone = judge(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    gone = broadcast_if_bounded(materialise(gone, "gone"))  # else the texts would move
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


JUDGE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts),
w AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM split),
win AS (SELECT rid, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM win WHERE w3 IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY rid),
counts AS (
  SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::BIGINT AS n_letters
  FROM split LEFT JOIN covered USING (rid)),
ratios AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN (1000 * n_symbols) // n_words ELSE 0 END AS pm_symbols,
         CASE WHEN n_lines > 0 THEN (1000 * n_dup_lines) // n_lines ELSE 0 END AS pm_dup_lines,
         CASE WHEN n_words > 0 THEN (1000 * n_repeat_words) // n_words ELSE 0 END AS pm_repeats,
         CASE WHEN n_letters > 0 THEN (1000 * n_upper) // n_letters ELSE 0 END AS pm_shouting FROM counts),
pairs AS (
  SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'shouting']) AS ratio,
         unnest([pm_symbols, pm_dup_lines, pm_repeats, pm_shouting]) AS v FROM ratios WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, ratio, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket,
         count(*) AS n FROM pairs GROUP BY ALL),
own_run AS (
  SELECT lang, source, ratio, bucket, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS s,
         sum(n) OVER (PARTITION BY lang, source, ratio) AS docs FROM sketch),
own AS (
  SELECT lang, source, ratio, any_value(docs) AS docs, min(bucket) FILTER (4 * s >= docs) AS lo,
         min(bucket) FILTER (4 * s >= 3 * docs) AS hi FROM own_run GROUP BY ALL),
lang_sketch AS (SELECT lang, ratio, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
lang_run AS (
  SELECT lang, ratio, bucket, sum(n) OVER (PARTITION BY lang, ratio ORDER BY bucket) AS s,
         sum(n) OVER (PARTITION BY lang, ratio) AS docs FROM lang_sketch),
by_lang AS (
  SELECT lang, ratio, any_value(docs) AS docs, min(bucket) FILTER (4 * s >= docs) AS lo,
         min(bucket) FILTER (4 * s >= 3 * docs) AS hi FROM lang_run GROUP BY ALL),
all_sketch AS (SELECT ratio, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
all_run AS (
  SELECT ratio, bucket, sum(n) OVER (PARTITION BY ratio ORDER BY bucket) AS s, sum(n) OVER (PARTITION BY ratio) AS docs
  FROM all_sketch),
overall AS (
  SELECT ratio, min(bucket) FILTER (4 * s >= docs) AS lo, min(bucket) FILTER (4 * s >= 3 * docs) AS hi
  FROM all_run GROUP BY ALL),
picked AS (
  SELECT o.lang, o.source, o.ratio,
         CASE WHEN o.docs >= 200 THEN o.lo WHEN b.docs >= 200 THEN b.lo ELSE a.lo END AS lo,
         CASE WHEN o.docs >= 200 THEN o.hi WHEN b.docs >= 200 THEN b.hi ELSE a.hi END AS hi,
         CASE o.ratio WHEN 'symbols' THEN 60 WHEN 'dup_lines' THEN 200 WHEN 'repeats' THEN 200 ELSE 150 END AS least
  FROM own o JOIN by_lang b ON o.lang IS NOT DISTINCT FROM b.lang AND o.ratio = b.ratio JOIN overall a ON o.ratio = a.ratio),
fences AS (
  SELECT lang, source, max(hi + 3 * greatest(hi - lo, least)) FILTER (ratio = 'symbols') AS most_symbols,
         max(hi + 3 * greatest(hi - lo, least)) FILTER (ratio = 'dup_lines') AS most_dup_lines,
         max(hi + 3 * greatest(hi - lo, least)) FILTER (ratio = 'repeats') AS most_repeats,
         max(hi + 3 * greatest(hi - lo, least)) FILTER (ratio = 'shouting') AS most_shouting
  FROM picked GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(pm_symbols <= most_symbols AND pm_dup_lines <= most_dup_lines
         AND pm_repeats <= most_repeats AND pm_shouting <= most_shouting, true) AS kept,
       pm_symbols, pm_dup_lines, pm_repeats, pm_shouting
FROM ratios r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
