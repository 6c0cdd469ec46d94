"""Spelling variants: distinct words one edit apart, and the much more frequent
word that a rare one is a variant of.

1. Words are runs of letters (``A-Z a-z`` and U+00C0 to U+00FF), A-Z lower-cased.
   With ``corrupt`` some occurrences lose a letter first, picked by the CRC-32
   of document and word, which plants typing errors. Tasks count words in a
   table that they empty when it is full; Spark sums the counts.
2. One edit (a letter inserted, deleted or replaced) leaves either the first
   half or the rest of the shorter word as it was, so near words share a half:
   words of two adjacent lengths meet under each of their halves. A half that
   very many words share is dealt to chunks by the words' hash, and each pair of
   chunks is compared in a cell of its own.
3. In a cell words are rows of letter counts. Their Gram matrix, a NumPy product
   block by block, gives all squared distances ``|x|^2 + |y|^2 - 2xy``: an edit
   changes one count by one or two counts by one each, so only pairs at a squared
   distance of 1 or 2 are looked at letter by letter.
4. Near words are counted, the most frequent one is the word's form if it has
   at least ``RATIO`` times its occurrences, and forms are followed to the last
   by pointer doubling (counts grow ``RATIO`` times a step, so in few rounds).

Scale: texts never move; a word is sent once per task and emptied table however
frequent it is. A word goes to at most four halves. A cell has at most about
``2 * CHUNK_LETTERS`` letters of words; ``n`` words with the same half are compared
in ``(n / chunk) ** 2 / 2`` cells, nothing else grows faster than the words. Near
pairs are few: a word of ``k`` letters has at most about ``180 * k`` near words,
however many words there are. Only the small table of halves that need several
chunks is broadcast, within a proven size.

Defined cases: null or empty texts have no words; a null id counts as the empty
string in the corruption; equally frequent near words: the first in code-point
order is the form; repeated rows count each; words of any length are whole; an
empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import zlib
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

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
CORRUPT = 199
BATCH_CHARS = 512 << 10
TABLE_WORDS = 200_000
CHUNK_LETTERS = 8 << 10
GRAM_ROWS = 512

#: Letters are A-Z, a-z and the code points C0 to FF, which have one byte each in Latin-1.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[65:91] = _OUTSIDE[97:123] = _OUTSIDE[0xC0:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Place of each lower-cased letter among the counts.
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:] = np.arange(26, 90)


def count_in_batch(texts: list[str], ids: list[str], corrupt: int | None, least: int) -> dict[str, int]:
    """Occurrences of each word of at least ``least`` letters."""
    data = _LOWER[np.frombuffer("\n".join(texts).encode("latin-1", "replace"), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    offsets[-1] = len(data)
    starts, ends, before = textkit.word_spans(data, offsets, _OUTSIDE)
    found: dict[str, int] = {}
    if corrupt:
        # UTF-8 of the words: letters from C0 on are the byte C3 and their lower 6 bits with the upper bit set
        wide = data >= 0xC0
        shift = np.concatenate([[0], np.cumsum(wide)])
        utf8 = np.empty(len(data) + int(shift[-1]), np.uint8)
        at = np.arange(len(data)) + shift[1:]
        utf8[at] = np.where(wide, data & 0xBF, data)
        utf8[(at - 1)[wide]] = 0xC3
        prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        crc = textkit.crc32_spans(utf8, starts + shift[starts], ends + shift[ends], np.repeat(prefix, np.diff(before)))
        hit = crc % np.uint32(corrupt) == 0
        for h, a, b in zip(crc[hit].tolist(), starts[hit].tolist(), ends[hit].tolist()):
            cut = a + h % (b - a)
            word = (data[a:cut].tobytes() + data[cut + 1:b].tobytes()).decode("latin-1")
            if len(word) >= least:
                found[word] = found.get(word, 0) + 1
        starts, ends = starts[~hit], ends[~hit]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    codes, uniques = pd.factorize(textkit.span_hashes(data, starts, ends))
    first = np.zeros(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = data.tobytes()
    for n, a, b in zip(np.bincount(codes, minlength=len(uniques)).tolist(), starts[first].tolist(), ends[first].tolist()):
        word = raw[a:b].decode("latin-1")
        found[word] = found.get(word, 0) + n
    return found


def count_words(docs: DataFrame, corrupt: int | None = CORRUPT, least: int = LEAST_LETTERS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``word, n``: occurrences of each word of at least ``least`` letters."""

    def rows(table: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        for b in batches:
            ids = pc.fill_null(b.column(0), "").to_pylist()
            texts = pc.fill_null(b.column(1), "").to_pylist()
            total = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_CHARS, side="right")) - 1)
                for word, n in count_in_batch(texts[i:j], ids[i:j], corrupt, least).items():
                    table[word] = table.get(word, 0) + n
                i = j
                if len(table) > TABLE_WORDS:
                    yield rows(table)
                    table = {}
        yield rows(table)

    texts = docs.select(F.col(id_col).cast("string"), text_col)
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """``half, word``: each word under its halves, as a word of ``k`` letters
    that shares one with words of ``k`` and of ``k + 1`` letters."""
    k = F.char_length("word")

    def pair(shorter: Column) -> list[Column]:
        p = F.floor(shorter / 2).cast("int")
        return [F.xxhash64(shorter, F.lit("first"), F.substring("word", F.lit(1), p)),
                F.xxhash64(shorter, F.lit("rest"), F.substring("word", k - shorter + p + 1, shorter - p))]

    return words.select(F.explode(F.array(*pair(k), *pair(k - 1))).alias("half"), "word", k.alias("letters"))


def cells(words: DataFrame, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """``half, a, b, side, word``: the words that meet in each cell. Words of a
    half that fits one chunk meet in cell (0, 0); otherwise chunk ``a`` meets
    chunk ``b``."""
    placed = materialise(halves(words), "halves")
    # halves are hashes: if two fell together, their words would merely be compared, too
    sizes = placed.groupBy("half").agg(F.sum("letters").alias("all")).where(F.col("all") > chunk_letters)
    large = sizes.select("half", F.ceil(F.col("all") / chunk_letters).cast("bigint").alias("chunks"))
    chunked = placed.join(broadcast_if_bounded(materialise(large, "large_halves")), "half", "left")
    own = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("word", F.lit(5)), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("chunks", F.lit(1)) - 1))
    rows = chunked.withColumn("own", own.cast("bigint")).withColumn("other", other)
    return rows.select("half", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                       (F.col("own") <= F.col("other")).cast("int").alias("side"), "word")


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``y`` of ``x``."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def letter_counts(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([len(w) for w in words])
    at = np.repeat(np.arange(len(words)), lengths) * 90 + _LETTER[data]
    # counts and their products are exact: floats of 32 bits up to words of 2000 letters, of 64 bits beyond
    kind = np.float32 if not len(words) or lengths.max() < 2000 else np.float64
    return np.bincount(at, minlength=90 * len(words)).astype(kind).reshape(len(words), 90)


def near_in_block(words: list[str], cell: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of the near words of a block that holds whole cells: pairs within a
    cell, from both sides of it if it has two."""
    counts = letter_counts(words)
    square = (counts * counts).sum(axis=1)
    two_sided = np.zeros(int(cell.max()) + 1, bool)
    two_sided[cell[side == 0]] = True
    for i in range(0, len(words), GRAM_ROWS):
        j = int(np.searchsorted(cell, cell[min(i + GRAM_ROWS, len(words)) - 1], side="right"))
        d = square[i:i + GRAM_ROWS, None] + square[None, i:j] - 2 * (counts[i:i + GRAM_ROWS] @ counts[i:j].T)
        x, y = np.nonzero((d < 2.5) & (d > 0.5))
        x, y = x + i, y + i
        ok = (x < y) & (cell[x] == cell[y]) & ((side[x] != side[y]) | ~two_sided[cell[x]])
        for p, q in zip(x[ok].tolist(), y[ok].tolist()):
            if one_edit(words[p], words[q]):
                yield p, q


def near_pairs(words: DataFrame, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """``word, near``: all pairs of ``words(word)`` one edit apart, both ways."""
    met = cells(words, chunk_letters)
    met = met.repartition("half", "a", "b").sortWithinPartitions("half", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches):
            half, a, b = (table[c].to_numpy() for c in ("half", "a", "b"))
            cell = np.concatenate([[0], np.cumsum((np.diff(half) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0))])
            x, y = [], []
            some = np.flatnonzero(np.bincount(cell)[cell] > 1)
            if len(some):
                own = table["word"].take(pa.array(some)).to_pylist()
                for p, q in near_in_block(own, cell[some], table["side"].to_numpy()[some]):
                    x += [own[p], own[q]]
                    y += [own[q], own[p]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string())], names=["word", "near"])

    return met.mapInArrow(run, "word string, near string").distinct()


def whole_cells(batches: Iterator[pa.RecordBatch], least_rows: int = 4 * GRAM_ROWS) -> Iterator[pa.Table]:
    """Sorted rows in tables that end where a cell ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for c in ("half", "a", "b"):
            v = table[c].to_numpy()
            last &= v == v[-1]
        end = rows - int(last.sum())
        if end:
            for part in _cut(table.slice(0, end), least_rows):
                yield part
            held = table.slice(end).to_batches()
            rows -= end
    if rows:
        for part in _cut(pa.Table.from_batches(held).combine_chunks(), least_rows):
            yield part


def _cut(table: pa.Table, about: int) -> Iterator[pa.Table]:
    """``table`` in parts of whole cells of about so many rows."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for c in ("half", "a", "b"):
        v = table[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    begins = np.append(np.flatnonzero(change), table.num_rows)
    i = 0
    while i < len(begins) - 1:
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + about, side="right")) - 1)
        yield table.slice(int(begins[i]), int(begins[j] - begins[i]))
        i = j


def variants(docs: DataFrame, corrupt: int | None = CORRUPT, least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """Per word of at least ``least_letters`` letters and ``least_count``
    occurrences: ``word, n, n_near, form, form_n, root``."""
    words = materialise(count_words(docs, corrupt, least_letters).where(F.col("n") >= least_count), "words")
    return group(words, ratio, chunk_letters)


def group(words: DataFrame, ratio: int = RATIO, chunk_letters: int = CHUNK_LETTERS) -> DataFrame:
    """``variants`` of counted words (``word, n``, each word once)."""
    pairs = near_pairs(words.select("word"), chunk_letters)
    of = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = pairs.join(of, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    known = form_n >= F.lit(ratio) * F.col("n")
    rows = materialise(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                   F.when(known, F.col("best.form")).alias("form"),
                                   F.when(known, form_n).alias("form_n")), "forms")
    return rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))


def roots(steps: DataFrame) -> DataFrame:
    """``word, root``: ``steps(word, form)`` followed to the last by pointer
    doubling; a step always goes to a more frequent word, so there is an end."""
    at = materialise(steps.withColumnRenamed("form", "root"), "root0")
    for i in range(1, 64):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        moved = materialise(moved, f"root{i}")
        at = moved.select("word", "root")
        if moved.where("went").first() is None:
            break
    return at


VARIANT_SQL = """
WITH RECURSIVE """ + textkit.CRC_SQL.strip() + """,
found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents),
runs AS (SELECT d, run, count(*) AS k FROM found GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(octet_length(encode(d || ':' || run))),
             lambda i: ('0x' || substr(hex(encode(d || ':' || run)), (2 * i + 1)::INT, 2))::BIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word,
         sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND n >= 5),
cut AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, (length(word) + 1)::INT))::INT AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
near AS (
  SELECT p.word, count(*) AS n_near, min((-w.n, p.near)) AS best
  FROM (SELECT DISTINCT word, near FROM pairs) p JOIN words w ON p.near = w.word GROUP BY p.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END::BIGINT AS form_n
  FROM words LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON walk.next = f.word)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
