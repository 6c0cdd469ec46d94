"""Exact deduplication by content-defined chunk recipes.

1. Each text's UTF-8 bytes are cut where a rolling hash of the last ``WINDOW``
   bytes is one of 2 ** ``CUT_BITS`` (never before ``LEAST`` bytes, always after
   ``MOST``), so equal texts are cut alike and a passage shared by two texts
   gives the same chunks inside it. A task keeps one copy of each chunk it meets
   within some ``HELD_BYTES`` of chunks, told apart by their bytes. Recipes (per
   document the ordered references to its chunks, 20 bytes each) and chunks are
   written once; this is the only time that a text moves.
2. A chunk's identifier is its 128-bit fingerprint, *verified*: the bytes of
   fingerprints that were written more than once meet and are compared. Should
   one fingerprint stand for different bytes, those are numbered and every
   recipe with such a chunk takes the numbers in.
3. Texts are equal exactly if their lists of identifiers are. Lists are grouped
   (counts and maxima combine on the map side), and each document meets its
   group. Only these short lists are shuffled, however long the texts are.

Scale: every step follows the input; nothing is collected but whether any
fingerprint was found to collide. A chunk is at most ``MOST`` bytes, so a
document of any length is compared in small rows (its recipe has 20 bytes for
each chunk); a copied text is one partial row per task in 3 and its chunks one
row per ``HELD_BYTES`` in 2. The table of repeated fingerprints is broadcast
within a proven size; beyond it the written chunks, not the documents, are
joined by fingerprint once.

Defined cases: a null text counts as empty, so null and empty texts are
equal; of equal rows with the same id exactly one stays; a null id is below
every other; texts are never normalised or cut; an empty table gives an empty
result. Columns other than ``keep`` and the text take no part, and their names
can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm import textkit
from martlet.llm.common import materialise
from martlet.plans.joins import broadcast_if_bounded

WINDOW = 32
CUT_BITS = 11
LEAST = 512
MOST = 16 << 10
HELD_BYTES = 8 << 20
BATCH_BYTES = 512 << 10
#: Bytes of a reference: the fingerprint, and the number of the chunk among those with it.
REF = 20
REPEATED_ROWS = 4_000_000

_GEAR = textkit.mix64(np.arange(1, 257, dtype=np.uint64))


def _marks(data: np.ndarray, cut_bits: int) -> Iterator[np.ndarray]:
    """Positions after each window whose hash asks for a cut, a block of the
    bytes at a time."""
    for base in range(0, len(data), BATCH_BYTES):
        begin = max(0, base - WINDOW + 1)
        block = data[begin:base + BATCH_BYTES]
        n = len(block)
        if n >= WINDOW:
            power, inverse = textkit.powers(n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_GEAR[block] * power[:n], dtype=np.uint64, out=total[1:])
            rolled = (total[WINDOW:] - total[:-WINDOW]) * inverse[:n + 1 - WINDOW]
            yield np.flatnonzero(rolled >> np.uint64(64 - cut_bits) == 0) + (begin + WINDOW)


def cuts(data: np.ndarray, offsets: np.ndarray, cut_bits: int = CUT_BITS, least: int = LEAST,
         most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text of a batch. They depend on the text's
    own bytes only: ``least`` is not below ``WINDOW``."""
    if least < WINDOW:
        raise ValueError(f"chunks have {WINDOW} bytes at least")
    ends = np.concatenate([np.zeros(0, np.int64), *_marks(data, cut_bits)])
    starts = offsets[:-1].tolist()
    first, last = (np.searchsorted(ends, offsets[:-1] + least).tolist(), np.searchsorted(ends, offsets[1:]).tolist())
    ends = ends.tolist()
    out = []
    for at, stop, i, j in zip(starts, offsets[1:].tolist(), first, last):
        own = []
        while stop - at > least:
            while i < j and ends[i] < at + least:
                i += 1
            end = min(at + most, stop, ends[i] if i < j else stop)
            own.append(end)
            at = end
        if at < stop:
            own.append(stop)
        out.append(own)
    return out


def fingerprint(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _fields(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)


def store(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
          of_chunk: Callable[[bytes], bytes] = fingerprint, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Recipes and chunks, written once. Rows of documents: ``doc`` (the
    ``keep`` columns), ``row`` (a number of its own), ``held`` (which of the
    tasks' chunk sets it refers to), ``text_sha256``, ``recipe``. Rows of chunks:
    ``held``, ``fp``, ``nth`` and ``content``."""
    packed = docs.select(F.struct(*keep).alias("doc"), F.col(text_col).alias("text"))
    schema = (f"doc struct<{_fields(docs, keep)}>, `row` long, held long, text_sha256 string, recipe binary, "
              "fp binary, nth int, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        row = held = first
        seen: dict[bytes, list[bytes]] = {}
        size = 0
        for b in batches:
            for i, data, off in textkit.utf8_batches(b.column(1), BATCH_BYTES):
                if size > held_bytes:
                    seen, size, held = {}, 0, held + 1
                view = memoryview(data)
                digests, recipes, fps, nths, contents = [], [], [], [], []
                for at, stop, ends in zip(off[:-1].tolist(), off[1:].tolist(), cuts(data, off)):
                    digests.append(hashlib.sha256(view[at:stop]).hexdigest())
                    recipe = []
                    for end in ends:
                        chunk = bytes(view[at:end])
                        at = end
                        fp = of_chunk(chunk)
                        same = seen.setdefault(fp, [])
                        if chunk not in same:
                            same.append(chunk)
                            size += len(chunk) + 200
                            fps.append(fp)
                            nths.append(len(same) - 1)
                            contents.append(chunk)
                        recipe.append(fp + same.index(chunk).to_bytes(REF - 16, "big"))
                    recipes.append(b"".join(recipe))
                n, k = len(recipes), len(fps)
                docs_part = b.column(0).slice(i, n)
                yield pa.RecordBatch.from_arrays([
                    docs_part, pa.array(range(row, row + n), pa.int64()), pa.array([held] * n, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(recipes, pa.binary()), pa.nulls(n, pa.binary()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=_NAMES)
                row += n
                if k:
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(k, docs_part.type), pa.nulls(k, pa.int64()), pa.array([held] * k, pa.int64()),
                        pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.array(fps, pa.binary()),
                        pa.array(nths, pa.int32()), pa.array(contents, pa.binary())], names=_NAMES)

    return materialise(packed.mapInArrow(run, schema), "chunks")


_NAMES = ["doc", "row", "held", "text_sha256", "recipe", "fp", "nth", "content"]


def collisions(chunks: DataFrame) -> DataFrame | None:
    """``held, old, new``: references that have to change because their
    fingerprint stands for different bytes; None if none does."""
    repeated = materialise(chunks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "repeated")
    contents = (chunks.join(broadcast_if_bounded(repeated, max_rows=REPEATED_ROWS), "fp", "left_semi")
                .select("fp", "content").distinct())
    unlike = materialise(contents.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "unlike")
    if unlike.first() is None:
        return None
    several = chunks.join(broadcast_if_bounded(unlike), "fp", "left_semi")
    number = (F.row_number().over(Window.partitionBy("fp").orderBy("content")) - 1)
    numbers = several.select("fp", "content").distinct().withColumn("new_nth", number)
    found = several.join(numbers, ["fp", "content"])

    def reference(nth):
        return F.concat("fp", F.unhex(F.lpad(F.hex(nth.cast("bigint")), 2 * (REF - 16), "0")))

    return materialise(found.select("held", reference(F.col("nth")).alias("old"),
                                    reference(F.col("new_nth")).alias("new")), "collisions")


def verified(recipes: DataFrame, changed: DataFrame) -> DataFrame:
    """``recipes`` with the verified identifiers in place."""
    count = (F.octet_length("recipe") / REF).cast("int")
    refs = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1),
                                         lambda i: F.substring("recipe", i * REF + 1, F.lit(REF))))
    parts = recipes.select("row", "held", F.posexplode(refs).alias("at", "old"))
    new = F.hex(F.coalesce("new", "old"))
    lists = parts.join(changed, ["held", "old"], "left").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", new.alias("id")))).alias("ids"))
    lists = lists.select("row", F.unhex(F.array_join("ids.id", "")).alias("_recipe"))
    return recipes.join(lists, "row", "left").withColumn("recipe", F.coalesce("_recipe", "recipe")).drop("_recipe")


def classes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text",
            **options) -> DataFrame:
    """Per document, kept or not: the ``keep`` columns, ``keep_id`` (the
    largest ``id_col`` among equal texts), ``group_size``, ``kept`` and
    ``text_sha256``. ``keep`` must hold ``id_col``."""
    written = store(docs, keep, text_col, **options)
    recipes = written.where("fp IS NULL").select("doc", "row", "held", "text_sha256", "recipe")
    changed = collisions(written.where("fp IS NOT NULL").select("held", "fp", "nth", "content"))
    if changed is not None:
        recipes = materialise(verified(recipes, changed), "recipes")
    best = F.max(F.struct(F.col(f"doc.{id_col}").alias("id"), F.col("row")))
    groups = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).where("size > 1")
    groups = materialise(groups.withColumnRenamed("recipe", "of"), "groups")
    rows = recipes.join(broadcast_if_bounded(groups, max_rows=REPEATED_ROWS), F.col("recipe") == F.col("of"), "left")
    alone = F.col("size").isNull()
    return rows.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in keep],
        F.when(alone, F.col(f"doc.{id_col}")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    columns = tuple(docs.columns)
    packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return classes(packed, ("_doc", "_id"), "_id", "_text").where("kept").select(*[F.col(f"_doc.`{c}`") for c in columns])


DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
