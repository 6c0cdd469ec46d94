"""Distinct-word tables joined back by position.

Documents are taken in chunks, runs of whole documents of about
``CHUNK_CHARS`` characters and at most ``CHUNK_ROWS`` rows inside one input
partition. Two passes over the same input share them:

1. each chunk lists its distinct words, dealt to shards (one row per chunk and
   shard); a shard sees each distinct word once per chunk, keeps one of each
   and evaluates it once, and sends the values back to the chunks;
2. each chunk's documents, compressed, meet the values of its words
   (a cogroup on the chunk) and every word position takes its value.

So a word travels once per chunk instead of once per occurrence, whatever its
frequency, and no task holds more than one chunk or one shard; the number of
shards follows the input. A chunk's id is a hash of its texts and its place
(partition and number), so that copied partitions are chunks of their own: a
chunk that is computed again after a lost executor has the same id and the same
words, in the same (hash) order. Words are told apart inside a chunk by 64-bit
hashes. Tasks give freed memory back after each chunk: workers live on through
a job's stages, and what their allocators keep would add up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm import pretokens, textkit
from martlet.llm.common import release, repeatable, shard_count, text_bytes

CHUNK_CHARS = 6 << 20
CHUNK_ROWS = 1 << 16
BATCH_CHARS = 512 << 10
SHARD_BYTES = 24 << 20

_DICT_SCHEMA = "shard int, chunk long, places binary, lengths binary, words binary"
_VALUE_SCHEMA = "chunk long, places binary, lengths binary, numbers binary"


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_documents(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its id and its documents, compressed."""
    for chunk, table in chunks(batches, most):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema,
                               options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
            w.write_table(table)
        data = sink.getvalue()
        ends = pa.py_buffer(np.array([0, data.size], "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()),
                                          pa.Array.from_buffers(pa.binary(), 1, [None, ends, data])],
                                         names=["chunk", "documents"])
        del table, sink, data
        release()


PACKED_SCHEMA = "chunk long, documents binary"


def chunk_tables(batches: Iterator[pa.RecordBatch], most: int | None = None,
                 most_rows: int | None = None) -> Iterator[pa.Table]:
    """Whole rows of one partition in runs of about ``most`` characters of the
    last column and at most ``most_rows`` rows; a longer text is a run of its own."""
    most, most_rows = most or CHUNK_CHARS, most_rows or CHUNK_ROWS
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        lengths = pc.fill_null(pc.utf8_length(b.column(b.num_columns - 1)), 0)
        total = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])
        i = 0
        while i < b.num_rows:
            j = min(int(np.searchsorted(total, total[i] + most - size, side="right")) - 1, i + most_rows - rows)
            if j <= i and held:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
                continue
            j = max(j, i + 1)
            held.append(b.slice(i, j - i))
            size += int(total[j] - total[i])
            rows += j - i
            i = j
    if held:
        yield pa.Table.from_batches(held)


def chunks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The chunks of one partition with their ids."""
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    for k, table in enumerate(chunk_tables(batches, most)):
        yield chunk_id(table, first + k), table


def chunk_id(table: pa.Table, place: int = 0) -> int:
    """A hash of the chunk's texts, of where each begins, and of its place."""
    h = xxhash.xxh64(seed=place)
    for col in table.column(table.num_columns - 1).chunks:
        for _, data, off in textkit.utf8_batches(col, 1 << 30):
            h.update(data)
            h.update(off)
    return h.intdigest() - (1 << 63)


@dataclass
class Part:
    """Some whole texts of a chunk: where each text's tokens begin in ``word``
    (length: texts + 1), and each token's place among the chunk's distinct
    words."""
    token_offsets: np.ndarray
    word: np.ndarray


@dataclass
class Index:
    hashes: np.ndarray  # of the distinct words, ascending; a word's place is its rank
    parts: list[Part]
    words: list[str]  # the distinct words by place, if they were asked for


def index_chunk(table: pa.Table, special: tuple[str, ...], classes: np.ndarray, with_words: bool = False) -> Index:
    """The words of a chunk's texts, some whole texts at a time."""
    column = pc.fill_null(table.column(table.num_columns - 1), "")
    total = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy())]).astype(np.int64)
    parts, found, words = [], [], {}
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BATCH_CHARS, side="right")) - 1)
        texts = column.slice(i, j - i).to_pylist()
        points = pretokens.code_points(texts)
        off = total[i:j + 1] - total[i]
        starts = pretokens.token_starts(points, off[:-1], pretokens.special_spans(texts, off, special), classes)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        codes, uniques = pd.factorize(textkit.span_hashes(points, starts, ends))
        parts.append(Part(np.searchsorted(starts, off, side="left"), codes.astype(np.int32)))
        found.append(np.asarray(uniques, dtype=np.uint64))
        if with_words:
            at = np.zeros(len(uniques), dtype=np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            joined = "".join(texts)
            for h, a, b in zip(found[-1].tolist(), starts[at].tolist(), ends[at].tolist()):
                if h not in words:
                    words[h] = joined[a:b]
        i = j
    hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    for part, own in zip(parts, found):
        part.word = np.searchsorted(hashes, own)[part.word].astype(np.int32)
    return Index(hashes, parts, [words[h] for h in hashes.tolist()] if with_words else [])


def ragged(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """``values`` of the entries ``pick``, one after the other."""
    n = lengths[pick]
    ends = np.cumsum(n)
    if not len(ends):
        return values[:0]
    return values[np.repeat(offsets[pick] - (ends - n), n) + np.arange(ends[-1])]


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64) if len(lengths) else lengths.astype(np.int64)


def map_words(docs: DataFrame, evaluate: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
              finish: Callable[[pa.Table, Index, np.ndarray, np.ndarray], pa.Table], schema: str,
              special: tuple[str, ...] = (), shard_of: Callable[[list[str], np.ndarray], np.ndarray] | None = None,
              text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Evaluate each distinct pre-token of all texts once per shard and bring
    the values back to every document.

    ``evaluate(words)`` gives each word's number of values and all values;
    ``finish(rows, index, lengths, numbers)`` makes the result rows of a chunk
    from its documents (``keep`` columns, then the text), its index, and the
    values of its words by place. ``shard_of(words, hashes)`` may deal words by
    something other than their hash, as non-negative numbers."""
    classes = pretokens.char_classes()
    docs = repeatable(docs.select(*keep, F.col(text_col).alias("_text")))
    n_shards = shard_count(text_bytes(docs, "_text"), SHARD_BYTES)

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches):
            ix = index_chunk(table, special, classes, with_words=True)
            words = ix.words
            shard = (shard_of(words, ix.hashes) if shard_of else ix.hashes) % np.uint64(n_shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(n_shards + 1, dtype=np.uint64))
            rows = [(s, order[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            columns: list[list] = [[], [], []]
            for _, o in rows:
                own = [words[k].encode() for k in o.tolist()]
                columns[0].append(squeeze(np.diff(o, prepend=0)))
                columns[1].append(squeeze(np.array([len(w) for w in own])))
                columns[2].append(zstandard.ZstdCompressor(level=3).compress(b"".join(own)))
            yield pa.RecordBatch.from_arrays([
                pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                *[pa.array(c, pa.binary()) for c in columns]],
                names=["shard", "chunk", "places", "lengths", "words"])
            del table, ix, words, columns, rows
            release()

    def value_words(shard: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        codes = []
        for lengths, data in zip(shard["lengths"].to_pylist(), shard["words"].to_pylist()):
            data, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(unsqueeze(lengths)).tolist()
            codes.append(np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip([0, *ends], ends)], np.int64))
        counts, numbers = evaluate([w.decode() for w in seen])
        counts, offsets = counts.astype(np.int32), _offsets(counts)
        del seen
        out = pa.table({
            "chunk": shard["chunk"], "places": shard["places"],
            "lengths": pa.array([squeeze(counts[c]) for c in codes], pa.binary()),
            "numbers": pa.array([squeeze(ragged(numbers, offsets, counts, c)) for c in codes], pa.binary())})
        release()
        return out

    def meet(documents: pa.Table, values: pa.Table) -> pa.Table:
        out, by_place = [], None
        for blob in documents["documents"]:
            table = pa.ipc.open_stream(blob.as_buffer()).read_all()
            ix = index_chunk(table, special, classes)
            if by_place is None:
                by_place = _by_place(values, len(ix.hashes))
            out.append(finish(table, ix, *by_place))
            del table, ix
        release()
        return pa.concat_tables(out)

    listed = docs.mapInArrow(list_words, _DICT_SCHEMA)
    values = listed.groupBy("shard").applyInArrow(value_words, _VALUE_SCHEMA)
    packed = docs.mapInArrow(pack_documents, PACKED_SCHEMA)
    return packed.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(meet, schema)


def _by_place(values: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of values of each place, and all values in the order of places.
    Equal chunks send equal rows; one of each is enough."""
    places, lengths, numbers = [], [], []
    seen = set()
    for p, c, v in zip(values["places"].to_pylist(), values["lengths"].to_pylist(), values["numbers"].to_pylist()):
        if p is not None and p not in seen:
            seen.add(p)
            places.append(np.cumsum(unsqueeze(p), dtype=np.int64))
            lengths.append(unsqueeze(c).astype(np.int64))
            numbers.append(unsqueeze(v))
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    if len(place) != n:
        raise RuntimeError(f"a chunk has {n} distinct words, but values came for {len(place)}: its input changed")
    order = np.argsort(place, kind="stable")
    count, flat = np.concatenate(lengths) if n else place, np.concatenate(numbers) if n else np.zeros(0, "<u4")
    return count[order], ragged(flat, _offsets(count), count, order)
