"""Byte-level BPE encoding and decoding over a distinct-word table.

The pre-tokens ("words") of all texts are split in Spark tasks, each distinct
word is encoded once by the public tokenizer file, and the ids come back to
every position (``wordtable``). Decoding joins ids to their pieces: the
vocabulary's id-to-piece table (about 50,000 rows, a size fixed by the
tokenizer file) goes to every task with the code.

Results equal ``Tokenizer.encode(text, add_special_tokens=False).ids`` and
``Tokenizer.decode(ids, skip_special_tokens=False)`` for a byte-level BPE file
without normaliser; other files are refused. Strings of special tokens in a
text become the special token, as the library does by default.

Defined cases: a null or empty text has no ids and decodes to the empty
string; repeated rows give repeated results; whole texts are encoded whatever
their length; an empty table gives an empty result; other columns take no
part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlet.llm import wordtable


def _specification(path: str) -> tuple[str, dict, tuple[str, ...]]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
    if (spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or spec.get("normalizer") or not plain):
        raise ValueError("only byte-level BPE files without normaliser or prefix space are supported")
    return text, spec, tuple(t["content"] for t in spec.get("added_tokens", []))


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    """The library's tokenizer from the text of its file, unused truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    return t


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for:
    printable Latin-1 characters stand for themselves, the other bytes follow
    in order from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str) -> list[bytes]:
    """Bytes of each id's piece."""
    _, spec, _ = _specification(path)
    symbols = byte_of_symbol()
    table = {i: bytes(symbols[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def _encoder(text: str):
    """Ids of distinct words, each encoded once by the library."""

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = _tokenizer(text)
        counts, flat = [], []
        for i in range(0, len(words), 10_000):
            ids = [e.ids for e in t.encode_batch_fast(words[i:i + 10_000], add_special_tokens=False)]
            counts.append(np.array([len(x) for x in ids], dtype=np.int32))
            flat.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(counts[-1].sum())))
        if not counts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint32)
        return np.concatenate(counts), np.concatenate(flat)

    return encode_words


def _document_ids(index: wordtable.Index, counts: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Ids of each document of a chunk, joined back by position."""
    offsets = wordtable._offsets(counts)
    for part in index.parts:
        flat = wordtable.ragged(ids, offsets, counts, part.word).astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(counts[part.word])])[part.token_offsets]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield flat[a:b]


class Pieces:
    """The id-to-piece table of a vocabulary, as one byte array."""

    def __init__(self, path: str):
        table = pieces(path)
        self.lengths = np.array([len(p) for p in table], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.offsets = wordtable._offsets(self.lengths)

    def text(self, ids: np.ndarray) -> str:
        """Joins ids to their pieces; ids outside the vocabulary have none, and
        bytes that are no UTF-8 become replacement characters."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        return wordtable.ragged(self.flat, self.offsets, self.lengths, ids).tobytes().decode("utf-8", "replace")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (binary: little-endian
    unsigned 32-bit integers) of each document."""
    text, _, special = _specification(path)

    def finish(table: pa.Table, index: wordtable.Index, counts: np.ndarray, ids: np.ndarray) -> pa.Table:
        blobs = [x.tobytes() for x in _document_ids(index, counts, ids)]
        return table.drop_columns(["_text"]).append_column(
            "n_tokens", pa.array([len(x) // 4 for x in blobs], pa.int64())).append_column(
            "ids", pa.array(blobs, pa.binary()))

    return wordtable.map_words(docs, _encoder(text), finish, f"{_fields(docs.select(*keep))}, n_tokens long, ids binary",
                               special=special, text_col=text_col, keep=keep)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, by a join of ids to pieces."""
    table = Pieces(path)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [table.text(np.frombuffer(x, "<u4")) if x else "" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())],
                                             names=[*b.schema.names, text_col])

    return encoded.mapInArrow(run, f"{_fields(encoded)}, `{text_col}` string")


def digests(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode, and reduce both to digests where they are made, so that
    ids and texts don't travel: ``keep`` columns, ``n_tokens, ids_sha256,
    decoded_sha256``."""
    text, _, special = _specification(path)
    table = Pieces(path)

    def finish(rows: pa.Table, index: wordtable.Index, counts: np.ndarray, ids: np.ndarray) -> pa.Table:
        n, of_ids, of_text = [], [], []
        for x in _document_ids(index, counts, ids):
            n.append(len(x))
            of_ids.append(hashlib.sha256(x.tobytes()).hexdigest())
            of_text.append(hashlib.sha256(table.text(x).encode()).hexdigest())
        return (rows.drop_columns(["_text"]).append_column("n_tokens", pa.array(n, pa.int64()))
                .append_column("ids_sha256", pa.array(of_ids, pa.string()))
                .append_column("decoded_sha256", pa.array(of_text, pa.string())))

    schema = f"{_fields(docs.select(*keep))}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return wordtable.map_words(docs, _encoder(text), finish, schema, special=special, text_col=text_col, keep=keep)
