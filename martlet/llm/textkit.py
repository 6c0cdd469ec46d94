"""Whole-batch text work in numpy, used inside tasks: a batch of texts is one
byte or code-point array, and words, shingles and their 64-bit hashes come
from array operations over it. No text is cut; a batch holds whole texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six bytes that separate words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; sizes are rounded up so that few are made."""
    return _powers(1 << max(16, int(n).bit_length()))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``symbols[starts[i]:ends[i]]`` from one running sum."""
    n = len(symbols)
    p, inv = powers(n + 1)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((mix64(symbols.astype(np.uint64) + _ODD)) * p[:n], dtype=np.uint64, out=s[1:])
    h = (s[ends] - s[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _ODD)


def utf8_batches(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``texts`` (string; null counts as empty) in runs of whole texts of about
    ``most`` bytes: first row, UTF-8 bytes, offsets of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray,
               outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a batch: byte starts, byte ends, and the number of
    words before each text (length: texts + 1). ``outside`` tells of each of the
    256 byte values whether it separates words."""
    n = len(data)
    inside = ~outside[data] if n else np.zeros(0, bool)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts_at = inside.copy()
    if n:
        starts_at[1:] &= ~inside[:-1] | first[1:n]
    starts = np.flatnonzero(starts_at)
    ends_at = inside.copy()
    if n:
        ends_at[:-1] &= ~inside[1:] | first[1:n]
    ends = np.flatnonzero(ends_at) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``; 0 for empty spans."""
    s = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=s[1:])
    return s[offsets[1:]] - s[offsets[:-1]]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values (position = first)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = mix64(out + h[k:k + n] + np.uint64((k + 1) * int(_ODD) % (1 << 64)))
    return out


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)  # fixed value: the CRC-32 polynomial
    return t


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 (unsigned) of ``data[starts[i]:ends[i]]``, as if the bytes with the
    CRC-32 ``before[i]`` stood in front of it. All spans advance by one byte
    together, the longer ones first; spans of over 64 bytes go to zlib."""
    lengths = ends - starts
    state = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(lengths > 64)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]], int(state[i]))
    order = np.argsort(np.minimum(lengths, 65).astype(np.uint8) ^ 0xFF, kind="stable")[len(long):]
    at, crc = starts[order], ~state[order]
    active = len(order) - np.cumsum(np.bincount(lengths[order], minlength=1))
    for k, m in enumerate(active.tolist()):
        if not m:
            break
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + k]) & 255] ^ (crc[:m] >> 8)
    out[order] = ~crc
    return out


#: SQL: the table of CRC-32 by its rule; bytes are then taken one after the other.
CRC_SQL = """
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t)
"""
