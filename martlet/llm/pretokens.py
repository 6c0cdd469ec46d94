"""Pre-tokens of byte-level BPE vocabularies, split for a whole batch at once.

The public byte-level pattern is
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
With a class per code point (letter, number, space, other) its matches follow
from runs of equal class: a run starts a token; a space character right before
a run of another class joins that run; the rest of the white space stays one
token, but for its last character when that is not a plain space; and a lone
apostrophe takes one of seven endings. Special strings are tokens of their
own, and the text before and after them is split by itself. The classes come
from the tokenizers library, so its Unicode tables decide."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, SPECIAL = 0, 1, 2, 3, 9
#: Endings that a lone apostrophe takes.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """A class for each code point."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for low in range(0, 0x110000, 0x8000):
        points = [c for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000]
        some, at = "".join(map(chr, points)), np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            has = np.ones(len(points), dtype=bool)
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(some):
                has[a:b] = False
            table[at[has]] = kind
    return table


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")


def token_starts(points: np.ndarray, text_offsets: np.ndarray, special: list[tuple[int, int]],
                 table: np.ndarray) -> np.ndarray:
    """Start of every pre-token; tokens tile the batch and end at the next
    start. ``text_offsets``: code points before each text; ``special``: spans
    of special strings."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = table[points]
    fresh = np.zeros(n + 1, dtype=bool)  # a text, or a part between special strings, starts here
    fresh[text_offsets] = True
    for a, b in special:
        kind[a:b] = SPECIAL
        fresh[a] = fresh[b] = True
    start = fresh[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~fresh[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    for ending in ENDINGS:
        hit = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            hit = hit[(points[hit + k] == ord(c)) & ~fresh[hit + k]]
        start[hit + 1] = False
        stop = hit + 1 + len(ending)
        start[stop[stop < n]] = True
    return np.flatnonzero(start)


def special_spans(texts: list[str], text_offsets: np.ndarray, special: tuple[str, ...]) -> list[tuple[int, int]]:
    if not special:
        return []
    one = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
    return [(int(text_offsets[i]) + m.start(), int(text_offsets[i]) + m.end())
            for i, t in enumerate(texts) if any(s in t for s in special) for m in one.finditer(t)]
