"""Token counts of a unigram segmentation by trie-shared dynamic programming.

A unigram vocabulary gives each piece (a byte string) a score; a pre-token is
cut into the pieces with the greatest sum. The forward score of a prefix, the
best sum over its segmentations, depends on the prefix only, so pre-tokens
that share a prefix share it. Each shard holds distinct pre-tokens in sorted
order, which is the depth-first order of their trie: walking it, the forward
scores of the path from the root to the current node are kept, a new
pre-token drops the part that differs and extends the rest, and the terminal
node's piece count is stored for the word. Memory is one path and one shard.

The counts return to every document through the distinct-word table
(``wordtable``), so a pre-token costs one evaluation and one small transfer
per chunk however often it occurs. Pre-tokens are dealt to shards by their
first characters, which keeps shared prefixes together.

Equal sums go to the segmentation with fewer pieces. A byte that no piece
covers counts as a piece of its own with the score ``least score - 10``.

Defined cases: null or empty texts have 0 pre-tokens and 0 tokens; whole
texts count whatever their length; repeated rows give repeated results; an
empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from martlet.llm import wordtable

PREFIX_CHARS = 6
UNKNOWN_PENALTY = 10.0


def zipf_scores(path: str) -> dict[bytes, float]:
    """Scores of a public rank file (``base64 piece, rank`` per line): the
    logarithm of a Zipf probability of the rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    norm = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - norm for p, r in ranks.items()}


def trie_counts(words: list[bytes], scores: dict[bytes, float]) -> np.ndarray:
    """Number of pieces of each word, in the given order."""
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    out = np.zeros(len(words), dtype=np.int32)
    best: list[float] = [0.0]  # forward score of each prefix on the path
    count: list[int] = [0]  # pieces of that segmentation
    before = b""
    find = scores.get
    for k in sorted(range(len(words)), key=words.__getitem__):
        word = words[k]
        shared, most = 0, min(len(word), len(before))
        if word[:most] == before[:most]:
            shared = most
        else:
            while word[shared] == before[shared]:
                shared += 1
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top, pieces = -math.inf, 0
            for start in range(max(0, end - longest), end):
                s = find(word[start:end])
                if s is None:
                    if end - start > 1:
                        continue
                    s = unknown
                s += best[start]
                if s > top or s == top and count[start] + 1 < pieces:
                    top, pieces = s, count[start] + 1
            best.append(top)
            count.append(pieces)
        out[k] = count[len(word)]
        before = word
    return out


def count_tokens(docs: DataFrame, scores: dict[bytes, float], text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_pretokens`` and ``n_tokens`` of each document.
    ``scores`` goes to every task: its size is fixed by the vocabulary."""

    def evaluate(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(words), np.int32), trie_counts([w.encode() for w in words], scores).astype(np.uint32)

    def by_prefix(words: list[str], hashes: np.ndarray) -> np.ndarray:
        return np.array([zlib.crc32(w[:PREFIX_CHARS].encode()) for w in words], dtype=np.uint64)

    def finish(table: pa.Table, index: wordtable.Index, counts: np.ndarray, tokens: np.ndarray) -> pa.Table:
        words, sums = [], []
        for part in index.parts:
            words.append(np.diff(part.token_offsets))
            total = np.concatenate([[0], np.cumsum(tokens[part.word].astype(np.int64))])
            sums.append(np.diff(total[part.token_offsets]))
        out = table.drop_columns(["_text"])
        for name, parts in (("n_pretokens", words), ("n_tokens", sums)):
            out = out.append_column(name, pa.array(np.concatenate(parts).astype(np.int64)))
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return wordtable.map_words(docs, evaluate, finish, f"{fields}, n_pretokens long, n_tokens long",
                               shard_of=by_prefix, text_col=text_col, keep=keep)
