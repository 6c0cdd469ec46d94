"""Pre-tokens, BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

import odd_rows
from conftest_paths import SF
from martlet.llm import bpe, pretokens, token_counts, wordtable
from martlet.llm import queries as q

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_pretokens_equal_the_library():
    rng = random.Random(3)
    alphabet = ["a", "b", "s", "t", "r", "e", "v", "l", "d", "m", "'", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "Ⅷ", "!",
                "#", " ", "　", "\u0085", "\x1c", "中", "😀", "'s", "'re", "'ll", "́", "٣"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(6000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = pretokens.token_starts(pretokens.code_points(texts), offsets[:-1], [], pretokens.char_classes())
    at = np.searchsorted(starts, offsets)
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for i, t in enumerate(texts):
        want = sorted({a for _, (a, _) in library.pre_tokenize_str(t)}) if t else []
        assert (starts[at[i]:at[i + 1]] - offsets[i]).tolist() == want, t


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def by_library(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.QUERIES["op3_bpe"](spark, SF).collect()}
    assert got == {d: by_library(library, t) for d, t in texts.items()}


def test_bpe_odd_rows(spark, library):
    docs = odd_rows.documents(spark).repartition(3)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect())
    assert got == sorted((d or 0, *by_library(library, t)) for d, t, *_ in odd_rows.ROWS)
    assert bpe.digests(odd_rows.nothing(spark), PATH).count() == 0


def test_bpe_round_trip(spark, library):
    docs = odd_rows.documents(spark)
    for r in bpe.decode(bpe.encode(docs, PATH, keep=("doc_id", "text")), PATH).collect():
        assert r.decoded == (r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids


def test_chunks_hold_whole_rows():
    import pyarrow as pa
    texts = ["a" * n for n in (5, 50, 0, 3, 3, 200, 1, 1, 1)]
    batch = pa.record_batch({"doc_id": list(range(9)), "_text": texts})
    chunks = list(wordtable.chunk_tables(iter([batch, batch.slice(0, 0), batch]), 10))
    assert [t for c in chunks for t in c["_text"].to_pylist()] == texts * 2
    assert all(sum(map(len, c["_text"].to_pylist())) <= 10 or c.num_rows == 1 for c in chunks)


def best_count(word, scores):
    """Plain dynamic programming over one word."""
    lowest = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            s = scores.get(word[start:end], lowest if end - start == 1 else None)
            if s is not None:
                options.append((s + best[start][0], -best[start][1] - 1))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_trie_counts_equal_word_by_word():
    rng = random.Random(1)
    scores = {bytes(p, "ascii"): -rng.random() * 5 for p in ("a", "b", "ab", "ba", "aab", "bbb", "abab")}
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))).encode() for _ in range(400)]
    assert token_counts.trie_counts(words, scores).tolist() == [best_count(w, scores) for w in words]


def test_token_counts_equal_the_library(spark):
    scores = token_counts.zipf_scores(RANKS)
    symbol = {b: c for c, b in bpe.byte_of_symbol().items()}
    unigram = Tokenizer(models.Unigram([("<none>", -99.0), *(("".join(symbol[b] for b in p), s) for p, s in scores.items())],
                                       unk_id=0))
    unigram.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in q.QUERIES["op8_token_counts"](spark, SF).collect()}
    assert got == {d: len(unigram.encode(t).ids) for d, t in texts.items()}


def test_token_counts_odd_rows(spark):
    scores = {b"a": -1.0, b"the": -1.0, b" the": -1.5}
    got = token_counts.count_tokens(odd_rows.documents(spark), scores).collect()
    assert len(got) == len(odd_rows.ROWS)
    assert all(r.n_tokens == r.n_pretokens == 0 for r in got if r.doc_id in (1, 2))
    assert token_counts.count_tokens(odd_rows.nothing(spark), scores).count() == 0
