import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import byte_bpe

PATH, PATTERN = byte_bpe.public_vocabulary()
CODEC = byte_bpe.ByteBPE(open(PATH, "rb").read(), PATTERN)
TIKTOKEN = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def expected(text):
    return np.array(TIKTOKEN.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x1f\x85\xa0　 ab'sS19²Ⅷ.,é中😀") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_encodes_as_tiktoken_does(text):
    ids = CODEC.encode(text)
    assert ids == expected(text)
    assert CODEC.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, "xyzzy" * 700 + " tail", " " * 500 + "x", "\n \n" * 200, "é" * 900, "word " * 2000])
def test_long_pieces(text):
    assert CODEC.encode(text) == expected(text)


def test_random_long_pieces():
    rng = np.random.default_rng(3)
    for n in (65, 200, 5000):
        text = "".join(rng.choice(list("abcdefghij"), n))
        assert CODEC.encode(text) == expected(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcr01= é", min_size=1, max_size=300), min_size=1, max_size=20))
def test_rows_of_all_lengths_in_one_batch(texts):
    """Every row of a matrix ends in its own round, with several merges a round where a pair repeats."""
    assert CODEC.merge([t.encode() for t in texts]) == [np.array(TIKTOKEN._encode_single_piece(t.encode()), "<u4").tobytes() for t in texts]


def test_another_pattern_is_split_whole():
    pattern = r"[a-z]+ [a-z]+|(?s:.)"
    codec = byte_bpe.ByteBPE(open(PATH, "rb").read(), pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=CODEC.ranks, special_tokens={})
    for text in ("ab cd ef", "one two three four", " x y"):
        assert codec.encode(text) == np.array(other.encode_ordinary(text), "<u4").tobytes()


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    texts = [f"w{k} x{k}" for k in range(50)]
    for _ in range(2):
        assert CODEC.encode_batch(texts) == [expected(t) for t in texts]
        assert len(CODEC.cache) <= 10


def test_documents(docs_of):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (3, ""), (None, "  two  spaces \n"), (5, "long " * 50_000)]
    out = byte_bpe.digest(byte_bpe.encode_documents(docs_of(rows, extra=["ids", "bpe", "_bpe", "__bpe"]), PATH, PATTERN)).collect()
    want = sorted(
        [(i, len(expected(t or "")) // 4, hashlib.sha256(expected(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows], key=str
    )
    assert sorted(map(tuple, out), key=str) == want


def test_empty_table(docs_of):
    assert byte_bpe.digest(byte_bpe.encode_documents(docs_of([]), PATH, PATTERN)).count() == 0


def test_query_on_whole_table(spark, tiny):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.op3_byte_bpe(spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        e = expected(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(e) // 4, hashlib.sha256(e).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
