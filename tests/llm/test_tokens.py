"""Token ids, counts and round trips against the tiktoken library, on words that sums of powers confuse and on
texts over a slice."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import bpe, byte_bpe, queries, token_counts


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


A, B = thue_morse(2048)
TEXTS = [
    A + "\n" + B, A, B, f"{A} {B} {A}", "", None, "it's 'LL été 日本 × 12  \n\n tail  ",
    "plain words and 12 numbers " * 60_000,  # cut in slices of a text that numpy splits
    "日本 words × here " * 90_000,  # and of one that the library splits
    "x" * (bpe.SLICE_BYTES + 5000),  # one word over a slice
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, b"x", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens long")


@pytest.fixture(scope="module")
def want():
    enc = bpe.encoding(queries.RANKS)
    ids = [np.array(enc.encode_ordinary(t or ""), "<u4") for t in TEXTS]
    return [(i if i != 5 else None, x) for i, x in enumerate(ids)] + [(0, ids[0])]


def test_encoder_and_distinct_words(want):
    assert len(TEXTS[7]) > bpe.SLICE_BYTES and len(TEXTS[8].encode()) > bpe.SLICE_BYTES
    got = bpe.Encoder(queries.RANKS).encode(pa.array(TEXTS))
    for x, (_, y) in zip(got, want):
        assert np.array_equal(x, y)
    raw = np.frombuffer(b"ab abc ab x abc" + b"y" * 300 + b"z" + b"y" * 300 + b"w", np.uint8)
    start, end = np.array([0, 3, 7, 10, 12, 15, 316]), np.array([2, 6, 9, 11, 15, 316, 617])
    for h in (bpe.hashes(raw, start, end), np.zeros(7, np.uint64)):  # and where every hash is one
        code, one = bpe.distinct(raw, start, end, h)
        assert code.tolist() == [0, 1, 0, 2, 1, 3, 4] and one.tolist() == [0, 1, 3, 5, 6]


def test_query_of_ids(spark, docs, want, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, queries.op5_byte_bpe(spark, str(tmp_path)).collect()))
    text = {i: (t or "").encode() for i, t in zip([i if i != 5 else None for i in range(len(TEXTS))], TEXTS)}
    assert got == Counter((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(text[i]).hexdigest()) for i, x in want)


def test_blocks_of_few_bytes(spark, docs, want, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 1000)
    got = Counter((r.doc_id, bytes(r.ids)) for r in byte_bpe.encode_docs(docs.repartition(3), queries.RANKS).collect())
    assert got == Counter((i, x.tobytes()) for i, x in want)


def test_readings_that_differ_fail():
    """A block whose texts and dictionary come from different readings is refused."""
    import pandas as pd

    a, b = byte_bpe._Block(), byte_bpe._Block()
    for block, text in ((a, b"one two"), (b, b"one six")):
        raw = np.frombuffer(text, np.uint8)
        at, end = np.array([0, 3]), np.array([3, 7])
        block.add(bpe.hashes(raw, at, end), raw, at, end)
    assert a.mark()[0] != b.mark()[0] and isinstance(pd.DataFrame(list(a.dictionary(4))), pd.DataFrame)


def test_counts(spark, docs, want):
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.count_tokens(docs, queries.RANKS))).collect()
    n = [len(x) for _, x in want]
    assert {r.n_tokens: r.docs for r in sums} == Counter(n)
    for r in sums:
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == (sum(x >= r.n_tokens for x in n), sum(x for x in n if x >= r.n_tokens), sum(min(x, r.n_tokens) for x in n))
