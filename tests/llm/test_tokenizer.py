import base64
from functools import cache

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import queries, tokenizer
from loomspan.llm.tokenizer import PairIndexBPE


@cache
def tiktoken_encode():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def own():
    return PairIndexBPE(tokenizer.default_path())


@pytest.fixture(scope="module")
def reference():
    return tiktoken_encode()


@pytest.fixture(scope="module")
def encoder():
    return own()


def test_all_small_documents(spark, small, reference):
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, small).collect()}
    table = pq.read_table(f"{small}/documents.parquet").to_pylist()
    assert got == {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in table}


@pytest.mark.parametrize("text", ["aaaaaaaaaaa", "a" * 3001, "<|endoftext|>", "  x  \n\n\ty ", " " * 50, "मेरा 👩🏽‍💻 ﬁ\x00‮", "日本語の文章", "don't I'll we've", "1234567890" * 20, "\r\n\r\n", "==========", "x" + "=" * 999])
def test_odd_texts(encoder, reference, text):
    assert encoder.encode_batch([text]) == [reference(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(texts):
    assert own().encode_batch(texts) == [tiktoken_encode()(t) for t in texts]


def test_small_cache_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(tokenizer, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokenizer, "CACHE_BYTES", 2)
    e = PairIndexBPE(tokenizer.default_path())
    for text in ("one two three four five", "two three", "one", "five six seven one"):
        assert e.encode_batch([text, None]) == [reference(text), []]


def test_long_nulls_and_carried_columns(spark, reference):
    long = "word and another, " * 60_000
    df = spark.createDataFrame([(1, long, "a"), (2, None, None), (3, "", "b"), (None, "x", "c"), (1, "x", "d")], "k long, text string, tokens string")
    got = {(r.k, len(r.ids)) for r in tokenizer.encode(df, "k", "text").collect()}
    assert got == {(1, len(reference(long))), (2, 0), (3, 0), (None, 1), (1, 1)}
    counted = tokenizer.count_tokens(df.withColumnRenamed("tokens", "source"), "k", "text", ["source"])
    assert {(r.source, r.tokens) for r in counted.collect()} == {("a", len(reference(long))), (None, 0), ("b", 0), ("c", 1), ("d", 1)}


def test_empty_table(spark, empty_folder):
    assert queries.p8_ids(spark, empty_folder).count() == 0 and queries.p8_sizes(spark, empty_folder).count() == 0
