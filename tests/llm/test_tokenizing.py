import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxframe.llm import tokenizing
from voxframe.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return tokenizing.load_encoder(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_perfect_hash(encoder):
    table = encoder.whole
    keys = [t for t in table.tokens]
    assert None not in keys and len(set(keys)) == len(table.values)
    assert table.lookup(keys) == table.values.tolist()
    assert table.lookup([b"\xff\xfe no such token", b""]) == [-1, -1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_like_the_public_tokenizer(encoder, reference, texts):
    assert encoder.encode_batch(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_special_and_long(encoder, reference):
    texts = ["<|endoftext|> x", "a" * 50_000, "日本語" * 400, "word" * 3000, "x́‍🙂"]
    assert encoder.encode_batch(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_batch([None, ""]) == [[], []]


def test_round_trip_of_a_table(spark, tiny, reference):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokenizing.encode(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (reference.encode(r.text, add_special_tokens=False).ids if r.text else [])
