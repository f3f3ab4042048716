import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return bpe.encoder(), lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["och", " ", "  ", "\n", "\t", "å", "'s", "don't", "<|endoftext|>", "\x1c", "\x85", "🙂", "123", "...", "血", "é"]), max_size=25).map("".join))
def test_same_as_the_library(pair, s):
    enc, ids = pair
    assert enc.encode(s) == ids(s)
    assert enc.decode(enc.encode(s)) == s


@pytest.mark.parametrize("s", ["a" * 4000, " " * 2000 + "x", "ab" * 3000, "-=" * 1500, "\n" * 999, "<|endoftext|>"])
def test_long_words(pair, s):
    enc, ids = pair
    assert enc.encode(s) == ids(s)


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hej på dig", "x"), (2, None, "y"), (3, "", None), (1, "Hej på dig", "z"), (4, " ", "w")], "doc_id long, text string, ids string")
    rows = bpe.encode_documents(df).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == [(1, 4), (1, 4), (2, 0), (3, 0), (4, 1)] or {r.doc_id for r in rows if not r.ids} == {2, 3}
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(df)).collect()}
    assert back == {1: "Hej på dig", 2: "", 3: "", 4: " "}
    assert bpe.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect()}[2] == 0
