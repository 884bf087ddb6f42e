"""Prefix counts against the library's encoding of every prefix."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import documents, empty, frame, odd, odd_rows  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobsift.llm import tokencount
from jobsift.llm.wordcode import read_json

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, LIBRARY = tokencount.PrefixCounter(read_json(PATH)), Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def prefixes(text):
    return [library(text[:i]) for i in range(1, len(text) + 1)]


PIECES = [
    "a", "the", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", " 's", "1", "23", "!", "--", "_", "é", "日本", "😀", "\xa0", "\x1c", "²", "Ⅷ", "٣",
    "<|endoftext|>", "<|", "|>", "İ", "ǅ", "　", "\x85", " ", "ª", "​", "́", "᠎", " ", "tokenization", "Eauouon", "ſ", "\x00",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=30))
def test_every_prefix(text):
    assert np.cumsum(COUNTER.steps(text)).tolist() == prefixes(text)


def test_supplied_documents(documents):  # noqa: F811
    for _, text, *_ in documents:
        assert COUNTER.steps(text or "").sum() == library(text or "")


def test_small_memo_and_parts(monkeypatch, documents):  # noqa: F811
    monkeypatch.setattr(tokencount, "SEGMENT", 200)
    small = tokencount.PrefixCounter(read_json(PATH))
    for memo in (small.pairs, small.pieces, small.units, small.chunks):
        memo.size = 5
    for _, text, *_ in documents[:40]:
        assert (small.steps(text) == COUNTER.steps(text)).all()


@pytest.mark.parametrize("text", ["x" * 100_000, "-" * 20_000, "\n" * 50_000, "a b " * 100_000, "é" * 50_000, "' " * 30_000])
def test_long_pieces(text):
    assert COUNTER.steps(text).sum() == library(text)


def test_answers_from_stored_counts(spark, documents):  # noqa: F811
    rows = [r for r in documents if r[1] and len(r[1]) < 700][:12] + [(10**6, "shrinks: " + "-" * 40 + " end", "en", "a"), (10**6 + 1, "", "en", "a")]
    counts = tokencount.prefix_counts(frame(spark, rows), PATH, block=64)
    asked = [-1, 0, 1, 63, 64, 65, 200, 10**7]
    found = counts.select(
        "doc_id", *[tokencount.tokens_at(F.lit(n), block=64).alias(f"at{n}") for n in asked],
        *[tokencount.longest_within(n, block=64).alias(f"in{n}") for n in (0, 1, 30, 10**6)],
    )
    found = {r["doc_id"]: r for r in found.collect()}
    for i, text, *_ in rows:
        each = [0, *prefixes(text)]
        assert [found[i][f"at{n}"] for n in asked] == [each[max(0, min(n, len(text)))] for n in asked]
        assert [found[i][f"in{n}"] for n in (0, 1, 30, 10**6)] == [max(k for k, c in enumerate(each) if c <= n) for n in (0, 1, 30, 10**6)]


def test_odd_tables(spark, odd, empty):  # noqa: F811
    found = tokencount.prefix_counts(odd, PATH).select("doc_id", "n_bytes", "n_tokens").collect()
    expected = [(i, len((t or "").encode()), library(t or "")) for i, t, *_ in odd_rows()]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert tokencount.prefix_counts(empty, PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokencount.PrefixCounter(read_json(public_tokenizers.path("word_bpe_49k.json")))
