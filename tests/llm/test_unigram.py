"""Unigram token counts against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from lapse.llm.unigram import PieceCounter, default_model, read_vocabulary, token_counts

TIES = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bb", -1.5), ("aa", -2.0),
        ("abab", -4.0), ("bab", -2.9999999999999996)]


def library(vocabulary, byte_fallback):
    low = min(s for _, s in vocabulary)
    all_pieces = [("<unk>", low), *vocabulary] + ([(f"<0x{i:02X}>", low) for i in range(256)] if byte_fallback else [])
    t = Tokenizer(models.Unigram(all_pieces, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda s: len(t.encode(s or "").ids)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(default_model())


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_random_texts(vocabulary, byte_fallback):
    rng = random.Random(1)
    for pieces, letters in ((vocabulary, "ab é日\n▁ \tthe😀ing𝒜"), (TIES, "abab c"), (TIES, "ab")):
        counter, slow = PieceCounter(pieces, byte_fallback), library(pieces, byte_fallback)
        for _ in range(1500):
            text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
            assert counter.count(text) == slow(text), text


def test_cache_starts_anew(monkeypatch, vocabulary):
    monkeypatch.setattr("lapse.llm.unigram.CACHE_ENTRIES", 5)
    counter, slow = PieceCounter(vocabulary, True), library(vocabulary, True)
    text = "the quick brown fox jumps over the lazy dog again and again " + "x" * 500
    assert counter.count(text) == slow(text) and len(counter) <= 5


def test_documents(spark, vocabulary):
    slow = library(vocabulary, True)
    rows = [(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "no id"), (4, "long text " * 20000), (5, "y" * 5000), (6, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS __t")
    got = sorted(map(tuple, token_counts(df).collect()), key=str)
    assert got == sorted(((i, slow(t)) for i, t in rows), key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_no_vocabulary():
    assert PieceCounter([], True).count("é a") == len("▁é▁a".encode())
    assert PieceCounter([], False).count("é a") == 2


def test_query(spark, vocabulary):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    slow = library(vocabulary, True)
    want = {(r.doc_id, slow(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {tuple(r) for r in E.queries()["op3_unigram_token_counts"](spark, sf).collect()} == want
