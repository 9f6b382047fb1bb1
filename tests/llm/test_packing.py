"""Packing: tokens against the tokenizers library, windows against a plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lapse.llm.bpe import bpe_ids
from lapse.llm.packing import best_fit_decreasing, default_tokenizer, pack_documents


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_ids_are_the_library_s(library):
    encode = bpe_ids(*default_tokenizer()).encode
    rng = random.Random(3)
    texts = ["", " ", "a  b", " a", "a ", "\n\na \n b", "it's don''t !'s", "x\x1cy z", "日本 語", "“q” — é œ",
             "<|endoftext|> hi", "tab\t\tx \t y", "x\x85 y", "nb\xa0sp \xa0x", "a b c", "word " * 400, "😀 ok"]
    texts += ["".join(rng.choices(" \n\t'sétd.,12aB \x1f—«", k=rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library(t), t


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 100, 1024])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 400))]
    placed, windows = best_fit_decreasing(lengths, size)
    room: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(size - lengths[i])
    assert windows == len(room)
    filled: dict[int, list] = {}
    for n, (w, at) in zip(lengths, placed, strict=True):
        filled.setdefault(w, []).append((at, n))
    assert sorted(size - sum(n for _, n in p) for p in filled.values()) == sorted(room)
    for pieces in filled.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n


def check(rows, texts, library, size):
    """Every id in one piece, sequences gapless; returns the sequences' lengths."""
    for key, text in texts:
        ids = library(text) + [0]
        mine = sorted((r for r in rows if r.doc_id == key and r.doc_tokens == len(ids)), key=lambda r: r.start)
        covered = {}
        for r in mine:
            covered.setdefault(r.start, r)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length]
        end = 0
        for start in sorted(covered):
            assert start == end
            end += covered[start].length
        assert end == len(ids)
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in filled.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= size
    return [sum(n for _, n in p) for p in filled.values()]


def test_documents(spark, library):
    texts = [(1, "hello world"), (2, None), (3, ""), (None, "no id"), (4, "long text " * 700), (5, "hello world"), (5, "hello world")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"ids": F.lit(1), "start": F.lit("x"), "length": F.lit(0)})
    rows = pack_documents(df, max_tokens=64).collect()
    check(rows, texts, library, 64)
    assert sum(r.length for r in rows) == sum(len(library(t)) + 1 for _, t in texts)
    small = pack_documents(df, max_tokens=64, chunk_bytes=100).collect()
    check(small, texts, library, 64)
    assert sum(r.length for r in small) == sum(r.length for r in rows)
    assert pack_documents(df.limit(0)).count() == 0


def test_query(spark, library):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = E.queries()["op10_best_fit_packing"](spark, sf).collect()
    for r in rows:
        ids = library(texts[r.doc_id]) + [0]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    total = sum(len(library(t)) + 1 for t in texts.values())
    assert sum(r.length for r in rows) == total
    assert len({r.sequence_id for r in rows}) <= total / 1024 * 1.02 + 2
