"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lapse.llm.common import staged
from lapse.llm.components import connected_components
from lapse.llm.simhash import (fingerprint, fingerprint_links, keep_one_per_component, simhash_components)


def slow_fingerprint(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "one", "One TWO", "a b c", "a b c a b c a b c", "Ärger É Σ nbsp word \x1c x", "x y z " * 500])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=1000))
    monkeypatch.setattr("lapse.llm.simhash.CHUNK", 64)
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def _planted(seed, centres, around):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, around)):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cap", [64, 3])
def test_links_span_the_groups(spark, cap):
    """Small buckets pair by pair and large ones by shared neighbours find the same groups."""
    fps = _planted(5, 20, 30)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = fingerprint_links(df, bucket_cap=cap)
    assert links.where("bit_count(a ^ b) > 2").count() == 0
    got = dict(connected_components(links, "a", "b").collect())
    want = slow_components(fps)
    groups, same = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(want[i], set()).add(x)
        same.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, same.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(connected_components(df, "a", "b").collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, None), (8, ""), (None, "a b c d e f g"), (4, long),
            (2, long + " tail"), (3, "A b c d e f g"), (1, "quite another text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "component_id": F.lit(0)})
    got = sorted(simhash_components(df).collect(), key=str)
    assert len(got) == len(rows)
    comp = {(r.doc_id, r.fp): r.component_id for r in got}
    of = {i: {c for (d, _), c in comp.items() if d == i} for i in (5, 3, 9, 8, None, 1)}
    assert of == {5: {3}, 3: {3}, 9: {8}, 8: {8}, None: {3}, 1: {1}}
    near = (slow_fingerprint(long) ^ slow_fingerprint(long + " tail")).bit_count() <= 2
    assert {c for (d, _), c in comp.items() if d == 4} == ({2} if near else {4})
    kept = keep_one_per_component(df, staged(simhash_components(df), "components")).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(None) == 0 and sorted(ids) == sorted([1, 2, 3, 8] + ([] if near else [4]))  # a row without id is a copy like any other
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "component_id"}


def test_rows_are_dropped_by_id_and_text(spark):
    a, b, c = ("the first text of them all " * 9, "something else entirely said " * 9, "third and last of these texts " * 9)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, c), (4, c), (None, "alone " * 20), (5, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, keep_one_per_component(df, staged(simhash_components(df), "components")).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, c), (None, "alone " * 20), (5, None)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0
    assert keep_one_per_component(df, staged(simhash_components(df), "components")).count() == 0


def test_query_matches_brute_force(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    want = {(i, f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, slow_components(fps), strict=True)}
    assert {tuple(r) for r in E.queries()["op7_simhash_near_duplicates"](spark, sf).collect()} == want
