"""Filter orders against a plain loop over documents."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lapse.llm.audit import LETTERS, audit_filters, text_mask

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def slow_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words),
             100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return sum(1 << i for i, f in enumerate(fails) if f)


def slow(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)
        rows.append((i, source or "", slow_mask(text) | 16 * copy))
    out = []
    for part in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == part]
        for order in itertools.permutations(range(5)):
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << f
                fails = [r for r in mine if r[2] & bit]
                removed = [r for r in fails if not r[2] & before]
                out.append((part, "".join(LETTERS[x] for x in order), step, sum(not r[2] & (before | bit) for r in mine),
                            len(removed), len(fails) - len(removed), sum(r[2] == bit for r in mine),
                            sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)))
                before |= bit
    total = {}
    for r in out:
        key = (r[0], r[1][r[2] - 1])
        total[key] = total.get(key, 0) + r[4]
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, DOCS).withColumns(
        {"id": F.lit("x"), "mask": F.lit(3), "n": F.lit(4), "good": F.lit(5), "part": F.lit("p"), "digest": F.lit(0)})
    x = spark.createDataFrame(labels, LABELS).withColumns({"good": F.lit(7), "source": F.lit("z"), "n": F.lit(1)})
    got = audit_filters(d, x)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in got.collect())


def texts(rng):
    words = ["w%d" % i for i in range(600)]
    plain = " ".join(rng.choices(words, k=rng.choice([20, 199, 200, 300])))
    return rng.choice([plain, plain.upper(), plain + " #1", " ".join(rng.choices(words[:40], k=250)), "", "ÄÖ " * 210, "copy " * 250])


def test_random(spark):
    rng = random.Random(5)
    pool = [texts(rng) for _ in range(25)]
    docs = [(i, rng.choice(pool), rng.choice(["a", "a", "a", "b", None, ""])) for i in range(150)]
    docs += [(1000 + i, pool[0], "a") for i in range(100)]  # a hot text
    rng.shuffle(docs)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(120)]
    assert run(spark, docs, labels) == slow(docs, labels)


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", "a"), (3, " \t\n\x0b\x0c\r", "a"), (None, "same", "a"), (None, "same", "a"), (4, "same", "a"),
            (4, "same", "a"), (4, "same", "b"), (4, "other |", "a"), (5, "same", "b"), (6, "x y z " * 200, "a"), (-7, "same", "c"),
            (8, "A", "a"), (9, "Aé" * 25, "a"), (9, "w " * 200_000, "a")]
    labels = [(5, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (4, 1, None), (99, 1, 1), (8, 2, 1)]
    assert run(spark, docs, labels) == slow(docs, labels)
    assert run(spark, docs, []) == slow(docs, [])
    assert run(spark, [], labels) == []


@pytest.mark.parametrize("text", ["", " ", "a b\u0085c d", "A" * 3 + "b" * 147, "A" * 3 + "ü" * 147, "one\x1ctwo", "　", "50% off"])
def test_mask(text):
    assert text_mask(text.encode()) == slow_mask(text)


def test_many_parts(spark):
    """More rows of the recursion than the session allows by default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        docs = [(i, "t", f"s{i}") for i in range(20)]
        assert len(run(spark, docs, [])) == 20 * 600
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
