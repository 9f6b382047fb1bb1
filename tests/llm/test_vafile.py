"""Exact top-k against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lapse.llm import vafile
from lapse.llm.vafile import top_k


def slow(rows, is_query, k, scale=1024):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    ints = sorted((i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and ok(v))
    out = []
    for q, a in sorted(set(ints)):
        if is_query(q):
            found = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ints if i != q and len(a) == len(b)]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, rows, every, k, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"id": F.lit("x"), "v": F.lit(0), "cells": F.lit(1), "rank": F.lit(2), "score": F.lit(3)})
    got = top_k(df, lambda c: F.col(c) % every == 0, k, **args)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [rows[1], rows[1], rows[5], rows[20]]  # repeated rows are rows
    assert run(spark, rows, 20, 10) == slow(rows, lambda i: i % 20 == 0, 10)
    assert run(spark, rows, 20, 10, query_block=3) == slow(rows, lambda i: i % 20 == 0, 10)


def test_odd_rows(spark):
    rows = [(0, [1.0, -0.5]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (6, [0.5, 0.25]), (6, [0.5, 0.25]), (None, [1.0, 1.0]), (100, [1.0, -0.5]), (100, [0.0, 2.0]), (7, [1.0, 2.0, 3.0]),
            (200, [4.0, 1.0, 1.0]), (8, []), (300, []), (9, [-1e-9, 0.0])]
    assert run(spark, rows, 100, 3) == slow(rows, lambda i: i % 100 == 0, 3)
    assert run(spark, [], 100, 3) == [] and run(spark, [(1, [1.0])], 100, 3) == []


def test_sums_beyond_doubles(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**22, 3 / 1024]), (2, [2.0**22, 1 / 1024]), (3, [2.0**22, 2 / 1024])]
    assert run(spark, rows, 100, 2) == slow(rows, lambda i: i == 0, 2)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2.0**40]), (1, [2.0**40])], 100, 1)


def test_cells_alone_leave_few_exact_vectors(spark, monkeypatch):
    """The first phase reads no exact vector, the second one those of few rows."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)]) for i in range(6000)]
    read, seen = [], []
    scan, reach = vafile._scan, vafile.surviving_rows

    def counted(rows, queries, k):
        read.append(rows.count())
        return scan(rows, queries, k)

    def planned(cells, queries):
        seen.append(cells._jdf.queryExecution().executedPlan().toString())
        return reach(cells, queries)

    monkeypatch.setattr(vafile, "_scan", counted)
    monkeypatch.setattr(vafile, "surviving_rows", planned)
    assert run(spark, rows, 1500, 5) == slow(rows, lambda i: i % 1500 == 0, 5)
    assert len(read) == 1 and 20 <= read[0] < 600
    assert "ReadSchema: struct<row:bigint,id:bigint,cells:binary>" in seen[0]
