"""Nearest neighbours against every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm import neighbours as N


def slow(rows, is_query, k):
    """{(query_id, vector): [(score, id)]}, best first."""
    ok = [(i, tuple(x + 0.0 for x in v)) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def cosine(a, b):
        big_a, big_b = max(map(abs, a)), max(map(abs, b))
        a, b = [x / big_a for x in a], [x / big_b for x in b]
        return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    out = {}
    for q, a in {r for r in ok if is_query(r[0])}:
        found = [(-round(cosine(a, b), 9), i) for i, b in ok if i != q and len(a) == len(b)]
        out[q, a] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def run(spark, rows, every, k, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"id": F.lit("x"), "v": F.lit(0), "cell": F.lit(1), "rank": F.lit(2), "n": F.lit(3), "p": F.lit(4)})
    got = N.nearest(df.repartition(3), lambda c: F.col(c) % every == 0, k, **args)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.dtypes[1] == ("rank", "int")
    out = {}
    for r in sorted(got.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def flat(want):
    return {q: found for (q, _), found in want.items() if found}


def rows_of(rng, n, dims=24):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_exact_when_certain(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = rows_of(rng, 500)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(90)]  # ties, more than k
    rows += [rows[0], rows[1], rows[1]]
    monkeypatch.setattr(N, "CELL_ROWS", 16)  # several slices
    monkeypatch.setattr(N, "SHARD", 4)
    monkeypatch.setattr(N, "MIN_CELLS", 4)
    monkeypatch.setattr(N, "MAX_CELLS", 8)
    assert run(spark, rows, 20, 5, certainty=1.0) == flat(slow(rows, lambda i: i % 20 == 0, 5))


def test_recall_and_order(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 3000)
    want, got = flat(slow(rows, lambda i: i % 50 == 0, 5)), run(spark, rows, 50, 5)
    assert got.keys() == want.keys() and all(len(f) == 5 for f in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    cosine = {(q, i): s for q, found in want.items() for i, s in found}
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(cosine.get((q, i), s) - s) < 1e-8 for i, s in found)


def test_odd_rows(spark):
    rows = [(0, [1.0, -0.5]), (1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (6, [0.5, 0.25]), (6, [0.5, 0.25]), (None, [1.0, 1.0]), (100, [2.0, -1.0]), (7, [1.0, 2.0, 3.0]), (200, [4.0, 1.0, 1.0]),
            (8, []), (300, []), (9, [0.0, 0.0]), (400, [0.0, -0.0]), (10, [-1e-300, 1e-300]), (11, [1e300, 1e300]), (500, [3.0])]
    assert run(spark, rows, 100, 3) == flat(slow(rows, lambda i: i % 100 == 0, 3))
    assert run(spark, [], 100, 3) == {} and run(spark, [(1, [1.0])], 100, 3) == {} and run(spark, [(0, [1.0])], 100, 3) == {}
    with pytest.raises(ValueError, match="even"):
        N.nearest(spark.range(1), lambda c: F.col(c) == 0, dimensions=7)


def test_two_vectors_under_one_query_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = run(spark, rows, 100, 1)
    assert sorted(i for i, _ in got[0]) == [1, 2]


def test_stopping_test():
    assert abs(N.chi_square_bound(0.95, 8) - 15.507) < 1e-3 and abs(N.chi_square_bound(0.99, 2) - 9.210) < 1e-3
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((40, 32))
    x = (middle[:, None] + 0.15 * rng.standard_normal((40, 60, 32))).reshape(-1, 32)
    units = x / np.linalg.norm(x, axis=1)[:, None]
    p = N.Projection(8)(units)
    cell = N.Cell(np.arange(len(x)), x, p, N.chi_square_bound(0.95, 8))
    for q in range(0, len(x), 60):
        found = cell.search(q, x[q], np.linalg.norm(x[q]), p[q], 5, np.inf)
        assert len(found) == 5
    assert cell.verified < 0.3 * len(x) * 40  # the test ends the search early


def test_split_keeps_equal_points_together():
    points = np.array([[0.0, 0.0]] * 50 + [[1.0, 0.0]] * 3 + [[1.0, 2.0]] * 3)
    cell = N.cell_of(N.split(points, 8), points)
    assert len(set(cell[:50])) == 1 and len(set(cell)) == 3
    assert set(N.cell_of(N.split(np.zeros((0, 2)), 4), points)) == {0}
