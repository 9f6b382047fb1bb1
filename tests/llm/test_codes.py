"""Vector codes against full integer distances in every round."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm import codes as C


def slow(rows, parts=8, entries=16, rounds=6, scale=4096):
    """[(id, label, code, error)], codebooks of vectors of one length."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(scale * c) for c in r[1]] for r in kept]
    n = len(x[0])
    at = [i * n // parts for i in range(parts + 1)]
    books = [[v[at[p] : at[p + 1]] for v in x[:entries]] for p in range(parts)]

    def nearest(v, p):
        part = v[at[p] : at[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for v in x:
            for p in range(parts):
                groups[p][nearest(v, p)[1]].append(v[at[p] : at[p + 1]])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else b for g, b in zip(gs, bs, strict=True)]
                 for gs, bs in zip(groups, books, strict=True)]
    out = []
    for r, v in zip(kept, x, strict=True):
        found = [nearest(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {"n": F.lit("x"), "v": F.lit(0), "near": F.lit(1), "tally": F.lit(2), "id": F.lit(3)})
    got, books = C.compress(df.repartition(3), keep=["label"], **args)
    assert got.columns == ["vec_id", "label", "code", "error"]
    return sorted((tuple(r) for r in got.collect()), key=str), {n: [b.tolist() for b in book] for n, book in books.items()}


def vectors(rng, n, dims=16, centres=6):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(middle)], rng.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = vectors(rng, 300)
    rows += [(1000 + i, rows[3][1], 7) for i in range(150)]  # a hot vector
    rows += [(i, [round(x) / 4 for x in rows[i][1]], 1) for i in range(0, 60, 2)]  # repeated ids, many equal distances
    rng.shuffle(rows)
    want, books = slow(rows)
    assert run(spark, rows) == (want, {16: books})


def test_few_and_odd_rows(spark):
    rows = [(3, [1.0, -0.5, 2.0], 1), (1, [0.5, 0.25, 9.0], None), (1, [0.5, 0.25, 9.0], None), (None, [0.0, 0.0, -1e-9], 1), (4, None, 2),
            (5, [None, 1.0, 1.0], 2), (6, [float("nan"), 1.0, 1.0], 2), (7, [float("inf"), 0.0, 0.0], 2), (8, [-0.0, 300.0, 1e5], 3)]
    want, books = slow(rows)
    assert run(spark, rows) == (want, {3: books})
    assert run(spark, rows, rounds=0) == (lambda x: (x[0], {3: x[1]}))(slow(rows, rounds=0))
    assert run(spark, []) == ([], {}) and run(spark, [(4, None, 2)]) == ([], {})
    mixed = rows + [(i, [float(i), 1.0], i) for i in range(20, 24)] + [(30, [], 1)]
    got, by_length = run(spark, mixed)
    short, short_books = slow([r for r in mixed if r[1] and len(r[1]) == 2])
    assert got == sorted([*want, *short, (30, 1, "00" * 8, 0)], key=str)
    assert by_length[3] == books and by_length[2] == short_books and set(by_length) == {0, 2, 3}
    with pytest.raises(OverflowError, match="64 bits"):
        run(spark, [(1, [1e12, 1.0], 1)])
    with pytest.raises(ValueError, match="names of the result"):
        C.compress(spark.range(1), id_col="error")


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold(seed):
    """Every lower bound stays below its distance whatever b does, and most
    rows need no distance but their own."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.integers(-3000, 3000, (12, 1, 4)) + rng.integers(-200, 200, (12, 60, 4))]).reshape(-1, 4)
    entries = x[rng.choice(len(x), 16, replace=False)]
    bounds, needs, sizes = C.Bounds.unknown(len(x), 4), [], [4, 2, 8, 3, 5, 2]
    for b in sizes:
        bounds = bounds.resized(b)
        best, needed = bounds.assign(x, entries)
        exact = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (best == exact.min(1)).all() and (bounds.near[:, 0] == exact.argmin(1)).all()
        true = np.sqrt(exact.astype(float))
        for j in range(b):
            there = bounds.near[:, j] != C.NONE
            assert (bounds.low[there, j] <= true[there, bounds.near[there, j]]).all()
        for row in range(len(x)):
            rest = np.setdiff1d(np.arange(16), bounds.near[row])
            assert bounds.outer[row] <= true[row, rest].min(initial=np.inf)
        needs.append(needed)
        moved = entries + rng.integers(-15, 16, entries.shape)
        bounds.moved(np.sqrt(((moved - entries) ** 2).sum(1)) * (1 + 1e-9))
        entries = moved
    assert (needs[0] == 4).all() and (needs[1] == 0).mean() > 0.5


def test_b_follows_the_needs():
    assert C._next_b({0: 90, 4: 10}, 4, 16) == 8 and C._next_b({0: 90, 8: 10}, 8, 16) == 8
    assert C._next_b({0: 1000, 1: 5}, 4, 16) == 2 and C._next_b({0: 900, 1: 50, 2: 50}, 4, 16) == 3


def test_digest():
    assert C.codebooks_sha256({2: [np.array([[1], [-2]]), np.array([[3], [4]])]}) == hashlib.sha256(b"1,-2,3,4").hexdigest()
