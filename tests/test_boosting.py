"""Histogram boosting: the two ways to its sums, and its rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import boosting as BO


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.round(rng.exponential(size=n), 2)], axis=1)
    y = ((x[:, 0] + (x[:, 1] == 2) + rng.normal(0, 0.5, n)) > 0.5).astype(float)
    rows = [(*map(float, r), int(t), 1.5 if t else 0.75) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int, weight double").repartition(3)


def test_both_ways_make_the_same_trees(spark):
    df, p = frame(spark), BO.Params(rounds=4, max_bins=20, max_leaves=6, max_depth=4)
    one = BO.fit(df, ["a", "b", "c"], params=p)
    other = BO.fit(df, ["a", "b", "c"], params=p, local_rows=0)
    assert [vars(t) for t in one.trees] == [vars(t) for t in other.trees] and one.base == pytest.approx(other.base)
    assert all(t.feature.count(-1) <= 6 for t in one.trees) and any(t.feature.count(-1) > 2 for t in one.trees)
    again = BO.HistogramBooster.from_json(one.to_json())
    got = df.select(*"abc", one.probability(F.array(*"abc")).alias("p"), again.probability(F.array(*"abc")).alias("q")).collect()
    raw = one.raw(np.array([r[:3] for r in got]))
    assert all(r.p == r.q for r in got) and np.allclose([r.p for r in got], 1 / (1 + np.exp(-raw)))
    assert one.featureImportances.sum() == pytest.approx(1.0)


def test_scores_are_kept_between_rounds(spark, monkeypatch):
    monkeypatch.setattr(BO, "KEEP_ROUNDS", 2)
    df, p = frame(spark, 120), BO.Params(rounds=4, max_bins=8, max_depth=1, min_rows=5)
    one, other = (BO.fit(df, ["a", "b"], params=p, local_rows=n) for n in (1000, 0))
    assert [vars(t) for t in one.trees] == [vars(t) for t in other.trees]


def test_first_split_and_values():
    """One feature: gain, threshold and leaf values by hand."""
    x = np.arange(8.0)[:, None]
    y = np.array([0, 0, 0, 1, 1, 1, 1, 1.0])
    p = BO.Params(rounds=1, max_depth=1, min_rows=2, l2=0.1, learning_rate=0.5)
    trees, base = BO.fit_in_memory(x, y, np.ones(8), [np.arange(7.0)], p)
    prob = 5 / 8
    assert base == pytest.approx(np.log(prob / (1 - prob)))
    tree = trees[0]
    assert (tree.feature, tree.threshold[0], tree.rows) == ([0, -1, -1], 2.0, [8, 3, 5])
    h = prob * (1 - prob)
    assert tree.value[1] == pytest.approx(-0.5 * 3 * prob / (3 * h + 0.1), abs=1e-6)
    assert tree.value[2] == pytest.approx(0.5 * 5 * (1 - prob) / (5 * h + 0.1), abs=1e-6)


def test_few_rows_and_one_class(spark):
    df = frame(spark)
    assert BO.fit(df.limit(0), ["a"]).trees == []
    one = BO.fit(df.where("label = 1"), ["a", "b"], params=BO.Params(rounds=3))
    assert all(t.feature == [-1] for t in one.trees)
    few = BO.fit(df.limit(10), ["a"], params=BO.Params(rounds=3))
    assert all(t.feature == [-1] for t in few.trees)
    same = BO.fit(df.withColumn("k", F.lit(1.0)), ["k"], params=BO.Params(rounds=2))
    assert all(t.feature == [-1] for t in same.trees)


def test_bins_follow_values_or_quantiles(spark):
    df = spark.range(1000).select((F.col("id") % 5).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    for exact in (True, False):
        few, many = BO.bin_edges(df, ["few", "many"], 10, exact)
        assert few.tolist() == [0, 1, 2, 3] and len(many) == 9
        assert all(abs(e - 999 * (i + 1) / 10) < 2 for i, e in enumerate(many))


def test_a_level_is_split_at_once():
    """Splits of all nodes from one call equal those of each node alone."""
    rng = np.random.default_rng(3)
    hists = np.concatenate([rng.integers(-9, 9, (5, 3, 8, 1)) * BO.SCALE, rng.integers(1, 9, (5, 3, 8, 2)) * [BO.SCALE, 1]], axis=3)
    hists[4] = 0
    for p in (BO.Params(min_rows=1), BO.Params(min_rows=20)):
        found = BO.best_splits(hists, p)
        alone = [BO.best_splits(h[None], p)[0] for h in hists]
        assert [f and f[:3] for f in found] == [a and a[:3] for a in alone] and found[4] is None
        assert all(f[3].tolist() == hists[i, f[1], : f[2] + 1].sum(axis=0).tolist() for i, f in enumerate(found) if f)
    assert any(BO.best_splits(hists, BO.Params(min_rows=1)))


def test_rounds_take_no_jobs_of_their_own_up_to_two_million_rows(spark):
    """131,073 rows used to take a job per level and round."""
    rows = spark.range((1 << 17) + 1).select(
        (F.xxhash64("id") % 50).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        (F.xxhash64("id", F.lit(1)) % 2 == 0).cast("int").alias("label"), F.lit(1.0).alias("weight")).persist()
    rows.count()
    jobs = []
    for rounds in (1, 3):
        spark.sparkContext.setJobGroup(f"rounds-{rounds}", "")
        assert len(BO.fit(rows, ["a", "b"], params=BO.Params(rounds=rounds)).trees) == rounds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows.unpersist()
    assert 0 < jobs[1] <= jobs[0]


def test_only_the_smaller_child_is_read(monkeypatch):
    """A level used to read every row; now half of them at most, with the same trees."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (500, 3)).astype(float), rng.integers(0, 2, 500).astype(float)
    read, sums, depth = [], BO._sums, 4
    monkeypatch.setattr(BO, "_sums", lambda cells, g, h, *a: (read.append(len(g)), sums(cells, g, h, *a))[1])
    trees, _ = BO.fit_in_memory(x, y, np.ones(500), [np.arange(8.0)] * 3, BO.Params(rounds=1, max_depth=depth, min_rows=5))
    assert read[0] == 500 and sum(read) <= 500 + (depth - 1) * 250 and len(read) > depth
    at = BO._walk(trees[0], x, trees[0].threshold)
    assert all(trees[0].rows[leaf] == n for leaf, n in zip(*np.unique(at, return_counts=True), strict=True))


def test_features_summed_together_have_their_own_sums():
    rng = np.random.default_rng(6)
    widths = [5, 200, 3, 7, 1, 256]
    bins = np.stack([rng.integers(0, w, 300) for w in widths], axis=1).astype(np.uint8)
    g, h = rng.integers(-99, 99, (2, 300)).astype(float)
    bundles = BO._bundles(widths)
    assert sorted(f for some in bundles for f in some) == list(range(6)) and len(bundles) < 6
    got = BO._sums(BO._cells(bins, bundles, widths), g, h, bundles, widths)
    for f, w in enumerate(widths):
        for i, weights in enumerate((g, h, None)):
            assert got[f, :w, i].tolist() == np.bincount(bins[:, f], weights, w).tolist() and not got[f, w:].any()


def test_byte_columns_come_back_as_they_were():
    bins = np.random.default_rng(7).integers(0, 256, (20, 3)).astype(np.uint8)
    column = BO.byte_column(bins)
    assert (BO.byte_rows(column, 3) == bins).all() and column[4].as_py() == bins[4].tobytes()
    assert (BO.byte_rows(column.slice(5, 7), 3) == bins[5:12]).all()
