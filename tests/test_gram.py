"""Wide correlations against the pairwise expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import gram as GR
from lapse.operators.aggregates import correlation_matrix
from lapse.spec import SpecError


def as_dict(df):
    return {(r.col1, r.col2): r.r for r in df.collect()}


def test_equal_to_the_pairwise_form(spark, monkeypatch):
    monkeypatch.setattr(GR, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 1e6
    gaps = rng.random(x.shape) < 0.3
    rows = [[None if g else float(v) for v, g in zip(r, m, strict=True)] for r, m in zip(x, gaps, strict=True)]
    names = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    df = df.withColumns({"same": F.lit(7), "none": F.lit(None).cast("double"),
                         "half": F.when(F.col("a") > 1e6, 3.0)})  # constant wherever present
    names += ["same", "none", "half"]
    got, want = as_dict(GR.wide_correlations(df, names, None)), as_dict(correlation_matrix(df, names, digits=None))
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None), k
        assert r is None or got[k] == pytest.approx(r, abs=1e-7), k


def test_missing_values_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (nan, 9.0), (3.0, inf), (4.0, 7.0), (None, 1.0)], "x double, y double")
    clean = df.where("not isnan(x) and y < double('infinity') and x is not null")
    assert as_dict(GR.wide_correlations(df, ["x", "y"], 8))["x", "y"] == as_dict(correlation_matrix(clean, ["x", "y"], digits=8))["x", "y"]
    none = as_dict(GR.wide_correlations(df.where("y < -1"), ["x", "y"]))
    assert set(none.values()) <= {None}
    with pytest.raises(SpecError):
        GR.wide_correlations(df.withColumn("t", F.lit("a")), ["x", "t"])


def test_components_of_other_sizes_take_no_part(spark):
    rows = [([1.0, 2.0],), ([2.0, 1.0],), ([3.0, 5.0],), ([9.0],), (None,), ([None, 4.0],)]
    got = as_dict(GR.component_correlations(spark.createDataFrame(rows, "v array<double>"), "v", 2, None))
    assert got["0", "1"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1]) and got["0", "0"] == pytest.approx(1)


def test_five_hundred_columns_in_one_plan(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 500))
    x[:, 1] = x[:, 0] * 2
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = GR.component_correlations(df, "v", 500, None)
    assert got.count() == 250_000
    near = as_dict(got.where("col1 < '12' and col2 in ('0', '1', '499')"))
    want = np.corrcoef(x.T)
    assert near["0", "1"] == pytest.approx(1) and near["1", "499"] == pytest.approx(want[1, 499])
