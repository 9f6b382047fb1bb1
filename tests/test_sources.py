"""CSV lines that do not fit, nested bad numbers, lookups by any white space."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lapse.operators import quality as QC
from lapse.operators.ranking import lookup_ids
from lapse.sources.frames import PROFILE_SPEC
from lapse.sources.tables import read_csv, read_csv_checked

SCHEMA = "id long, name string, price double"


def test_lines_are_kept_or_quarantined(spark, tmp_dir):
    good = ["1,a,1.5", "2,,", "3,\"x,y\",2"]
    bad = ["4,b,1.5,extra", "5,c", "six,d,1", "7,e,cheap"]
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w") as f:
        f.write("\n".join(["id,name,price", *good[:2], *bad, good[2]]) + "\n")
    rows, quarantine = read_csv_checked(spark, path, SCHEMA)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3] and rows.columns == ["id", "name", "price"]
    assert sorted(r.line for r in quarantine.collect()) == sorted(bad)
    assert rows.count() + quarantine.count() == 7 and rows.select("name").count() == 3
    with pytest.raises(Exception):
        read_csv(spark, path, SCHEMA).collect()
    assert read_csv(spark, path, SCHEMA, bad_lines="null").count() == 7


def test_bad_numbers_at_every_depth(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, nan, (1.0, [inf, None]), {"a": nan, "b": 1.0}, [[1.0], [2.0, -inf]], "text"), (2, 1.0, None, None, None, None),
            (3, None, (None, []), {}, [None, [nan]], "")]
    df = spark.createDataFrame(rows, "k int, x double, s struct<f:float,l:array<double>>, m map<string,double>, ll array<array<double>>, t string")
    got = sorted(tuple(r) for r in QC.bad_numbers(df, keep=["k"]).collect())
    assert got == [(1, "$.ll[1][1]"), (1, "$.m.a"), (1, "$.s.l[0]"), (1, "$.x"), (3, "$.ll[1][0]")]
    assert QC.bad_numbers(df.select("k", "t"), keep=["k"]).count() == 0
    assert QC.bad_numbers(df.limit(0), keep=["k"]).count() == 0


def test_bad_numbers_in_variants(spark):
    df = spark.range(3).select("id", F.to_variant_object(F.struct(F.when(F.col("id") == 1, F.lit(math.nan)).otherwise(1.0).alias("a"))).alias("v"))
    assert [tuple(r) for r in QC.bad_numbers(df, keep=["id"]).collect()] == [(1, "$.v.a")]
    assert QC.bad_numbers(df.select("id", F.lit(None).cast("variant").alias("v")), keep=["id"]).count() == 0


def test_lookup_has_one_rule_for_white_space(spark):
    df = spark.createDataFrame([("A1",), (" b2\t",), (None,)], "customer_id string")
    asked = ["\ta1\n", "B2", "c3", None]
    table = spark.createDataFrame([(i,) for i in asked], "id string")
    for ids in (asked, table):
        assert sorted(r.customer_id.strip() for r in lookup_ids(df, PROFILE_SPEC, ids).collect()) == ["A1", "b2"]
    assert lookup_ids(df, PROFILE_SPEC, []).count() == 0
