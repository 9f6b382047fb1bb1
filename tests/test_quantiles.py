"""The bracketed exact quantile equals Spark's ``percentile`` bit for bit,
including ties, missing values, one-row and all-missing groups."""

from pyspark.sql import functions as F

from lapse.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_matches_percentile_with_ties_and_gaps(spark):
    rows = [("a", float(i % 7)) for i in range(200)] + [("a", None), ("b", 3.5), ("c", None)]
    rows += [("d", v) for v in (1.0, 1.0, 1.0, 2.0, 1e9, -5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for acc in (10, 100000):  # a tiny sketch only widens the bracket
        got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))]
               for r in exact_quantiles(df, "x", PROBS, ["g"], accuracy=acc).collect()}
        want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("x", PROBS).alias("p")).collect()}
        assert set(got) == {"a", "b", "d"}  # an all-missing group has no rows to rank
        assert all(got[k] == want[k] for k in got)


def test_global_and_empty(spark):
    df = spark.range(0, 10001).select((F.col("id") * 0.37 % 101).alias("x"))
    got = exact_quantiles(df, "x", PROBS, accuracy=50).first()
    want = df.agg(F.percentile("x", PROBS).alias("p")).first()["p"]
    assert [got[f"q{i}"] for i in range(len(PROBS))] == want
    empty = exact_quantiles(df.where("x < 0"), "x", [0.5]).first()
    assert empty["n"] == 0 and empty["q0"] is None


def test_narrowing_rounds_with_ties_and_a_hot_group(spark):
    hot = spark.range(0, 60000).select(F.lit("hot").alias("g"), F.sin(F.col("id")).alias("x"))
    tied = spark.range(0, 30000).select(F.lit("tied").alias("g"), F.when(F.col("id") % 10 < 8, 5.0).otherwise(F.col("id") * 1.0).alias("x"))
    gone = spark.range(0, 20000).select(F.lit(None).cast("string").alias("g"), F.log1p("id").alias("x"))
    df = hot.union(tied).union(gone).union(spark.createDataFrame([("one", 2.5)], "g string, x double"))
    # brackets of 6 n / 60 rows: 6,000 in the hot group, so narrowing has to run
    got = {r["g"]: [r["n"], *[r[f"q{i}"] for i in range(len(PROBS))]]
           for r in exact_quantiles(df, "x", PROBS, ["g"], accuracy=60, ranked=1024).collect()}
    want = {r["g"]: [r["n"], *r["p"]] for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", PROBS).alias("p")).collect()}
    assert got == want
    alone = exact_quantiles(hot, "x", PROBS, accuracy=60, ranked=1024).first()
    assert [alone[f"q{i}"] for i in range(len(PROBS))] == want["hot"][1:]
