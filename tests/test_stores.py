"""Versioned models, the bucketed lookup store, cleaning in one read."""

import uuid

import pytest
from pyspark.sql import functions as F

from lapse.operators import cleaning as S
from lapse.operators import models as MD
from lapse.operators import ranking as T
from lapse.plans.q_prep import CLEAN_PLAN, RAW_SPEC, raw_customers
from lapse.sources import versions as V
from lapse.sources.frames import PROFILE_SPEC as PS
from lapse.sources.frames import customer_profile
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    return MD.train(customer_profile(spark, SF_SMALL), PS, names=["LogisticRegression"], cv=False)[0]


def test_versions_are_published_whole(spark, trained, tmp_dir, monkeypatch):
    path = tmp_dir + "/m"
    with pytest.raises(FileNotFoundError):
        MD.TrainedModel.load(path)
    first, before = trained.save(path), trained.threshold

    def dies(self, spark, path):
        spark.range(1).write.parquet(path + "/half")
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(MD.TrainedModel, "_write", dies)
        with pytest.raises(OSError, match="lost"):
            trained.save(path)
    assert V.published(spark, path) == [first] and MD.TrainedModel.load(path).threshold == before
    trained.threshold = 0.125
    try:
        last = trained.save(path)
    finally:
        trained.threshold = before
    assert first < last
    assert MD.TrainedModel.load(path).threshold == 0.125 and MD.TrainedModel.load(path, first).threshold == before
    with pytest.raises(FileNotFoundError, match="v-7"):
        MD.TrainedModel.load(path, "v-7")
    assert V.prune(spark, path) == [first] and V.published(spark, path) == [last]
    assert trained.save(path) > last and len(V.published(spark, path)) == 2


def test_writers_at_the_same_time(spark, trained, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor

    path = tmp_dir + "/c"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: V.start(spark, path), range(8)))
        assert len(set(got)) == 8
        list(pool.map(lambda v: V.publish(spark, path, v), got))
    assert V.published(spark, path) == sorted(got) and V.latest(spark, path).endswith(max(got))


@pytest.fixture
def store(spark, tmp_dir):
    table = "store_" + uuid.uuid4().hex
    rows = [(f"id{i}" if i % 2 else f" \tID{i}\n", i) for i in range(2000)] + [(None, -1), ("id7", -7), ("", -8)]
    base = spark.createDataFrame(rows, "customer_id string, n int").withColumn("_key", F.lit("x"))
    T.write_lookup_store(base, PS, table, 8, tmp_dir + "/store")
    yield base, table
    spark.sql(f"DROP TABLE {table}")


def test_store_finds_what_the_lookup_finds(spark, store):
    base, table = store
    for ids in (["ID7 ", "id10", "no", None], [], [None], ["", "\nid1999"]):
        got, want = T.lookup_store(spark, table, ids), T.lookup_ids(base, PS, ids)
        assert got.columns == base.columns
        assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect())
    asked = spark.createDataFrame([(" Id7\t",), ("id10",), ("id10",), (None,), ("no",)], "customer_id string")
    got, want = T.lookup_store(spark, table, asked), T.lookup_ids(base, PS, asked)
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in want.collect()) == [-7, 7, 10]


def test_store_plans_read_little_and_move_no_base(spark, store):
    _, table = store
    listed = T.lookup_store(spark, table, ["id10"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in listed.toString() and "EqualTo(__lookup_key,ID10)" in listed.toString()
    scan = listed.collectLeaves().apply(0)
    assert scan.optionalBucketSet().get().cardinality() == 1
    asked = spark.createDataFrame([("id10",)], "a string")
    joined = T.lookup_store(spark, table, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Bucketed: true" in joined
    assert joined.count("Exchange hashpartitioning(__lookup_key") == joined.count("Exchange hashpartitioning") > 0


def test_cleaning_and_its_counters_in_one_read(spark, tmp_dir):
    raw = raw_customers(spark, SF_SMALL)
    rows, seen = S.clean_observed(raw, RAW_SPEC, CLEAN_PLAN)
    rows.write.parquet(tmp_dir + "/clean")
    assert seen.get == S.clean_report(raw, RAW_SPEC, CLEAN_PLAN).first().asDict()
    want = S.clean(raw, RAW_SPEC, CLEAN_PLAN)
    got = spark.read.parquet(tmp_dir + "/clean")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1


def test_observed_counters_of_odd_tables(spark, tmp_dir):
    raw = raw_customers(spark, SF_SMALL)
    for n, part in enumerate((raw.limit(0), raw.withColumn("total_raw", F.lit(" ")).withColumn("tenure", F.lit(3)))):
        rows, seen = S.clean_observed(part, RAW_SPEC, CLEAN_PLAN)
        rows.write.parquet(f"{tmp_dir}/odd{n}")
        assert seen.get == S.clean_report(part, RAW_SPEC, CLEAN_PLAN).first().asDict()
    bad = raw.withColumn("flag", F.lit(None).cast("long"))
    rows, _ = S.clean_observed(bad, RAW_SPEC, CLEAN_PLAN)
    with pytest.raises(Exception, match="flag is missing"):
        rows.write.parquet(tmp_dir + "/bad")
