import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urkunde.llm import common


def test_local_masters():
    assert not common.not_local("local") and not common.not_local("local[8]") and not common.not_local("local[*]")
    assert common.not_local("local-cluster[3,2,1024]") and common.not_local("spark://host:7077") and common.not_local("yarn")


def test_may_have_misses_nothing(spark, monkeypatch):
    rows = spark.range(3000).withColumn("k", F.col("id").cast("string"))
    some = spark.range(0, 3000, 50).select(F.col("id").cast("string").alias("x"))
    got = {r.id for r in common.may_have(rows, F.col("k"), F.col("x"), some).filter("may").collect()}
    assert got >= set(range(0, 3000, 50)) and len(got) < 70
    monkeypatch.setattr(common, "FILTER_BITS", 64)  # full: all rows pass, none is lost
    assert {r.id for r in common.may_have(rows, F.col("k"), F.col("x"), some).filter("may").collect()} >= set(range(0, 3000, 50))
    assert common.may_have(rows, F.col("k"), F.col("x"), some.limit(0)).filter("may").count() == 0


@pytest.mark.parametrize("bits", [64, common.FILTER_BITS])
def test_keep_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = [(1, "a", 1), (2, "a", 2), (2, "a", 3), (None, "b", 4), (None, "b", 5), (3, "c", 6)]
    df = spark.createDataFrame(rows, "id int, own_id string, may int")
    decided = spark.createDataFrame([(1, "a", False), (2, "a", True), (2, "a", False), (None, "b", True), (None, "b", False)], "id int, node string, kept boolean")
    kept = common.keep_rows(df, decided, "id", F.col("own_id"))
    assert kept.columns == df.columns
    assert sorted((r.id or 0, r.own_id) for r in kept.collect()) == [(0, "b"), (2, "a"), (3, "c")]


def test_caches_of_other_modules_go(spark):
    """A task of one module empties what another has kept in the worker."""

    def make():
        from urkunde.llm.common import CACHES, own_cache

        def function(batch):
            own_cache("elsewhere")["x"] = 1
            own_cache(make.__module__)["y"] = 1
            return [[len(CACHES["elsewhere"])] * batch.num_rows]

        return function

    out = common.map_batches(spark.range(10).coalesce(1), [("n", T.IntegerType())], make)
    assert {r.n for r in out.collect()} == {1}
    common.own_cache("one")["x"] = 1
    common.own_cache("two")["x"] = 1
    common.give_back("one")
    assert common.CACHES["one"] and not common.CACHES["two"]
    common.CACHES.clear()


def test_limits_are_only_lowered(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    was = [spark.conf.get(k, None) for k in keys]
    spark.conf.set(keys[0], "7")
    spark.conf.set(keys[1], "512m")
    common.bound_batches(spark)
    assert [spark.conf.get(k) for k in keys] == ["7", str(common.BATCH_BYTES)]
    with common.small_batches(spark, 3):
        assert spark.conf.get(keys[0]) == "3"
    assert spark.conf.get(keys[0]) == "7"
    for k, v in zip(keys, was, strict=True):
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shrink(spark):
    common.shrink(spark)
