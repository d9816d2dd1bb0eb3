"""Running sums do not depend on how Spark reuses exchanges."""

import pytest
from pyspark.sql import functions as F

from vitrine.plans.scan import prefix_sum


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_running_sums_with_and_without_exchange_reuse(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 400_000
        rows = spark.range(n).select(
            F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"), "id",
            F.lit(1).alias("one"))
        got = prefix_sum(rows, ["k"], [F.col("h").asc(), F.col("id").asc()], "one", "run",
                         num_partitions=16)
        r = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("d"),
                    F.min("run").alias("low"), F.max("run").alias("high")).first()
        assert (r.n, r.d, r.low, r.high) == (n, n, 1, n)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_list_filter_has_no_cap_of_its_own(spark):
    from vitrine.operators.lists import shop_filter

    rows = spark.createDataFrame([(1, "a", "b", 9_000_000), (2, "a", "b", 5)],
                                 "product_id int, category string, brand string, price long")
    assert shop_filter(rows).count() == 2
    assert shop_filter(rows, max_price=10).count() == 1


def test_shuffle_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    from vitrine import session
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size, None)
    try:
        session.size_shuffles(spark, str(tmp_path))
        assert spark.conf.get(key, None) is None
        (tmp_path / "x.parquet").write_bytes(b"x" * 100_000)
        monkeypatch.setattr(session, "TASK_BYTES", 1000)
        session.size_shuffles(spark, str(tmp_path))
        assert spark.conf.get(key) == "100" and spark.conf.get(size) == "1000"
    finally:
        spark.conf.unset(key)
        spark.conf.set(size, old) if old else spark.conf.unset(size)
