"""Snapshots round-trip through files, and plans keep their scale shape."""

import contextlib
import datetime as dt
import io

from pyspark.sql import functions as F

from vitrine.operators import checkout as K
from vitrine.operators import reports as R
from vitrine.operators import views as V
from vitrine.sources.tables import read_shop_tables, write_shop_tables
from vitrine.streaming.feeds import scratch

from .seed_fixture import seed_rows
from vitrine.sources.tables import load_seed


def test_snapshot_round_trip_after_checkout(spark):
    shop = load_seed(spark, seed_rows(), as_of=dt.datetime(2026, 4, 15))
    res = K.p_bulk_checkout(shop, shop.users)
    nxt = shop.with_tables(product_variants=res["product_variants"], cart_items=res["cart_items"],
                           orders=res["orders"], order_details=res["order_details"])
    path = scratch(spark, "snapshot-test")
    write_shop_tables(nxt, path)
    back = read_shop_tables(spark, path, as_of=shop.as_of)
    accepted = res["outcome"].filter("accepted").count()
    assert back.orders.count() == 5 + accepted
    accepted_carts = res["outcome"].filter("accepted").select("cart_id")
    assert back.cart_items.join(accepted_carts, "cart_id", "left_semi").count() == 0
    assert back.cart_items.count() == shop.cart_items.join(accepted_carts, "cart_id",
                                                           "left_anti").count()
    before = shop.product_variants.agg(F.sum("stock")).first()[0]
    after = back.product_variants.agg(F.sum("stock")).first()[0]
    assert before - after == back.order_details.filter(F.col("order_detail_id") > 5) \
        .agg(F.coalesce(F.sum("quantity"), F.lit(0))).first()[0]
    assert V.v_order_summary(back).count() == back.orders.count()


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_rank_is_not_a_single_window(spark, shop_small):
    df = spark.range(2000).selectExpr("id", "cast(id * 7 % 90 as int) as v").repartition(5)
    df = df.withColumn("v", F.when(F.col("v") > 3, F.col("v")))  # NULL is a value of its own
    from vitrine.plans.scan import global_rank
    ranked = global_rank(df, "v")
    want = df.selectExpr("id", "rank() over (order by v desc nulls last) as r")
    assert {(r.id, r.ranking) for r in ranked.collect()} == {(r.id, r.r) for r in want.collect()}
    for query in (R.q15_customer_rank, R.q19_variant_count_rank):
        plan = _plan(query(shop_small))
        assert "rank(" not in plan.lower()
        # What windows there are run over one row per partition of the scan.
        assert "windowspecdefinition" not in plan.lower() or "_scan_tot" in plan


def test_best_seller_has_no_window_by_category(shop_small):
    plan = _plan(R.q16_best_seller_per_category(shop_small))
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line.lower()]
    assert all("category_id" not in w for w in windows)


def test_building_a_plan_starts_no_job(spark, shop_small):
    from vitrine.operators import audits, views
    spark.sparkContext.setJobGroup("plans-only", "plans")
    views.v_order_item_detail(shop_small)
    views.v_customer_cart_detail(shop_small)
    R.p_order_lines(shop_small)
    audits.c_foreign_keys(shop_small)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plans-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_an_audit_reads_and_sorts_the_order_lines_once(shop_small):
    from vitrine.operators import audits
    for audit in (audits.c_not_null, audits.c_range, audits.c_foreign_keys):
        optimized = audit(shop_small)._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("row_number()") <= 1, audit.__name__


def test_next_keys_follow_the_largest_id_in_order(spark):
    from vitrine.plans.keys import next_keys
    existing = spark.createDataFrame([(7,), (3,)], "id long")
    new = spark.createDataFrame([("c",), ("a",), ("b",)], "name string").repartition(3)
    got = {r.name: r.id for r in next_keys(new, existing, "id", [F.col("name").asc()]).collect()}
    assert got == {"a": 8, "b": 9, "c": 10}
    empty = existing.limit(0)
    got = {r.name: r.id for r in next_keys(new, empty, "id", [F.col("name").desc()]).collect()}
    assert got == {"c": 1, "b": 2, "a": 3}
