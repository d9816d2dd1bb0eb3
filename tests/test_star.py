"""Bucketed snapshots give the plain operators' rows and move no order lines."""

import re

import pytest

from vitrine.operators import reports as R
from vitrine.operators import star as ST
from vitrine.operators import views as V
from vitrine.plans import bucketed


@pytest.fixture(scope="module")
def star(spark, shop_small):
    s = bucketed.build(shop_small, buckets=4)
    yield s
    s.drop()


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("mine,plain", [
    (ST.star_order_lines, R.p_order_lines), (ST.star_order_item_detail, V.v_order_item_detail),
    (ST.star_units_per_product, R.q17_units_per_product)])
def test_star_joins_equal_the_plain_ones(star, shop_small, mine, plain):
    got = _rows(mine(star))
    assert got and got == _rows(plain(shop_small))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_exchange_of_order_lines(star, shop_small, no_broadcast):
    for query in (ST.star_order_lines, ST.star_order_item_detail):
        plan = _plan(query(star))
        assert "SortMergeJoin" in plan and "Exchange" not in plan, query.__name__
    plain = _plan(R.p_order_lines(shop_small))
    assert plain.count("Exchange hashpartitioning") >= 2


def test_units_move_one_row_per_variant(star, no_broadcast):
    plan = _plan(ST.star_units_per_product(star))
    # Lines are added up in their buckets: the exchange by product comes after the join.
    below = plan.split("Exchange hashpartitioning(product_id", 2)[-1]
    lines = [x for x in plan.splitlines() if "lines_by_variant" in x]
    assert lines and not re.search(r"Exchange hashpartitioning\(variant_id", plan)
    assert "SortMergeJoin [variant_id" in below


def test_one_file_per_bucket(star):
    files = star.table("lines_by_variant").inputFiles()
    assert 1 <= len(files) <= 4


def test_a_query_writes_only_the_tables_it_reads(spark, shop_small, monkeypatch):
    star = bucketed.build(shop_small, buckets=4)
    try:
        assert _rows(ST.star_units_per_product(star)) == _rows(R.q17_units_per_product(shop_small))
        assert set(star.pending) == {"headers", "lines_by_order"}
        monkeypatch.setattr(bucketed, "BUCKET_LINES", 1000)
        assert bucketed.buckets_for(shop_small, 2) == -(-shop_small.order_details.count() // 1000)
    finally:
        star.drop()
