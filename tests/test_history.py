"""Prices and sales at the time of each order against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import history as H
from vitrine.plans import intervals as I


def _t(days, seconds=0):
    return dt.datetime(1970, 1, 1) + dt.timedelta(days=days, seconds=seconds)


def _frames(spark, points, spans):
    return (spark.createDataFrame(points, "k long, t timestamp"),
            spark.createDataFrame(spans, "k long, name int, s timestamp, e timestamp"))


def test_in_force_against_all_pairs(spark):
    rng = random.Random(5)
    spans = []
    for name in range(300):
        start = rng.randrange(-4000, 30_000)
        length = rng.choice([0, 1, 7, 8, 9, 63, 64, 400, 5000, 400_000])
        spans.append((rng.randrange(4), name, _t(start, rng.randrange(86_400)),
                      _t(start + length, rng.randrange(86_400))))
    points = [(rng.randrange(4), _t(rng.randrange(-5000, 40_000), rng.randrange(86_400)))
              for _ in range(400)]
    points += [(k, x) for k, _, s, e in spans[:60] for x in (s, e, e + dt.timedelta(microseconds=1))]
    points += points[:50] + [(None, _t(3)), (1, None)]
    spans += [spans[0], (1, 900, None, _t(9)), (1, 901, _t(0), None), (None, 902, _t(0), _t(9)),
              (1, 903, dt.datetime(1900, 1, 2), dt.datetime(9000, 12, 30)), (2, 904, _t(9), _t(0))]
    got = sorted((r.k, r.t, r.name) for r in I.in_force(
        *_frames(spark, points, spans), ["k"], "t", "s", "e").collect())
    want = sorted((k, t, name) for k, t in points if None not in (k, t)
                  for k2, name, s, e in spans if k == k2 and s and e and s <= t <= e)
    assert want and got == want


def test_an_interval_takes_at_most_two_bins(spark):
    spans = [(1, n, _t(d), _t(d + n)) for d in (-17, 0, 5, 4095) for n in (0, 1, 7, 8, 511, 512, 99_999)]
    _, df = _frames(spark, [(1, _t(0))], spans)
    rows = I.binned_intervals(df, "s", "e").groupBy("name", "s").count().collect()
    assert len(rows) == len(spans) and {r["count"] for r in rows} <= {1, 2}


def test_no_nested_loop(spark, shop_small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = H.price_at_order(shop_small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "_level" in plan and "_bin" in plan


def _shop(shop, spark, lines, orders, sales, members):
    variants = [(1, 10, 1, 1, "100.00"), (2, 10, 1, 1, "19.99"), (3, 20, 1, 1, "5.05")]
    ddl = "order_id long, variant_id long, quantity int, price string"
    return shop.with_tables(
        order_details=spark.createDataFrame(lines, ddl).withColumn(
            "price", F.col("price").cast("decimal(10,2)")),
        orders=spark.createDataFrame(orders, "order_id long, order_date timestamp"),
        sales=spark.createDataFrame(
            sales, "sale_id int, name string, discount_percent int, start_date timestamp, end_date timestamp"),
        product_sales=spark.createDataFrame(members, "product_id long, sale_id int"),
        product_variants=spark.createDataFrame(
            variants, "variant_id long, product_id long, size_id int, color_id int, price string")
        .withColumn("price", F.col("price").cast("decimal(10,2)")))


def test_price_and_results_by_hand(spark, shop_small):
    lines = [(1, 1, 2, "90.00"), (1, 3, 1, "5.05"), (2, 2, 3, "10.00"), (3, 1, 1, "100.00"),
             (4, 1, 1, "1.00"), (4, 1, 1, "1.00"), (5, 9, 1, "1.00"), (9, 1, 1, "1.00")]
    orders = [(1, _t(100)), (2, _t(200)), (3, _t(200, 1)), (4, None), (5, _t(100))]
    sales = [(1, "a", 10, _t(50), _t(200)), (2, "b", 25, _t(100), _t(100)), (3, "c", 50, _t(900), _t(950))]
    shop = _shop(shop_small, spark, lines, orders, sales,
                 [(10, 1), (10, 1), (10, 2), (20, 3)])
    got = sorted((r.order_id, r.variant_id, r.discount_percent, str(r.price_then), str(r.line_then))
                 for r in H.price_at_order(shop).collect())
    assert got == [(1, 1, 25, "75.00", "150.00"), (1, 3, None, "5.05", "5.05"),
                   (2, 2, 10, "17.99", "53.97"), (3, 1, None, "100.00", "100.00"),
                   (4, 1, None, "100.00", "100.00"), (4, 1, None, "100.00", "100.00")]
    res = sorted((r.sale_id, r.total_lines, r.total_units, str(r.total_paid))
                 for r in H.sale_results(shop).collect())
    assert res == [(1, 2, 5, "210.00"), (2, 1, 2, "180.00"), (3, 0, 0, "0.00")]


@pytest.mark.parametrize("gone", ["order_details", "sales", "orders"])
def test_empty_tables(shop_small, gone):
    shop = shop_small.with_tables(**{gone: getattr(shop_small, gone).limit(0)})
    assert H.price_at_order(shop).count() == (0 if gone != "sales" else H._lines(shop).count())
    assert H.sale_results(shop).count() == (3 if gone != "sales" else 0)


def test_instants_look_only_into_widths_and_times_there_are(spark):
    day = "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int))"
    instants = spark.range(100).selectExpr("1L as k", f"{day} as t").unionByName(
        spark.createDataFrame([(1, None)], "k long, t timestamp"))
    intervals = spark.sql("select 1L as k, timestamp'2020-01-11' as s, timestamp'2020-01-30' as e, 'a' as n")
    binned = I.binned_intervals(intervals, "s", "e")
    assert I.probes(instants, binned, "t", "s", "e").count() == 20
    assert I.in_force(instants, intervals, ["k"], "t", "s", "e").count() == 20
    assert I.in_force(instants, intervals.limit(0), ["k"], "t", "s", "e").count() == 0
