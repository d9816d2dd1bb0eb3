"""One test per rule that a plausible rewrite would break (FIXTURES F3)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from vitrine.functions import labels
from vitrine.functions.sizes import sort_sizes
from vitrine.functions.text import sql_len
from vitrine.operators import changes as C
from vitrine.operators import lists as L
from vitrine.operators import reports as R
from vitrine.operators import views as V
from vitrine.plans.scan import global_rank, prefix_sum
from vitrine.sources.tables import load_seed

T0 = dt.datetime(2026, 4, 1)


def base_rows():
    return {
        "users": [(1, "An", "a@x", None, "HN", "user", None), (2, "Binh", "b@x", None, "HCM", "user", None),
                  (3, "An", "c@x", None, "DN", "user", None)],
        "brands": [(1, "Nike")], "categories": [(1, "Giày"), (2, "Áo")],
        "colors": [(1, "Red", "#f00")], "sizes": [(1, "S"), (2, "M"), (3, "42")],
        "products": [(1, "Shoe A", None, 1, 1, None), (2, "Shirt B", None, 1, 2, None),
                     (3, "Shoe A", None, 1, 1, None), (4, "Empty", None, None, None, None)],
        "product_variants": [(11, 1, 1, 1, D("1347.05"), 0, None), (12, 1, 2, 1, D("100.00"), 5, None),
                             (21, 2, 1, 1, D("200.00"), 6, None), (31, 3, 3, 1, D("300.00"), 2, None)],
        "sales": [(1, "Ten", 10, dt.datetime(2026, 4, 1), dt.datetime(2026, 4, 30)),
                  (2, "Thirty", 30, dt.datetime(2026, 4, 1), dt.datetime(2026, 4, 20))],
        "product_sales": [(1, 1), (1, 2), (2, 1)],
    }


def shop_of(spark, as_of=dt.datetime(2026, 4, 30), **extra):
    rows = base_rows()
    rows.update(extra)
    return load_seed(spark, rows, as_of=as_of)


def test_sale_window_closed_at_both_ends(spark):
    at_end = shop_of(spark, dt.datetime(2026, 4, 30, 0, 0, 0))
    after = shop_of(spark, dt.datetime(2026, 4, 30, 0, 0, 1))
    d1 = {r.product_id: r.discount_percent for r in V.v_customer_product_list(at_end).collect()}
    d2 = {r.product_id: r.discount_percent for r in V.v_customer_product_list(after).collect()}
    assert d1[2] == 10 and d2[2] == 0


def test_overlapping_sales_take_the_largest_and_sale_list_keeps_both(spark):
    s = shop_of(spark, dt.datetime(2026, 4, 15))
    d = {r.product_id: r.discount_percent for r in V.v_customer_product_list(s).collect()}
    assert d[1] == 30
    per_sale = V.v_customer_sale_products(s).filter(F.col("product_id") == 1).count()
    assert per_sale == 2


def test_half_up_rounding_of_discounted_price(spark):
    s = shop_of(spark, dt.datetime(2026, 4, 25))  # only the 10 % sale is active
    row = V.v_product_variant_detail(s).filter(F.col("variant_id") == 11).first()
    assert row.final_price == D("1212.35")


def test_len_ignores_trailing_blanks_and_null_passes(spark):
    df = spark.createDataFrame([(None,), ("ok",), ("đẹp lắm",), ("abc  ",)], "c string")
    got = [r[0] for r in df.select((sql_len(F.col("c")) >= 5).alias("ok")).collect()]
    assert got == [None, False, True, False]


def test_duplicate_product_names_merge_in_top_selling(spark):
    s = shop_of(spark, orders=[(1, 1, T0, "Completed", D("1")), (2, 2, T0, "Completed", D("1"))],
                order_details=[(1, 1, 12, 2, D("1")), (2, 2, 31, 3, D("1")), (3, 2, 21, 4, D("1"))])
    rows = {r.name: r.total_sold for r in R.p_top_selling_products(s).collect()}
    assert rows == {"Shoe A": 5, "Shirt B": 4}


def test_ties_at_rank_one_all_survive(spark):
    s = shop_of(spark, orders=[(1, 1, T0, "Completed", D("1"))],
                order_details=[(1, 1, 12, 7, D("1")), (2, 1, 31, 7, D("1"))])
    rows = R.q16_best_seller_per_category(s).collect()
    assert sorted(r.total_sold for r in rows) == [7, 7]


def test_lag_steps_over_missing_months_and_first_diff_is_revenue(spark):
    s = shop_of(spark, orders=[(1, 1, dt.datetime(2026, 1, 5), "Completed", D("50")),
                               (2, 1, dt.datetime(2026, 3, 5), "Completed", D("80"))])
    rows = {(r.year, r.month): r for r in R.q18_monthly_revenue_lag(s).collect()}
    assert rows[(2026, 1)].revenue_diff == D("50.00")
    assert rows[(2026, 3)].prev_month_revenue == D("50.00")


def test_stock_state_thresholds(spark):
    s = shop_of(spark, product_variants=[(11, 1, 1, 1, D("1"), 0, None), (21, 2, 1, 1, D("1"), 5, None),
                                         (31, 3, 1, 1, D("1"), 6, None)])
    got = {r.product_id: r.stock_status for r in V.v_product_stock_status(s).collect()}
    assert got == {1: labels.STOCK_OUT, 2: labels.STOCK_LOW, 3: labels.STOCK_IN, 4: labels.STOCK_OUT}


@pytest.mark.parametrize("kw,n", [(None, 4), ("", 4), ("  ", 4), ("shoe", 2)])
def test_blank_keyword_returns_all(spark, kw, n):
    assert R.p_search_products(shop_of(spark), kw).count() == n


def test_cancel_restores_only_on_transition_and_sums_lines(spark):
    orders = [(1, 1, T0, "Cancelled", D("1")), (2, 1, T0, "Pending", D("1"))]
    after = [(1, 1, T0, "Cancelled", D("1")), (2, 1, T0, "Cancelled", D("1"))]
    s = shop_of(spark, orders=orders,
                order_details=[(1, 1, 12, 9, D("1")), (2, 2, 12, 2, D("1")), (3, 2, 12, 3, D("1"))])
    after_df = spark.createDataFrame(after, s.orders.schema)
    got = {r.variant_id: r.restored for r in
           C.t_cancel_restores_stock(s.orders, after_df, s.order_details, s.product_variants).collect()}
    assert got == {12: 5}


def test_size_order(spark):
    df = spark.createDataFrame([(["42", "XL", "One", "S", "9", "s", " "],)], "a array<string>")
    assert df.select(sort_sizes(F.col("a"))).first()[0] == ["S", "s", "XL", "9", "42", "One"]


def test_payment_labels(spark):
    df = spark.createDataFrame([("Momo",), ("bank",), (None,), ("Visa",)], "m string")
    got = [r[0] for r in df.select(labels.norm_payment_method(F.col("m"))).collect()]
    assert got == ["momo", "banking", "cod", "visa"]
    intake = [r[0] for r in df.select(labels.map_payment_method(F.col("m"))).collect()]
    assert intake == ["Momo", "COD", "COD", "COD"]


def test_namesakes_merge_in_orders_per_user(spark):
    s = shop_of(spark, orders=[(1, 1, T0, "Pending", D("1")), (2, 3, T0, "Pending", D("1"))])
    got = {r.name: r.total_orders for r in R.q12_orders_per_user(s).collect()}
    assert got == {"An": 2, "Binh": 0}


def test_cart_merge_fold(spark):
    ev = [(1, 1, "S", "Red", 1, "add", 2), (1, 1, "S", "Red", 2, "set", 5), (1, 1, "S", "Red", 3, "add", 1),
          (1, 2, "M", "Red", 1, "set", 4), (1, 2, "M", "Red", 2, "add", 1),
          (1, 3, "M", "Red", 1, "add", 2), (1, 3, "M", "Red", 2, "remove", 0),
          (1, 4, "M", "Red", 1, "add", 2), (1, 4, "M", "Red", 2, "set", 0), (1, 4, "M", "Red", 3, "add", 3)]
    df = spark.createDataFrame(ev, "cart_id long, product_id long, size string, color string, "
                                   "seq long, op string, quantity int")
    got = {r.product_id: r.quantity for r in L.cart_merge(df).collect()}
    # set on a missing line does nothing; remove and set 0 delete; adds recreate.
    assert got == {1: 6, 2: 1, 4: 3}


def test_prefix_sum_with_a_hot_key_equals_pandas(spark):
    rows = [(0, i, 1 + i % 4) for i in range(3000)] + [(k, i, 2) for k in range(1, 40) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    got = {(r.k, r.o): r.run for r in prefix_sum(df, ["k"], [F.col("o").asc()], "v", "run",
                                                    num_partitions=16).collect()}
    want, run = {}, {}
    for k, o, v in sorted(rows):
        run[k] = run.get(k, 0) + v
        want[(k, o)] = run[k]
    assert got == want


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (3, 30), (4, 0), (5, 0), (6, 20)], "id long, v long")
    got = {r.id: r.ranking for r in global_rank(df, "v").collect()}
    assert got == {2: 1, 3: 1, 6: 3, 1: 4, 4: 5, 5: 5}


def test_prefix_sum_carries_across_arrow_batches(spark):
    # Many keys per partition and tiny Arrow batches: sums must carry across
    # batch boundaries inside a partition and across partitions.
    rows = [(k, i, (k * 7 + i) % 5 + 1) for k in range(12) for i in range(120)]
    rows += [(99, i, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = prefix_sum(df, ["k"], [F.col("o").asc()], ["v", "v"], ["run", "run2"],
                         num_partitions=6)
        got = {(r.k, r.o): (r.run, r.run2) for r in out.collect()}
        glob = {r.o: r.g for r in prefix_sum(df.filter("k = 99"), [], [F.col("o").desc()], "v", "g",
                                             inclusive=False, num_partitions=4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, run = {}, {}
    for k, o, v in sorted(rows):
        run[k] = run.get(k, 0) + v
        want[(k, o)] = (run[k], run[k])
    assert got == want
    assert glob == {o: 1999 - o for o in range(2000)}
