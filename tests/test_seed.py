"""Golden values on the shop's seed data (FIXTURES F1, derived by hand)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from vitrine.operators import audits as A
from vitrine.operators import changes as C
from vitrine.operators import reports as R
from vitrine.operators import views as V
from vitrine.sources.tables import load_seed

from .seed_fixture import seed_rows


@pytest.fixture(scope="module")
def seed(spark):
    return load_seed(spark, seed_rows(), as_of=dt.datetime(2026, 4, 15))


def test_reports(seed):
    assert R.q05_count_users(seed).first().total_users == 16
    assert sorted(r.variant_id for r in R.q06_price_above(seed, 1000000).collect()) == \
        [10, 11, 12, 19, 20, 27, 28, 38, 39, 40]
    per_cat = {r.name: r.total_products for r in R.q10_products_per_category(seed).collect()}
    cats = {r.name: r.category_id for r in seed.categories.collect()}
    assert [per_cat[n] for n, _ in sorted(cats.items(), key=lambda x: x[1])] == [3, 3, 3, 2, 4, 3]
    assert sorted(r.product_id for r in R.q11_name_search(seed, "Nike").collect()) == [1, 5, 10, 14, 16]
    assert R.q14_completed_revenue(seed).first().revenue == D("700000.00")


def test_customer_rank(seed):
    got = {r.user_id: (r.total_spent, r.ranking) for r in R.q15_customer_rank(seed).collect()}
    assert got[3] == (D("2500000.00"), 1) and got[1] == (D("900000.00"), 2)
    assert got[2] == (D("700000.00"), 3) and got[4] == (D("600000.00"), 4)
    assert got[5] == (D("300000.00"), 5)
    assert {v for k, v in got.items() if k > 5} == {(D("0.00"), 6)}


def test_best_seller_units_and_variant_rank(seed):
    best = R.q16_best_seller_per_category(seed).collect()
    assert [(r.category_name, r.total_sold) for r in best] == [("Áo bóng đá", 2)]
    units = {r.product_id: r.total_sold for r in R.q17_units_per_product(seed).collect()}
    assert {k: v for k, v in units.items() if v} == {1: 4, 2: 2, 4: 1} and len(units) == 18
    ranks = {r.product_id: (r.total_variants, r.ranking) for r in R.q19_variant_count_rank(seed).collect()}
    assert all(ranks[p] == (3, 1) for p in [1, 2, 3, 4, 13, 14, 15, 16, 17, 18])
    assert all(ranks[p] == (2, 11) for p in range(5, 13))


def test_pricing_views(seed):
    rows = {r.product_id: r for r in V.v_customer_product_list(seed).collect()}
    disc = {p: r.discount_percent for p, r in rows.items()}
    assert {p for p, d in disc.items() if d == 30} == {1, 2, 3}
    assert {p for p, d in disc.items() if d == 10} == {7, 8, 9}
    assert sum(1 for d in disc.values() if d == 0) == 12
    assert rows[1].final_price_from == D("315000.00")
    assert V.v_customer_sale_products(seed).count() == 6
    may = seed.with_tables()
    may.as_of = dt.datetime(2026, 5, 10)
    sale = V.v_customer_sale_products(may).collect()
    assert sorted(r.product_id for r in sale) == [4, 5, 6] and {r.discount_percent for r in sale} == {20}


def test_trigger_jobs_and_audits(seed):
    empty = seed.order_details.limit(0)
    totals = {r.order_id: r.total_amount for r in
              C.t_order_total_recompute(seed.order_details, seed.order_details, empty).collect()}
    assert totals == {1: D("900000.00"), 2: D("700000.00"), 3: D("2500000.00"), 4: D("600000.00"),
                      5: D("300000.00")}
    checked = C.t_review_purchase_check(seed.reviews, seed.orders, seed.order_details,
                                        seed.product_variants)
    assert checked.filter("allowed").count() == 0
    assert C.t_stock_check(seed.order_details, seed.product_variants).count() == 0
    drift = sorted(int(r.key) for r in A.c_price_snapshot_drift(seed).collect())
    assert drift == [2, 3, 4, 5]


def test_seed_audit_contradictions(seed):
    # The seed itself satisfies its constraints.
    for audit in (A.c_unique, A.c_domain, A.c_foreign_keys, A.c_not_null, A.c_length):
        assert audit(seed).count() == 0, audit.__name__
    assert A.c_range(seed).filter(F.col("tbl") != "reviews").count() == 0


def test_delete_cascade_walks_the_key_graph(seed):
    report = A.c_delete_cascade(seed, {
        "products": seed.products.filter("product_id = 1"),
        "brands": seed.brands.filter("brand_id = 1")})
    got = {}
    for r in report.collect():
        got.setdefault((r.tbl, r.detail), set()).add(r.key)
    assert got[("product_variants", "cascade from products")] == {"1", "2", "3"}
    assert got[("product_sales", "cascade from products")] == {"1,1"}
    assert got[("product_images", "cascade from products")] == {"1", "2"}
    assert got[("reviews", "cascade from products")] == {"1"}
    # Variants 1 and 3 are in cart 1; variants 1 and 2 were ordered (lines 1, 2).
    assert got[("cart_items", "cascade from product_variants")] == {"1", "2"}
    assert got[("order_details", "cascade from product_variants")] == {"1", "2"}
    assert got[("products", "set null brand_id")] == {"1", "5", "10", "14", "16"}


def test_guards_per_row_and_whole_batch(seed):
    cands = seed.products.filter(F.col("product_id").isin(1, 7))   # 1 was sold, 7 was not
    per_row = {r.product_id: r.blocked for r in
               C.t_sold_product_delete_guard(cands, seed.product_variants, seed.order_details).collect()}
    assert per_row == {1: True, 7: False}
    batch = {r.product_id: r.blocked for r in C.t_sold_product_delete_guard(
        cands, seed.product_variants, seed.order_details, mode="batch").collect()}
    assert batch == {1: True, 7: True}
    # User 2 bought product 1 in a Completed order: that review passes per row,
    # but the whole batch fails with the seed's other reviews.
    new = seed.spark.createDataFrame([(2, 1, 5, "tuyệt vời")], "user_id long, product_id long, "
                                     "rating int, comment string")
    ok = C.t_review_purchase_check(new, seed.orders, seed.order_details, seed.product_variants)
    assert [r.allowed for r in ok.collect()] == [True]
    both = new.unionByName(seed.reviews.select("user_id", "product_id", "rating", "comment"))
    whole = C.t_review_purchase_check(both, seed.orders, seed.order_details, seed.product_variants,
                                      mode="batch")
    assert {r.allowed for r in whole.collect()} == {False}
