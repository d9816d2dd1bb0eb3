"""The shop model over the driver tables reproduces the facts FIXTURES.md
states for sf0.01."""

from pyspark.sql import functions as F

from vitrine.functions.text import sql_len
from vitrine.operators import changes as C
from vitrine.operators import shared, views


def test_row_counts(shop_mid):
    want = {"users": 1500, "brands": 25, "categories": 6, "colors": 8, "sizes": 50,
            "products": 500, "product_variants": 1912, "sales": 3, "product_sales": 584,
            "product_images": 964, "orders": 15000, "order_details": 60000, "payments": 17045,
            "shipping": 45832, "reviews": 9419, "cart": 150, "cart_items": 9871}
    got = {t: getattr(shop_mid, t).count() for t in want}
    assert got == want


def test_model_facts(shop_mid):
    s = shop_mid
    p = s.products
    assert p.filter(F.col("brand_id").isNull()).count() == 30
    assert p.filter(F.col("category_id").isNull()).count() == 27
    assert p.join(s.product_images, "product_id", "left_anti").count() == 18
    status = {r.status: r["count"] for r in s.orders.groupBy("status").count().collect()}
    assert status == {"Completed": 4933, "Pending": 5088, "Confirmed": 1674, "Cancelled": 1672,
                      "Shipping": 1633}
    stock = {r.stock_status: r["count"] for r in
             views.v_product_stock_status(s).groupBy("stock_status").count().collect()}
    assert sorted(stock.values()) == [96, 117, 287]
    allowed = C.t_review_purchase_check(s.reviews, s.orders, s.order_details, s.product_variants)
    assert allowed.filter("allowed").count() == 226
    assert s.reviews.filter(sql_len(F.col("comment")) < 5).count() == 1039
    assert s.reviews.filter(F.col("comment").isNull()).count() == 840
    dup_psc = (s.product_variants.groupBy("product_id", "size_id", "color_id").count()
               .filter("count > 1").count())
    dup_ov = s.order_details.groupBy("order_id", "variant_id").count().filter("count > 1").count()
    assert (dup_psc, dup_ov) == (6, 55)
    assert s.order_details.join(s.product_variants, "variant_id", "left_anti").count() == 2666
    lines = s.cart_items.join(s.product_variants.select("variant_id", "stock"), "variant_id")
    assert (lines.count(), lines.filter(F.col("quantity") > F.col("stock")).count()) == (9439, 4352)
    disc = {r.max_discount_percent: r["count"] for r in
            shared.agg_active_discount(s).groupBy("max_discount_percent").count().collect()}
    assert disc == {30: 167, 10: 166}
    assert s.products.count() - sum(disc.values()) == 167
