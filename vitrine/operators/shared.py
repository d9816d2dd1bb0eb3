"""Sub-plans shared by many operators: pre-aggregates and latest/first rows.

Each one is grouped *before* it is joined (one row per key), so a product's
stock is never multiplied by its reviews and every aggregate runs with
map-side partial aggregation - a hot key is combined inside each task before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shop


def as_of_col(shop: Shop, as_of=None):
    return F.lit(as_of or shop.as_of).cast("timestamp")


def active_sales(shop: Shop, as_of=None) -> DataFrame:
    """Sales whose closed interval [start, end] contains ``as_of``."""
    t = as_of_col(shop, as_of)
    return shop.sales.filter(t.between(F.col("start_date"), F.col("end_date")))


def agg_variant_rollup(shop: Shop) -> DataFrame:
    return (shop.product_variants.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("total_variants"),
                 F.sum("stock").alias("total_stock"),
                 F.min("price").alias("min_price"),
                 F.max("price").alias("max_price")))


def agg_review_rollup(shop: Shop) -> DataFrame:
    return (shop.reviews.groupBy("product_id")
            .agg(F.avg(F.col("rating").cast("decimal(10,2)")).cast("decimal(10,2)")
                 .alias("avg_rating"),
                 F.count(F.lit(1)).alias("review_count")))


def agg_active_discount(shop: Shop, as_of=None) -> DataFrame:
    """Largest active discount percent per product (also ``top1_best_discount``)."""
    return (shop.product_sales.join(active_sales(shop, as_of).select("sale_id", "discount_percent"),
                                    "sale_id")
            .groupBy("product_id")
            .agg(F.max("discount_percent").alias("max_discount_percent")))


def top1_first_image(shop: Shop) -> DataFrame:
    return (shop.product_images.groupBy("product_id")
            .agg(F.min_by("image_url", "image_id").alias("image_url")))


def top1_latest_payment(shop: Shop) -> DataFrame:
    return (shop.payments.groupBy("order_id")
            .agg(F.max_by(F.struct("method", "status"), "payment_id").alias("pay"))
            .select("order_id", F.col("pay.method").alias("method"),
                    F.col("pay.status").alias("status")))


def top1_latest_shipping(shop: Shop) -> DataFrame:
    """Address and status of the highest shipping id; a NULL address inside
    that row stays NULL (callers may then fall back to the user's)."""
    return (shop.shipping.groupBy("order_id")
            .agg(F.max_by(F.struct("address", "status"), "shipping_id").alias("ship"))
            .select("order_id", F.col("ship.address").alias("address"),
                    F.col("ship.status").alias("status")))


def products_named(shop: Shop) -> DataFrame:
    """Products with brand and category names (left joins to dimensions)."""
    b = shop.brands.select("brand_id", F.col("name").alias("brand_name"))
    c = shop.categories.select("category_id", F.col("name").alias("category_name"))
    return (shop.products.join(b, "brand_id", "left").join(c, "category_id", "left"))


def variants_named(shop: Shop) -> DataFrame:
    """Variants with size and colour names (inner joins, as the shop's views)."""
    s = shop.sizes.select("size_id", F.col("name").alias("size_name"))
    c = shop.colors.select("color_id", F.col("name").alias("color_name"), "hex_code")
    return shop.product_variants.join(s, "size_id").join(c, "color_id")


def variant_dim(shop: Shop) -> DataFrame:
    """One row per variant with its size, colour and product columns, so a
    fact table joins the whole dimension once on variant_id (a star join
    written dimension-first: the fact is shuffled once, not per dimension).
    Adaptive execution broadcasts it where its measured bytes allow."""
    prod = shop.products.select("product_id", F.col("name").alias("product_name"))
    return variants_named(shop).join(prod, "product_id")
