"""The shop's eleven views as DataFrame plans over shared pre-aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.money import line_total, rounded_discounted
from ..model import Shop
from . import shared


def _image(shop: Shop, alias: str) -> DataFrame:
    return shared.top1_first_image(shop).withColumnRenamed("image_url", alias)


def v_product_summary(shop: Shop) -> DataFrame:
    """Product + brand + category + first image + variant and review roll-ups.
    NULL roll-ups become 0, except min/max price which stay NULL."""
    b = shop.brands.select(F.col("brand_id").alias("b_id"), F.col("name").alias("brand_name"))
    c = shop.categories.select(F.col("category_id").alias("c_id"),
                                      F.col("name").alias("category_name"))
    rows = (shop.products
            .join(b, F.col("brand_id") == F.col("b_id"), "left")
            .join(c, F.col("category_id") == F.col("c_id"), "left")
            .join(shared.agg_variant_rollup(shop), "product_id", "left")
            .join(shared.agg_review_rollup(shop), "product_id", "left")
            .join(_image(shop, "thumb"), "product_id", "left"))
    return rows.select(
        "product_id", F.col("name").alias("product_name"), "description",
        F.col("b_id").alias("brand_id"), "brand_name", F.col("c_id").alias("category_id"),
        "category_name", F.coalesce("thumb", F.lit("")).alias("thumbnail"),
        F.coalesce("total_variants", F.lit(0)).cast("bigint").alias("total_variants"),
        F.coalesce("total_stock", F.lit(0)).cast("bigint").alias("total_stock"),
        "min_price", "max_price",
        F.coalesce("avg_rating", F.lit(0).cast("decimal(10,2)")).alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
        "created_at")


def v_product_variant_detail(shop: Shop, as_of=None) -> DataFrame:
    """Variant rows with the *largest* active discount and the rounded price."""
    d = F.coalesce(F.col("max_discount_percent"), F.lit(0))
    rows = (shared.variants_named(shop)
            .join(shared.products_named(shop).select(
                "product_id", F.col("name").alias("product_name"), "description",
                "brand_name", "category_name"), "product_id")
            .join(shared.agg_active_discount(shop, as_of), "product_id", "left")
            .join(_image(shop, "img"), "product_id", "left"))
    return rows.select(
        "variant_id", "product_id", "product_name", "description", "brand_name",
        "category_name", "size_name", "color_name", "hex_code",
        F.col("price").alias("original_price"), d.alias("discount_percent"),
        rounded_discounted(F.col("price"), d).alias("final_price"), "stock",
        F.coalesce("img", F.lit("")).alias("image_url"), "created_at")


def _order_header(shop: Shop) -> DataFrame:
    pay = shared.top1_latest_payment(shop).select(
        "order_id", F.col("method").alias("pay_method"), F.col("status").alias("pay_status"))
    ship = shared.top1_latest_shipping(shop).select(
        "order_id", F.col("address").alias("ship_address"), F.col("status").alias("ship_status"))
    users = shop.users.select("user_id", F.col("name").alias("customer_name"), "email", "phone",
                              F.col("address").alias("user_address"))
    return (shop.orders.join(users, "user_id")
            .join(pay, "order_id", "left").join(ship, "order_id", "left"))


def v_order_summary(shop: Shop) -> DataFrame:
    """Order + user + latest payment and shipping; the address falls back to
    the user's when the latest shipping row has none (or there is none)."""
    return _order_header(shop).select(
        "order_id", "user_id", "customer_name", "email", "phone", "order_date",
        F.col("status").alias("order_status"), "total_amount",
        F.coalesce("pay_method", F.lit("")).alias("payment_method"),
        F.coalesce("pay_status", F.lit("")).alias("payment_status"),
        F.coalesce("ship_address", "user_address").alias("shipping_address"),
        F.coalesce("ship_status", F.lit("")).alias("shipping_status"))


def v_customer_order_tracking(shop: Shop) -> DataFrame:
    return v_order_summary(shop).drop("email", "phone")


def v_order_item_detail(shop: Shop) -> DataFrame:
    """Order lines with order, customer, variant and product columns. The
    dimensions are joined among themselves first (one row per order, one per
    variant), so the line table is shuffled once per key."""
    header = (shop.orders.select("order_id", "order_date", F.col("status").alias("order_status"),
                                 "user_id")
              .join(shop.users.select("user_id", F.col("name").alias("customer_name"), "email"),
                    "user_id"))
    vdim = (shared.variant_dim(shop)
            .select("variant_id", "product_id", "product_name", "size_name", "color_name")
            .join(_image(shop, "img"), "product_id", "left"))  # one image row per product
    rows = shop.order_details.join(header, "order_id").join(vdim, "variant_id")
    return rows.select(
        "order_detail_id", "order_id", "order_date", "order_status", "user_id",
        "customer_name", "email", "product_id", "product_name", "variant_id", "size_name",
        "color_name", "quantity", F.col("price").alias("unit_price"),
        line_total(F.col("quantity"), F.col("price")).alias("line_total"),
        F.coalesce("img", F.lit("")).alias("image_url"))


def v_product_stock_status(shop: Shop) -> DataFrame:
    """0 out, 1-5 low, else in; products without variants are out."""
    roll = shared.agg_variant_rollup(shop).select("product_id", "total_variants", "total_stock")
    rows = shared.products_named(shop).join(roll, "product_id", "left")
    total = F.coalesce(F.col("total_stock"), F.lit(0)).cast("bigint")
    return rows.select(
        "product_id", F.col("name").alias("product_name"), "brand_name", "category_name",
        F.coalesce("total_variants", F.lit(0)).cast("bigint").alias("total_variants"),
        total.alias("total_stock"), labels.stock_state3(total).alias("stock_status"))


def v_customer_product_list(shop: Shop, as_of=None) -> DataFrame:
    roll = shared.agg_variant_rollup(shop).select("product_id", "min_price", "total_stock")
    rows = (shared.products_named(shop)
            .join(roll, "product_id", "left")
            .join(shared.agg_active_discount(shop, as_of), "product_id", "left")
            .join(shared.agg_review_rollup(shop), "product_id", "left")
            .join(_image(shop, "thumb"), "product_id", "left"))
    d = F.coalesce(F.col("max_discount_percent"), F.lit(0))
    total = F.coalesce(F.col("total_stock"), F.lit(0)).cast("bigint")
    return rows.select(
        "product_id", F.col("name").alias("product_name"), "description", "brand_name",
        "category_name", F.coalesce("thumb", F.lit("")).alias("thumbnail"),
        total.alias("total_stock"), F.col("min_price").alias("original_price_from"),
        rounded_discounted(F.col("min_price"), d).alias("final_price_from"),
        d.alias("discount_percent"),
        F.coalesce("avg_rating", F.lit(0).cast("decimal(10,2)")).alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
        labels.stock_state2(total).alias("stock_status"))


def v_customer_product_detail(shop: Shop, as_of=None) -> DataFrame:
    rows = (shared.variants_named(shop)
            .join(shared.products_named(shop).select(
                "product_id", F.col("name").alias("product_name"), "description",
                "brand_name", "category_name"), "product_id")
            .join(shared.agg_active_discount(shop, as_of), "product_id", "left")
            .join(shared.agg_review_rollup(shop), "product_id", "left")
            .join(_image(shop, "img"), "product_id", "left"))
    d = F.coalesce(F.col("max_discount_percent"), F.lit(0))
    return rows.select(
        "product_id", "product_name", "description", "brand_name", "category_name",
        "variant_id", "size_name", "color_name", "hex_code",
        F.col("price").alias("original_price"), d.alias("discount_percent"),
        rounded_discounted(F.col("price"), d).alias("final_price"), "stock",
        labels.stock_state2(F.col("stock")).alias("stock_status"),
        F.coalesce("img", F.lit("")).alias("image_url"),
        F.coalesce("avg_rating", F.lit(0).cast("decimal(10,2)")).alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"))


def v_customer_sale_products(shop: Shop, as_of=None) -> DataFrame:
    """One row per product per active sale (not only the best one); sales with
    the same name, percent and dates merge, as the view groups on them."""
    sales = shared.active_sales(shop, as_of).select(
        "sale_id", F.col("name").alias("sale_name"), "discount_percent", "start_date", "end_date")
    minp = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("original_price_from"))
    per_sale = (shop.product_sales.join(sales, "sale_id")
                .select("product_id", "sale_name", "discount_percent", "start_date", "end_date")
                .distinct())
    rows = (per_sale.join(minp, "product_id")
            .join(shared.products_named(shop).select(
                "product_id", F.col("name").alias("product_name"), "brand_name",
                "category_name"), "product_id")
            .join(_image(shop, "thumb"), "product_id", "left"))
    return rows.select(
        "product_id", "product_name", "brand_name", "category_name", "sale_name",
        "discount_percent", "start_date", "end_date", "original_price_from",
        rounded_discounted(F.col("original_price_from"), F.col("discount_percent"))
        .alias("final_price_from"),
        F.coalesce("thumb", F.lit("")).alias("thumbnail"))


def v_customer_cart_detail(shop: Shop, as_of=None) -> DataFrame:
    """Cart lines with the discounted price; the line total rounds quantity x
    the unrounded discounted price. Cart lines join a per-cart header and a
    per-variant dimension, each once."""
    header = shop.cart.join(shop.users.select("user_id", F.col("name").alias("customer_name")),
                            "user_id")
    vdim = (shared.variant_dim(shop)
            .select("variant_id", "product_id", "product_name", "size_name", "color_name",
                    "price", "stock")
            .join(shared.agg_active_discount(shop, as_of), "product_id", "left")
            .join(_image(shop, "img"), "product_id", "left"))  # one row per product each
    rows = shop.cart_items.join(header, "cart_id").join(vdim, "variant_id")
    d = F.coalesce(F.col("max_discount_percent"), F.lit(0))
    return rows.select(
        "user_id", "customer_name", "cart_id", "cart_item_id", "product_id", "product_name",
        "variant_id", "size_name", "color_name", F.coalesce("img", F.lit("")).alias("image_url"),
        F.col("price").alias("original_price"), d.alias("discount_percent"),
        rounded_discounted(F.col("price"), d).alias("final_price"), "quantity",
        line_total(F.col("quantity"), F.col("price"), d).alias("line_total"), "stock")


def v_customer_product_reviews(shop: Shop) -> DataFrame:
    return (shop.reviews
            .join(shop.users.select("user_id", F.col("name").alias("customer_name")), "user_id")
            .join(shop.products.select("product_id", F.col("name").alias("product_name")),
                  "product_id")
            .select("review_id", "product_id", "product_name", "user_id", "customer_name",
                    "rating", "comment", "review_date"))
