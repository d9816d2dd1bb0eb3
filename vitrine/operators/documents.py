"""Backend list and document operators: searches, nested product and order
documents, admin lists.

Nested arrays are built per product from groups whose size the schema bounds:
a product has at most one variant per (size, colour) - a unique key - so its
``variants[]``, ``sizes[]`` and ``colors[]`` cannot outgrow the size and colour
vocabularies. Each array is aggregated on its own key first and joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import blank_to_empty, contains_ci, is_blank
from ..model import Shop
from . import shared

DEFAULT_HEX = "#000000"


def api_product_search(shop: Shop, keyword: str | None = "") -> DataFrame:
    """Keyword over name, description, brand or category (case-insensitive);
    min variant price (0 if none); first image; newest id first; NULL -> ''."""
    minp = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("_minp"))
    rows = (shared.products_named(shop).join(minp, "product_id", "left")
            .join(shared.top1_first_image(shop), "product_id", "left"))
    if not is_blank(keyword):
        kw = str(keyword).strip()
        rows = rows.filter(contains_ci(F.col("name"), kw)
                           | contains_ci(blank_to_empty(F.col("description")), kw)
                           | contains_ci(blank_to_empty(F.col("brand_name")), kw)
                           | contains_ci(blank_to_empty(F.col("category_name")), kw))
    return rows.select(
        F.col("product_id").cast("string").alias("id"), "product_id",
        blank_to_empty(F.col("name")).alias("name"),
        blank_to_empty(F.col("description")).alias("description"),
        blank_to_empty(F.col("category_name")).alias("category"),
        blank_to_empty(F.col("brand_name")).alias("brand"),
        F.coalesce(F.col("_minp"), F.lit(0).cast("decimal(10,2)")).alias("price"),
        blank_to_empty(F.col("image_url")).alias("image"),
    ).orderBy(F.col("product_id").desc())


def product_images_list(shop: Shop) -> DataFrame:
    return (shop.product_images.groupBy("product_id")
            .agg(F.sort_array(F.collect_list(F.struct("image_id", "image_url"))).alias("_imgs"))
            .select("product_id", F.transform("_imgs", lambda x: x["image_url"]).alias("images")))


def distinct_sizes(shop: Shop) -> DataFrame:
    """Distinct size names per product, sorted by name (text order)."""
    v = shared.variants_named(shop)
    return (v.select("product_id", "size_name").distinct()
            .groupBy("product_id")
            .agg(F.array_sort(F.collect_list("size_name")).alias("sizes")))


def distinct_colors(shop: Shop) -> DataFrame:
    """Distinct (name, hex) colours per product, sorted by name."""
    v = shared.variants_named(shop)
    return (v.select("product_id", "color_name", "hex_code").distinct()
            .groupBy("product_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("color_name").alias("name"),
                F.coalesce(F.col("hex_code"), F.lit(DEFAULT_HEX)).alias("hex")))).alias("colors")))


def variant_list(shop: Shop) -> DataFrame:
    v = shared.variants_named(shop)
    return (v.groupBy("product_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("variant_id").alias("variantId"), F.col("size_name").alias("size"),
                F.col("color_name").alias("color"),
                F.coalesce(F.col("hex_code"), F.lit(DEFAULT_HEX)).alias("hex"),
                F.col("price").alias("price"), F.col("stock").alias("stock")))).alias("variants")))


def api_product_document(shop: Shop) -> DataFrame:
    """Every product as the detail document: images[], sizes[], colors[],
    variants[] (bulk form of the one-product endpoint)."""
    minp = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("_minp"))
    empty_s = F.array().cast("array<string>")
    rows = (shared.products_named(shop).join(minp, "product_id", "left")
            .join(product_images_list(shop), "product_id", "left")
            .join(distinct_sizes(shop), "product_id", "left")
            .join(distinct_colors(shop), "product_id", "left")
            .join(variant_list(shop), "product_id", "left"))
    images = F.coalesce(F.col("images"), empty_s)
    return rows.select(
        F.col("product_id").cast("string").alias("id"), "product_id",
        blank_to_empty(F.col("name")).alias("name"),
        blank_to_empty(F.col("description")).alias("description"),
        blank_to_empty(F.col("category_name")).alias("category"),
        blank_to_empty(F.col("brand_name")).alias("brand"),
        F.coalesce(F.col("_minp"), F.lit(0).cast("decimal(10,2)")).alias("price"),
        F.coalesce(F.try_element_at(images, F.lit(1)), F.lit("")).alias("image"),
        images.alias("images"),
        F.coalesce(F.col("sizes"), empty_s).alias("sizes"),
        F.coalesce(F.col("colors"), F.array().cast(
            "array<struct<name:string,hex:string>>")).alias("colors"),
        F.coalesce(F.col("variants"), F.array().cast(
            "array<struct<variantId:bigint,size:string,color:string,hex:string,"
            "price:decimal(10,2),stock:int>>")).alias("variants"))


def admin_product_list(shop: Shop) -> DataFrame:
    """Admin list: total stock, sizes in first-seen order, and the first
    non-zero variant price (rows taken in variant_id order)."""
    v = shared.variants_named(shop)
    stock = v.groupBy("product_id").agg(
        F.sum("stock").alias("_stock"),
        F.min_by(F.when(F.col("price") != 0, F.col("price")),
                 F.when(F.col("price") != 0, F.col("variant_id"))).alias("_nz_price"))
    size_first = (v.groupBy("product_id", "size_name").agg(F.min("variant_id").alias("_first"))
                  .groupBy("product_id")
                  .agg(F.sort_array(F.collect_list(F.struct("_first", "size_name"))).alias("_s"))
                  .select("product_id", F.transform("_s", lambda x: x["size_name"]).alias("sizes")))
    rows = (shared.products_named(shop).join(shared.top1_first_image(shop), "product_id", "left")
            .join(stock, "product_id", "left").join(size_first, "product_id", "left"))
    return rows.select(
        "product_id", blank_to_empty(F.col("name")).alias("name"),
        blank_to_empty(F.col("description")).alias("description"),
        F.coalesce(F.col("_nz_price"), F.lit(0).cast("decimal(10,2)")).alias("price"),
        blank_to_empty(F.col("category_name")).alias("category"),
        blank_to_empty(F.col("brand_name")).alias("brand"),
        blank_to_empty(F.col("image_url")).alias("image"),
        F.coalesce(F.col("_stock"), F.lit(0)).cast("bigint").alias("stock"),
        F.coalesce(F.col("sizes"), F.array().cast("array<string>")).alias("sizes"),
    ).orderBy(F.col("product_id").desc())


def admin_order_list(shop: Shop) -> DataFrame:
    """Admin orders with normalised statuses; the address is the latest
    shipping row's, with *no* fallback to the user's."""
    pay = shared.top1_latest_payment(shop).select(
        "order_id", F.col("method").alias("pm"), F.col("status").alias("ps"))
    ship = shared.top1_latest_shipping(shop).select("order_id", F.col("address").alias("sa"))
    users = shop.users.select("user_id", F.col("name").alias("un"), F.col("phone").alias("up"))
    rows = (shop.orders.join(users, "user_id").join(ship, "order_id", "left")
            .join(pay, "order_id", "left"))
    return rows.select(
        F.col("order_id").cast("string").alias("id"), "order_id",
        F.when((F.col("un").isNull()) | (F.col("un") == ""), F.lit(labels.GUEST_NAME))
         .otherwise(F.col("un")).alias("customer_name"),
        blank_to_empty(F.col("up")).alias("phone"),
        blank_to_empty(F.col("sa")).alias("address"),
        F.coalesce(F.col("total_amount"), F.lit(0).cast("decimal(12,2)")).alias("total_amount"),
        labels.norm_payment_method(F.col("pm")).alias("payment_method"),
        labels.norm_payment_status(F.col("ps")).alias("payment_status"),
        labels.norm_order_status(F.col("status")).alias("order_status"),
        F.col("order_date").alias("created_at"),
    ).orderBy(F.col("order_id").desc())


def api_order_list(shop: Shop) -> DataFrame:
    """Orders newest id first with the customer as a nested struct."""
    users = shop.users.select("user_id", F.col("name").alias("un"), F.col("email").alias("ue"),
                              F.col("phone").alias("up"))
    return (shop.orders.join(users, "user_id").select(
        F.col("order_id").cast("string").alias("id"), "order_id", "order_date", "status",
        F.coalesce(F.col("total_amount"), F.lit(0).cast("decimal(12,2)")).alias("total_amount"),
        F.struct(blank_to_empty(F.col("un")).alias("name"),
                 blank_to_empty(F.col("ue")).alias("email"),
                 blank_to_empty(F.col("up")).alias("phone")).alias("customer"),
    ).orderBy(F.col("order_id").desc()))


def admin_user_search(shop: Shop, email: str | None = None) -> DataFrame:
    """Users whose email contains the trimmed keyword (blank = all), newest
    first; NULL text becomes '', a missing role 'user'."""
    users = shop.users
    if not is_blank(email):
        users = users.filter(contains_ci(F.col("email"), str(email).strip()))
    return users.select(
        "user_id", blank_to_empty(F.col("name")).alias("name"),
        blank_to_empty(F.col("email")).alias("email"),
        blank_to_empty(F.col("phone")).alias("phone"),
        blank_to_empty(F.col("address")).alias("address"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"), "created_at",
    ).orderBy(F.col("user_id").desc())
