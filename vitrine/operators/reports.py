"""The shop's twenty report queries and its read procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.money import TOTAL, exact_discounted
from ..functions.text import contains_ci, is_blank
from ..model import Shop
from ..plans.scan import global_rank
from . import shared

COMPLETED = "Completed"

USER_COLS = ["user_id", "name", "email", "phone", "address", "role", "created_at"]


# ---- scans, projections, filters -------------------------------------------
def q01_users(shop: Shop) -> DataFrame:
    return shop.users.select(*USER_COLS)


def q02_products(shop: Shop) -> DataFrame:
    return shop.products


def q03_brands(shop: Shop) -> DataFrame:
    return shop.brands


def q04_products_in_category(shop: Shop, category_id: int = 1) -> DataFrame:
    return shop.products.filter(F.col("category_id") == category_id)


def q05_count_users(shop: Shop) -> DataFrame:
    return shop.users.agg(F.count(F.lit(1)).alias("total_users"))


def q06_price_above(shop: Shop, threshold=1000000) -> DataFrame:
    return shop.product_variants.filter(F.col("price") > F.lit(threshold))


def q07_newest_products(shop: Shop) -> DataFrame:
    return shop.products.orderBy(F.col("created_at").desc_nulls_last(),
                                 F.col("product_id").desc())


def q11_name_search(shop: Shop, keyword: str = "Nike") -> DataFrame:
    return shop.products.filter(contains_ci(F.col("name"), keyword))


def q13_order_list(shop: Shop) -> DataFrame:
    return (shop.orders.join(shop.users.select("user_id", "name"), "user_id")
            .select("order_id", "name", "status", "total_amount"))


# ---- joins -------------------------------------------------------------------
def q08_product_brand_category(shop: Shop) -> DataFrame:
    return shared.products_named(shop).select(
        F.col("name").alias("product_name"), F.col("brand_name").alias("brand"),
        F.col("category_name").alias("category"))


def q09_variant_list(shop: Shop) -> DataFrame:
    return (shared.variants_named(shop)
            .join(shop.products.select("product_id", F.col("name").alias("product_name")),
                  "product_id")
            .select("variant_id", "product_name", F.col("size_name").alias("size"),
                    F.col("color_name").alias("color"), "price", "stock"))


def q20_price_and_sale_status(shop: Shop, as_of=None) -> DataFrame:
    """Variant x each sale of its product; expired sales stay as rows."""
    t = shared.as_of_col(shop, as_of)
    sales = shop.sales.select("sale_id", F.col("name").alias("sale_name"),
                                     "discount_percent", "start_date", "end_date")
    rows = (shop.product_variants.select("variant_id", "product_id", "price")
            .join(shop.products.select("product_id", F.col("name").alias("product_name")),
                  "product_id")
            .join(shop.product_sales, "product_id", "left")
            .join(sales, "sale_id", "left"))
    active = t.between(F.col("start_date"), F.col("end_date"))
    return rows.select(
        "product_id", "product_name", "variant_id", F.col("price").alias("original_price"),
        "sale_name", "discount_percent",
        F.when(active, exact_discounted(F.col("price"), F.col("discount_percent")))
         .otherwise(F.col("price").cast("decimal(20,4)")).alias("final_price"),
        F.when(active, F.lit(labels.SALE_ON)).otherwise(F.lit(labels.SALE_OFF))
         .alias("sale_status"))


# ---- aggregations -----------------------------------------------------------
def q10_products_per_category(shop: Shop) -> DataFrame:
    per_cat = shop.products.groupBy("category_id").agg(F.count("product_id").alias("_n"))
    return (shop.categories.join(per_cat, "category_id", "left")
            .groupBy("name")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_products")))


def q12_orders_per_user(shop: Shop) -> DataFrame:
    """Grouped by user *name*: namesakes merge, as in the report."""
    per_user = shop.orders.groupBy("user_id").agg(F.count("order_id").alias("_n"))
    return (shop.users.select("user_id", "name").join(per_user, "user_id", "left")
            .groupBy("name")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_orders")))


def q14_completed_revenue(shop: Shop) -> DataFrame:
    return (shop.orders.filter(F.col("status") == COMPLETED)
            .agg(F.sum("total_amount").cast(TOTAL).alias("revenue")))


def _units_per_product(order_lines: DataFrame, shop: Shop) -> DataFrame:
    per_variant = order_lines.groupBy("variant_id").agg(F.sum("quantity").alias("_q"))
    return (shop.product_variants.select("variant_id", "product_id")
            .join(per_variant, "variant_id")
            .groupBy("product_id").agg(F.sum("_q").alias("total_sold")))


def completed_lines(shop: Shop) -> DataFrame:
    done = shop.orders.filter(F.col("status") == COMPLETED).select("order_id")
    return shop.order_details.join(done, "order_id", "left_semi")


def q17_units_per_product(shop: Shop) -> DataFrame:
    """Units per product over all order statuses, zero kept."""
    units = _units_per_product(shop.order_details, shop)
    return (shop.products.select("product_id", "name").join(units, "product_id", "left")
            .select("product_id", "name",
                    F.coalesce(F.col("total_sold"), F.lit(0)).cast("bigint").alias("total_sold")))


def p_revenue_by_date(shop: Shop) -> DataFrame:
    return (shop.orders.filter(F.col("status") == COMPLETED)
            .groupBy(F.to_date("order_date").alias("order_date"))
            .agg(F.sum("total_amount").cast(TOTAL).alias("revenue")))


# ---- windows ----------------------------------------------------------------
def q15_customer_rank(shop: Shop) -> DataFrame:
    """RANK over total spent (all statuses), users without orders at 0.

    The rank is computed by ``global_rank``: counts per distinct total and a
    range-partitioned running count, not one window over all users.
    """
    spent = shop.orders.groupBy("user_id").agg(F.sum("total_amount").alias("_s"))
    totals = (shop.users.select("user_id", "name").join(spent, "user_id", "left")
              .select("user_id", "name",
                      F.coalesce(F.col("_s"), F.lit(0)).cast(TOTAL).alias("total_spent")))
    return global_rank(totals, "total_spent", "ranking")


def q16_best_seller_per_category(shop: Shop) -> DataFrame:
    """Best seller(s) per category over Completed orders; ties at the top stay.

    RANK() = 1 is the same as "equals the category maximum", so the plan is
    two partial aggregations and a join to a per-category maximum (one row
    per category) instead of a window partitioned by category.
    """
    units = _units_per_product(completed_lines(shop), shop)
    cats = shop.categories.select("category_id", F.col("name").alias("category_name"))
    per_product = (units.join(shop.products.select("product_id", F.col("name").alias("product_name"),
                                                   "category_id"), "product_id")
                   .join(cats, "category_id"))
    top = per_product.groupBy("category_id").agg(F.max("total_sold").alias("_top"))
    return (per_product.join(top, "category_id")
            .filter(F.col("total_sold") == F.col("_top"))
            .select("category_name", "product_name",
                    F.col("total_sold").cast("bigint").alias("total_sold")))


def q18_monthly_revenue_lag(shop: Shop) -> DataFrame:
    """Monthly Completed revenue and the previous *existing* month.

    The window runs after the aggregation, over one row per month.
    """
    from pyspark.sql import Window
    monthly = (shop.orders.filter(F.col("status") == COMPLETED)
               .groupBy(F.year("order_date").cast("int").alias("year"),
                        F.month("order_date").cast("int").alias("month"))
               .agg(F.sum("total_amount").cast(TOTAL).alias("revenue")))
    w = Window.orderBy("year", "month")
    prev = F.lag("revenue").over(w)
    return monthly.select("year", "month", "revenue", prev.alias("prev_month_revenue"),
                          (F.col("revenue") - F.coalesce(prev, F.lit(0))).cast(TOTAL)
                          .alias("revenue_diff"))


def q19_variant_count_rank(shop: Shop) -> DataFrame:
    per = shop.product_variants.groupBy("product_id").agg(F.count("variant_id").alias("_n"))
    counts = (shop.products.select("product_id", "name").join(per, "product_id", "left")
              .select("product_id", "name",
                      F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("total_variants")))
    return global_rank(counts, "total_variants", "ranking")


# ---- procedures -------------------------------------------------------------
def _product_prices(shop: Shop, as_of=None) -> DataFrame:
    minp = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("original_price"))
    disc = shared.agg_active_discount(shop, as_of)
    rows = (shared.products_named(shop).join(minp, "product_id", "left")
            .join(disc, "product_id", "left"))
    d = F.col("max_discount_percent")
    return rows.select(
        "product_id", "name", F.col("brand_name").alias("brand"),
        F.col("category_name").alias("category"), "original_price",
        d.alias("discount_percent"),
        F.when(d.isNotNull(), exact_discounted(F.col("original_price"), d))
         .otherwise(F.lit(None).cast("decimal(20,4)")).alias("sale_price"))


def p_all_products(shop: Shop, as_of=None) -> DataFrame:
    return _product_prices(shop, as_of)


def p_search_products(shop: Shop, keyword: str | None = None, as_of=None) -> DataFrame:
    rows = _product_prices(shop, as_of)
    if is_blank(keyword):
        return rows
    return rows.filter(contains_ci(F.col("name"), keyword))


def p_orders_by_user(shop: Shop, user_id=None) -> DataFrame:
    """One user's orders latest first; without a user, all users sorted by
    user then date (a range-partitioned sort: a heavy user spans partitions)."""
    cols = ["order_id", "user_id", "order_date", "status", "total_amount"]
    if user_id is not None:
        return (shop.orders.filter(F.col("user_id") == user_id).select(*cols)
                .orderBy(F.col("order_date").desc_nulls_last(), F.col("order_id").desc()))
    return shop.orders.select(*cols).orderBy(
        "user_id", F.col("order_date").desc_nulls_last(), F.col("order_id").desc())


def p_order_lines(shop: Shop, order_id=None) -> DataFrame:
    lines = shop.order_details
    if order_id is not None:
        lines = lines.filter(F.col("order_id") == order_id)
    vdim = shared.variant_dim(shop).select("variant_id", F.col("product_name").alias("name"),
                                           "size_name", "color_name")
    return (lines.select("order_id", "variant_id", "quantity", "price").join(vdim, "variant_id")
            .select("order_id", "name", F.col("size_name").alias("size"),
                    F.col("color_name").alias("color"), "quantity", "price"))


def p_top_selling_products(shop: Shop, k: int = 5) -> DataFrame:
    """Top k product *names* by Completed units (names merge); ties broken
    by name so the answer is deterministic."""
    per_product = _units_per_product(completed_lines(shop), shop)
    return (per_product.join(shop.products.select("product_id", "name"), "product_id")
            .groupBy("name").agg(F.sum("total_sold").cast("bigint").alias("total_sold"))
            .orderBy(F.col("total_sold").desc(), F.col("name").asc())
            .limit(k))
