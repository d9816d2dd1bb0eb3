"""Star joins of the reports over a bucketed snapshot (``plans.bucketed``).

Same results as the operators of the same names over plain tables. No join here moves
order lines: each runs bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import line_total
from ..plans.bucketed import StarSnapshot


def star_order_lines(star: StarSnapshot) -> DataFrame:
    """``p_order_lines`` of all orders."""
    named = star.table("variants").select("variant_id", F.col("product_name").alias("name"),
                                          F.col("size_name").alias("size"),
                                          F.col("color_name").alias("color"))
    return (star.table("lines_by_variant").select("order_id", "variant_id", "quantity", "price")
            .join(named, "variant_id")
            .select("order_id", "name", "size", "color", "quantity", "price"))


def star_order_item_detail(star: StarSnapshot) -> DataFrame:
    """``v_order_item_detail``: the lines by order carry their variant's columns."""
    rows = star.table("lines_by_order").join(star.table("headers"), "order_id")
    return rows.select(
        "order_detail_id", "order_id", "order_date", "order_status", "user_id",
        "customer_name", "email", "product_id", "product_name", "variant_id", "size_name",
        "color_name", "quantity", F.col("price").alias("unit_price"),
        line_total(F.col("quantity"), F.col("price")).alias("line_total"),
        F.coalesce("image_url", F.lit("")).alias("image_url"))


def star_units_per_product(star: StarSnapshot) -> DataFrame:
    """``q17_units_per_product``: units are added up inside the variant buckets; one row
    per variant goes on to its product."""
    per_variant = (star.table("lines_by_variant").groupBy("variant_id")
                   .agg(F.sum("quantity").alias("units")))
    per_product = (star.table("variants").select("variant_id", "product_id")
                   .join(per_variant, "variant_id").groupBy("product_id")
                   .agg(F.sum("units").alias("total_sold")))
    return (star.shop.products.select("product_id", "name").join(per_product, "product_id", "left")
            .select("product_id", "name",
                    F.coalesce(F.col("total_sold"), F.lit(0)).cast("bigint").alias("total_sold")))
