"""Prices and sales at the time of each order.

The shop's views price a product at one time for all rows. Here each order line meets the
sales that were in force at its own order's time (``plans.intervals``). A sale is in force
from its start to its end, both included; of several, the largest percent counts, as in
the views.

Defined cases: an order without a date has no sale in force and keeps the list price;
lines of unknown variants or orders are left out, as in ``v_order_item_detail``; a
product put into a sale twice is in it once; prices are today's list prices, as the shop
keeps no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL, line_total, rounded_discounted
from ..model import Shop
from ..plans.intervals import in_force


def _lines(shop: Shop) -> DataFrame:
    variants = shop.product_variants.select("variant_id", "product_id",
                                            F.col("price").alias("list_price"))
    # Orders first: lines of a time that the caller does not ask for move once.
    return (shop.order_details.select("order_id", "variant_id", "quantity", "price")
            .join(shop.orders.select("order_id", "order_date"), "order_id")
            .join(variants, "variant_id"))


def _product_sales(shop: Shop) -> DataFrame:
    sales = shop.sales.select("sale_id", "discount_percent", "start_date", "end_date")
    return shop.product_sales.select("product_id", "sale_id").distinct().join(sales, "sale_id")


def price_at_order(shop: Shop) -> DataFrame:
    """Each order line with the best discount of its product when it was ordered, the
    price and line total that follow, and what was paid for one."""
    lines = _lines(shop)
    times = lines.select("product_id", "order_date").distinct()
    best = (in_force(times, _product_sales(shop), ["product_id"], "order_date",
                     "start_date", "end_date")
            .groupBy("product_id", "order_date")
            .agg(F.max("discount_percent").alias("discount_percent")))
    pct = F.coalesce("discount_percent", F.lit(0))
    return (lines.join(best, ["product_id", "order_date"], "left")
            .select("order_id", "variant_id", "product_id", "order_date", "quantity",
                    F.col("price").alias("paid_price"), "list_price", "discount_percent",
                    rounded_discounted(F.col("list_price"), pct).alias("price_then"),
                    line_total(F.col("quantity"), F.col("list_price"), pct).alias("line_then")))


def sale_results(shop: Shop) -> DataFrame:
    """Per sale what was ordered of its products while it was in force: lines, units and
    the sum paid. Lines are added up by product and time before they meet the sales; a
    line counts for every sale it falls into."""
    sums = (_lines(shop).groupBy("product_id", "order_date")
            .agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"),
                 F.sum(line_total(F.col("quantity"), F.col("price"))).alias("paid")))
    per_sale = (in_force(sums, _product_sales(shop), ["product_id"], "order_date",
                         "start_date", "end_date")
                .groupBy("sale_id")
                .agg(*[F.sum(c).alias(c) for c in ("lines", "units", "paid")]))
    return (shop.sales.select("sale_id", F.col("name").alias("sale_name"), "discount_percent")
            .join(per_sale, "sale_id", "left")
            .select("sale_id", "sale_name", "discount_percent",
                    F.coalesce("lines", F.lit(0)).cast("bigint").alias("total_lines"),
                    F.coalesce("units", F.lit(0)).cast("bigint").alias("total_units"),
                    F.coalesce("paid", F.lit(0)).cast(TOTAL).alias("total_paid")))
