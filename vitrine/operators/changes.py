"""The shop's triggers, re-aimed as set-based jobs over change batches.

A trigger sees ``inserted`` / ``deleted`` images of one statement; here a batch
of any size arrives as DataFrames and each job returns the rows the trigger
would write (or reject). Every job aggregates per key before it joins, so a
hot variant or order is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL
from ..model import Shop
from ..plans.keys import next_keys

CANCELLED = "Cancelled"
COMPLETED = "Completed"


def t_stock_check(inserted: DataFrame, variants: DataFrame) -> DataFrame:
    """Inserted / updated lines whose quantity exceeds the variant's stock
    (checked against the stock before the batch)."""
    return (inserted.join(variants.select("variant_id", "stock"), "variant_id")
            .filter(F.col("quantity") > F.col("stock"))
            .select("order_detail_id", "order_id", "variant_id", "quantity", "stock"))


def _qty_per_variant(lines: DataFrame, alias: str) -> DataFrame:
    return lines.groupBy("variant_id").agg(F.sum("quantity").alias(alias))


def t_stock_delta(variants: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """New stock of every variant: stock + sum(deleted) - sum(inserted)."""
    d = _qty_per_variant(deleted, "_d")
    i = _qty_per_variant(inserted, "_i")
    return (variants.select("variant_id", "stock").join(d, "variant_id", "left")
            .join(i, "variant_id", "left")
            .select("variant_id",
                    (F.col("stock") + F.coalesce("_d", F.lit(0)) - F.coalesce("_i", F.lit(0)))
                    .cast("bigint").alias("stock")))


def affected_orders(inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """UNION (distinct) of the order ids in both images."""
    return inserted.select("order_id").union(deleted.select("order_id")).distinct()


def t_order_total_recompute(lines_after: DataFrame, inserted: DataFrame,
                            deleted: DataFrame) -> DataFrame:
    """Total of every affected order from the lines left after the change;
    an order with no line left gets 0."""
    touched = affected_orders(inserted, deleted)
    sums = (lines_after.join(touched, "order_id", "left_semi").groupBy("order_id")
            .agg(F.sum(F.col("quantity") * F.col("price")).alias("_t")))
    return touched.join(sums, "order_id", "left").select(
        "order_id", F.coalesce(F.col("_t"), F.lit(0)).cast(TOTAL).alias("total_amount"))


def t_cancel_restores_stock(before: DataFrame, after: DataFrame, lines: DataFrame,
                            variants: DataFrame) -> DataFrame:
    """Orders moving into Cancelled give their quantities back, summed per
    variant (several lines of one variant all count)."""
    moved = (after.filter(F.col("status") == CANCELLED).select("order_id")
             .join(before.filter(F.col("status") != CANCELLED).select("order_id"), "order_id"))
    back = (lines.join(moved, "order_id", "left_semi").groupBy("variant_id")
            .agg(F.sum("quantity").alias("restored")))
    return (variants.select("variant_id", F.col("stock").alias("stock_before")).join(back, "variant_id")
            .select("variant_id", "stock_before", F.col("restored").cast("bigint").alias("restored"),
                    (F.col("stock_before") + F.col("restored")).cast("bigint").alias("stock_after")))


def sold_products(variants: DataFrame, lines: DataFrame) -> DataFrame:
    sold_variants = lines.select("variant_id").distinct()
    return (variants.select("variant_id", "product_id").join(sold_variants, "variant_id", "left_semi")
            .select("product_id").distinct())


def t_sold_product_delete_guard(candidates: DataFrame, variants: DataFrame, lines: DataFrame,
                                mode: str = "row") -> DataFrame:
    """Split delete candidates into sold (blocked) and free. ``mode='batch'``
    blocks the whole batch when any candidate is sold, as the trigger does."""
    sold = sold_products(variants, lines).withColumn("_sold", F.lit(True))
    out = (candidates.select("product_id").distinct().join(sold, "product_id", "left")
           .select("product_id", F.coalesce(F.col("_sold"), F.lit(False)).alias("blocked")))
    if mode == "batch":
        # One global flag as a scalar subquery (a one-row aggregate).
        any_sold = out.select(F.max(F.col("blocked").cast("int"))).scalar()
        out = out.withColumn("blocked", F.coalesce(any_sold, F.lit(0)) == 1)
    return out


def purchases(orders: DataFrame, lines: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct (user, product) pairs with a Completed purchase."""
    done = orders.filter(F.col("status") == COMPLETED).select("order_id", "user_id")
    return (lines.select("order_id", "variant_id").join(done, "order_id")
            .join(variants.select("variant_id", "product_id"), "variant_id")
            .select("user_id", "product_id").distinct())


def t_review_purchase_check(batch: DataFrame, orders: DataFrame, lines: DataFrame,
                            variants: DataFrame, mode: str = "row") -> DataFrame:
    """A review is allowed only after a Completed purchase of that product by
    that user (a semi join to distinct purchases)."""
    ok = purchases(orders, lines, variants).withColumn("_ok", F.lit(True))
    out = (batch.join(ok, ["user_id", "product_id"], "left")
           .withColumn("allowed", F.coalesce(F.col("_ok"), F.lit(False))).drop("_ok"))
    if mode == "batch":
        all_ok = out.select(F.min(F.col("allowed").cast("int"))).scalar()
        out = out.withColumn("allowed", F.coalesce(all_ok, F.lit(1)) == 1)
    return out


def t_missing_carts(users: DataFrame, cart: DataFrame) -> DataFrame:
    """Users without a cart get one; new cart ids follow the largest one, in
    user id order."""
    missing = users.select("user_id").join(cart.select("user_id"), "user_id", "left_anti")
    return next_keys(missing, cart, "cart_id", [F.col("user_id").asc()]).select("cart_id", "user_id")


# ---- driver-run change batches (derived from the shop tables) ---------------
def demo_batches(shop: Shop) -> dict[str, DataFrame]:
    """Change batches of the driver run, chosen by status, not by id: lines of
    Pending orders arrive, lines of Cancelled orders leave, and every order in
    Shipping is cancelled."""
    lines = shop.order_details
    pending = shop.orders.filter(F.col("status") == "Pending").select("order_id")
    cancelled = shop.orders.filter(F.col("status") == CANCELLED).select("order_id")
    return {
        "inserted": lines.join(pending, "order_id", "left_semi"),
        "deleted": lines.join(cancelled, "order_id", "left_semi"),
        "lines_after": lines.join(cancelled, "order_id", "left_anti"),
        "after": shop.orders.withColumn(
            "status", F.when(F.col("status") == "Shipping", F.lit(CANCELLED))
            .otherwise(F.col("status"))),
    }
