"""Deletes that return the tables after them.

``apply_delete`` follows the foreign-key graph from the rows deleted: CASCADE edges
remove rows, SET NULL edges clear the referring column. The graph has no cycle, so each
table is settled once, after all tables it refers to: one semi or anti join per edge on
the keys that went, never on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shop
from .audits import FOREIGN_KEYS, PRIMARY_KEYS
from .changes import sold_products


def settling_order(edges: list[tuple]) -> list[str]:
    """Tables of a foreign-key graph, each after all tables it refers to."""
    parents: dict[str, set[str]] = {}
    for child, _, parent, _, _ in edges:
        parents.setdefault(child, set()).add(parent)
        parents.setdefault(parent, set())
    order: list[str] = []
    while len(order) < len(parents):
        ready = sorted(t for t, p in parents.items() if t not in order and p <= set(order))
        if not ready:
            raise ValueError("the foreign keys form a cycle")
        order += ready
    return order


def apply_delete(shop: Shop, deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a delete of the given keys changes, after it. ``deleted`` maps a
    table to a DataFrame with its primary key columns; unknown keys change nothing."""
    gone: dict[str, DataFrame] = {}
    after: dict[str, DataFrame] = {}
    for table in settling_order(FOREIGN_KEYS):
        rows = getattr(shop, table)
        key = PRIMARY_KEYS[table]
        edges = [(col, parent, action) for child, col, parent, _, action in FOREIGN_KEYS
                 if child == table and parent in gone and action in ("cascade", "set null")]
        lost = []
        if table in deleted:
            lost.append(rows.join(deleted[table].select(*key).distinct(), key, "left_semi"))
        left = rows
        for col, parent, action in edges:
            parent_keys = gone[parent].select(F.col(PRIMARY_KEYS[parent][0]).alias("_gone"))
            if action == "set null":
                left = (left.join(parent_keys, F.col(col) == F.col("_gone"), "left")
                        .withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).drop("_gone"))
            else:
                lost.append(rows.join(parent_keys, F.col(col) == F.col("_gone"), "left_semi"))
        if lost:
            keys = lost[0].select(*key)
            for more in lost[1:]:
                keys = keys.unionByName(more.select(*key))
            gone[table] = keys.distinct() if len(lost) > 1 else keys
            left = left.join(gone[table], key, "left_anti")
        if edges or lost:
            after[table] = left.select(*rows.columns)
    return after


def w_product_delete(shop: Shop, requests: DataFrame) -> dict[str, DataFrame]:
    """Admin product deletes (seq, product_id), decided in order of ``seq``.

    Refused: a missing or zero id, an unknown product (one that an earlier request of the
    batch deleted is unknown too), and a product with an order line of one of its
    variants. Returns the outcome and each table that the cascade changes.
    """
    asked = requests.select("seq", F.col("product_id").cast("long").alias("product_id"))
    known = shop.products.select("product_id").withColumn("_known", F.lit(True))
    sold = sold_products(shop.product_variants, shop.order_details).withColumn("_sold", F.lit(True))
    first = (asked.filter(F.coalesce("product_id", F.lit(0)) != 0).groupBy("product_id")
             .agg(F.min("seq").alias("_first")))
    # One row per product decides; requests join it back, however many name a product.
    decided = (first.join(known, "product_id", "left").join(sold, "product_id", "left"))
    out = asked.join(decided, "product_id", "left")
    reason = (F.when(F.coalesce("product_id", F.lit(0)) == 0, F.lit("invalid id"))
              .when(F.col("_known").isNull(), F.lit("product not found"))
              .when(F.col("_sold").isNotNull(), F.lit("product was sold"))
              .when(F.col("seq") > F.col("_first"), F.lit("product not found")))
    out = out.withColumn("reason", reason)
    deleted = decided.filter("_known is not null and _sold is null").select("product_id")
    return {"outcome": out.select("seq", "product_id", F.col("reason").isNull().alias("accepted"),
                                  "reason"),
            **apply_delete(shop, {"products": deleted})}
