"""Bucketed snapshots: star joins without a shuffle of the facts.

Order lines are stored twice, bucketed by ``variant_id`` and by ``order_id``; variants
(with their size, colour and product columns) and order headers (with the customer's)
are bucketed by the same keys into the same number of buckets. A join on the bucket key
reads bucket n of both sides in one task; neither side moves. The copy by order carries
the columns of each line's variant, joined once when the snapshot is written, so a view
that needs both dimensions has a single join left.

A snapshot is consistent in itself: all its tables come from one state of the shop, whose
files must stay as they are meanwhile. Each table is written when a query first reads it
and pays one shuffle then; every later query on the snapshot pays none on the
lines. ``buckets_for`` grows the number of buckets with the lines, so that a task can sort
one in memory.

Files go to the shared checkpoint folder (or ``root``), the catalog holds their bucket
specification. A hot variant fills one bucket: the share of one variant among all lines
bounds what one task reads, and a join may be given the plain tables where that is too
much (``Shop`` itself is unchanged).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Shop
from ..operators import shared
from ..session import ensure_checkpoint_dir

BUCKETS = 64
#: Order lines of a bucket, about.
BUCKET_LINES = 1_500_000


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """One file per bucket: rows are dealt by the same hash as buckets are."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))


@dataclass
class StarSnapshot:
    """Names of the tables of one snapshot in the session's catalog."""

    spark: SparkSession
    prefix: str
    shop: Shop
    #: What writes each table that no query has read yet.
    pending: dict[str, Callable[[], None]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.pending:
            self.pending[name]()
            del self.pending[name]
        return self.spark.table(f"{self.prefix}_{name}")

    def drop(self) -> None:
        """Forget the catalog's entries; the files stay where they are."""
        for name in ("lines_by_variant", "lines_by_order", "variants", "headers"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def buckets_for(shop: Shop, least: int) -> int:
    return max(least, -(-shop.order_details.count() // BUCKET_LINES))


def build(shop: Shop, buckets: int = BUCKETS, root: str | None = None) -> StarSnapshot:
    spark = shop.spark
    prefix = f"vitrine_star_{uuid.uuid4().hex[:12]}"
    root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/vitrine-star").rstrip("/")

    star = StarSnapshot(spark, prefix, shop)

    def store(name: str, df: Callable[[], DataFrame], key: str) -> None:
        star.pending[name] = lambda: write_bucketed(
            df(), f"{prefix}_{name}", f"{root}/{prefix}/{name}", key, buckets)

    store("variants", lambda: shared.variant_dim(shop).join(
        shared.top1_first_image(shop), "product_id", "left"), "variant_id")
    store("headers", lambda: shop.orders.select(
        "order_id", "order_date", F.col("status").alias("order_status"), "user_id").join(
        shop.users.select("user_id", F.col("name").alias("customer_name"), "email"), "user_id"),
        "order_id")
    # Without order_detail_id, which only the copy by order shows: numbering lines moves them.
    store("lines_by_variant", lambda: shop.order_details.select(
        "order_id", "variant_id", "quantity", "price"), "variant_id")
    store("lines_by_order", lambda: shop.order_details.join(
        star.table("variants").select("variant_id", "product_id", "product_name", "size_name",
                                      "color_name", "image_url"), "variant_id"), "order_id")
    return star
