"""Product roll-ups kept current under inserts, edits and deletes.

The batch roll-ups (``shared.agg_variant_rollup``, ``shared.agg_review_rollup``) read a
whole table. Here change feeds with a sign (+1 a row appears, -1 it goes; an edit is
both) keep the same results. A running MIN cannot take back a deleted price, so what is
kept per product is how often each value occurs: a value goes when its count falls to
zero, and the next one is the minimum by itself. Sums and counts come from the same
rows, and the rows of a product number its different values, not its changes.

A micro-batch adds its changes up by product and value before anything is shuffled
further, rewrites the touched key buckets of the counts (``state.BucketedState``) and
then, from those buckets alone, the roll-ups of the touched products. A retried batch
starts from the version before it, so it counts once.

Defined cases: a delete that arrives in an earlier batch than its insert is held as a
negative count, which no MIN or MAX sees, until the insert settles it; a product whose
rows are all gone has no roll-up row; NULL prices and ratings count as rows but not in
MIN, MAX and the average; changes of a NULL product are left out, as no product has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Shop
from .feeds import run_steps, scratch
from .state import BucketedState

VARIANT_FEED = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("stock", T.IntegerType()), T.StructField("sign", T.IntegerType())])
REVIEW_FEED = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("rating", T.IntegerType()),
    T.StructField("sign", T.IntegerType())])


def _n_where(c: Column) -> Column:
    return F.when(c & (F.col("n") > 0), F.col("n")).otherwise(F.lit(0))


def variant_rollup(counts: DataFrame) -> DataFrame:
    held = F.col("n") > 0
    return (counts.groupBy("product_id")
            .agg(F.sum("n").alias("total_variants"), F.sum("stock").alias("total_stock"),
                 F.min(F.when(held, F.col("price"))).alias("min_price"),
                 F.max(F.when(held, F.col("price"))).alias("max_price"))
            .filter("total_variants > 0"))


def review_rollup(counts: DataFrame) -> DataFrame:
    rated = F.sum(_n_where(F.col("rating").isNotNull())).cast("decimal(20,0)")
    total = F.sum(_n_where(F.col("rating").isNotNull()) * F.col("rating")).cast("decimal(20,2)")
    # Six digits, then two: as the average of the batch roll-up is rounded.
    return (counts.groupBy("product_id")
            .agg((total / F.nullif(rated, F.lit(0))).cast("decimal(14,6)").cast("decimal(10,2)")
                 .alias("avg_rating"), F.sum("n").alias("review_count"))
            .filter("review_count > 0"))


def _keep_rollup(shop: Shop, steps: list[DataFrame], feed: T.StructType, root: str, resume: bool,
                 value: str, summed: dict[str, Column],
                 rollup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the feed's steps; ``value`` is counted per product, ``summed`` names columns
    added up beside the counts."""
    spark = shop.spark
    sums = {"n": F.col("sign").cast("long"), **summed}
    no_change = spark.createDataFrame([], feed)
    seed = no_change.select("product_id", value, *[c.alias(k) for k, c in sums.items()])
    counts = BucketedState(spark, f"{root}/counts", seed, ["product_id"], resume)
    table = BucketedState(spark, f"{root}/rollup", rollup(seed), ["product_id"], resume)

    def add(stored: DataFrame, changed: DataFrame) -> DataFrame:
        both = stored.unionByName(changed).groupBy("product_id", value).agg(
            *[F.sum(k).alias(k) for k in sums])
        return both.filter(" OR ".join(f"coalesce({k}, 0) <> 0" for k in sums))

    def replace(stored: DataFrame, changed: DataFrame) -> DataFrame:
        count = table.schema.names[1:]
        return (stored.join(changed.select("product_id"), "product_id", "left_anti")
                .unionByName(changed.filter(" OR ".join(f"{c} IS NOT NULL" for c in count))))

    def upsert(batch: DataFrame, b: int) -> None:
        delta = (batch.filter("product_id IS NOT NULL").groupBy("product_id", value)
                 .agg(*[F.sum(c).alias(k) for k, c in sums.items()]).checkpoint())
        counts.upsert(b, delta, add)
        touched = delta.select("product_id").distinct()
        now = rollup(counts.read_for(b + 1, touched).join(touched, "product_id", "left_semi"))
        table.upsert(b, touched.join(now, "product_id", "left"), replace)

    def start(stream: DataFrame, ckpt: str):
        return (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())

    run_steps(spark, steps, feed, root, start)
    return table.latest()


def s_variant_rollup(shop: Shop, steps: list[DataFrame] | None = None,
                     root: str | None = None) -> DataFrame:
    """``agg_variant_rollup`` of what the feed leaves: variants, stock, lowest and
    highest price per product."""
    return _keep_rollup(shop, steps or variant_feed_steps(shop), VARIANT_FEED,
                        root or scratch(shop.spark, "variant-rollup"), root is not None, "price",
                        {"stock": (F.col("sign") * F.col("stock")).cast("long")}, variant_rollup)


def s_review_rollup(shop: Shop, steps: list[DataFrame] | None = None,
                    root: str | None = None) -> DataFrame:
    """``agg_review_rollup`` of what the feed leaves: average rating and count."""
    return _keep_rollup(shop, steps or review_feed_steps(shop), REVIEW_FEED,
                        root or scratch(shop.spark, "review-rollup"), root is not None, "rating",
                        {}, review_rollup)


def _three_steps(rows: DataFrame, edit: Column, edits: dict[str, Column], gone: Column,
                 names: list[str]) -> list[DataFrame]:
    """Every row appears; some are edited; some, edited ones among them, go."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*names, F.lit(sign).alias("sign"))

    edited = rows.select(*[F.when(edit, edits[c]).otherwise(F.col(c)).alias(c) if c in edits
                           else F.col(c) for c in rows.columns])
    return [signed(rows, 1),
            signed(rows.filter(edit), -1).unionByName(signed(edited.filter(edit), 1)),
            signed(edited.filter(gone), -1)]


def variant_feed_steps(shop: Shop) -> list[DataFrame]:
    """Each fourth product gets cheaper and one more in stock; then each fifth variant
    and each seventh product go."""
    rows = shop.product_variants.select("variant_id", "product_id", "price", "stock")
    return _three_steps(rows, F.col("product_id") % 4 == 0, {
        "price": (F.col("price") - 1).cast("decimal(10,2)"), "stock": (F.col("stock") + 1).cast("int")},
        (F.col("variant_id") % 5 == 0) | (F.col("product_id") % 7 == 0),
        ["product_id", "price", "stock"])


def review_feed_steps(shop: Shop) -> list[DataFrame]:
    """Each third review turns its rating round; then each fifth review and those of
    each eleventh product go."""
    rows = shop.reviews.select("review_id", "product_id", "rating")
    return _three_steps(rows, F.col("review_id") % 3 == 0, {
        "rating": (6 - F.col("rating")).cast("int")},
        (F.col("review_id") % 5 == 0) | (F.col("product_id") % 11 == 0),
        ["product_id", "rating"])
