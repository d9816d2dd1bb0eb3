"""Structured Streaming twins of the shop's incremental jobs.

The shop keeps totals and stock current with triggers; here change feeds
arrive as files and a streaming query keeps the same results current. Each
job must equal its batch twin once all input is processed:

- ``s_order_totals``: line-change feed (sign +1 insert / -1 delete) -> order
  totals; a streaming aggregation (state store) in update mode, merged into a
  versioned table by ``foreachBatch``;
- ``s_stock_ledger``: the same feed -> stock per variant, seeded from the
  static stock table;
- ``s_cancel_restores``: order-status feed -> stock given back once per
  transition into Cancelled, by ``foreachBatch`` against the stored changes of each
  order by sequence number, so that changes that arrive late or twice count as in order
  and once;
- ``s_cart_merge``: add-to-cart feed -> cart lines, by ``foreachBatch``
  running the bulk add-to-cart job against the stored lines (a plain running
  sum would count rejected events).

State tables live under the shared checkpoint folder
(``spark.checkpoint.dir``), or under a caller-given ``root`` so that a restarted
driver resumes the same stream. Keyed state uses the RocksDB state store. A micro-batch
rewrites only the key buckets it touches (``state.BucketedState``); a retried batch
writes the same files again (idempotent), and
the stream's own checkpoint makes restarts resume where they stopped. Feeds are
processed with ``trigger(availableNow=True)``: each arriving step of the feed
is one run of the same query.
"""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import TOTAL
from ..model import Shop
from ..operators import checkout
from ..session import ensure_checkpoint_dir, stored
from .state import BucketedState

CANCELLED = "Cancelled"


def scratch(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vitrine-streams/{name}-{uuid.uuid4().hex[:12]}"


STATE_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (on local disk, checkpointed to the
    shared folder) rather than on the JVM heap, unless the session already
    chose a provider: per-order state grows with the number of orders."""
    current = spark.conf.get(STATE_PROVIDER_CONF, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_PROVIDER_CONF, ROCKSDB_PROVIDER)


def run_steps(spark: SparkSession, steps: list[DataFrame], schema: T.StructType, root: str,
              start_query) -> None:
    """Append each feed step to the feed folder, then run the stream until it
    has consumed everything available (one availableNow run per step)."""
    feed = f"{root}/feed"
    ckpt = f"{root}/stream-checkpoint"
    for step in steps:
        step.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        q = start_query(stream, ckpt)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


# ---- line-change feed ---------------------------------------------------------
LINE_FEED = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("variant_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("sign", T.IntegerType())])


def line_feed_steps(shop: Shop) -> list[DataFrame]:
    """Every order line arrives (+1); then the lines of Cancelled orders are
    deleted (-1)."""
    lines = shop.order_details.select("order_id", "variant_id", "quantity", "price")
    cancelled = shop.orders.filter(F.col("status") == CANCELLED).select("order_id")
    return [lines.withColumn("sign", F.lit(1)),
            lines.join(cancelled, "order_id", "left_semi").withColumn("sign", F.lit(-1))]


def s_order_totals(shop: Shop, steps: list[DataFrame] | None = None,
                   root: str | None = None) -> DataFrame:
    spark = shop.spark
    resume = root is not None
    root = root or scratch(spark, "order-totals")
    table = BucketedState(spark, f"{root}/totals", keys=["order_id"], resume=resume,
                          seed=spark.createDataFrame([], "order_id long, total_amount decimal(38,2)"))

    def upsert(batch: DataFrame, b: int) -> None:
        table.upsert(b, batch)

    use_rocksdb_state(spark)

    def start(stream: DataFrame, ckpt: str):
        agg = (stream.groupBy("order_id")
               .agg(F.sum(F.col("sign") * F.col("quantity") * F.col("price")).cast(TOTAL)
                    .alias("total_amount")))
        return (agg.writeStream.outputMode("update").foreachBatch(upsert)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())

    run_steps(spark, steps or line_feed_steps(shop), LINE_FEED, root, start)
    return table.latest()


def s_stock_ledger(shop: Shop, steps: list[DataFrame] | None = None,
                   root: str | None = None) -> DataFrame:
    """Stock per variant: seed stock - sum(sign * quantity) of the feed; lines
    of unknown variants change nothing (the trigger's join skips them)."""
    spark = shop.spark
    resume = root is not None
    root = root or scratch(spark, "stock-ledger")
    seed = shop.product_variants.select("variant_id", F.col("stock").cast("long").alias("stock"))
    table = BucketedState(spark, f"{root}/stock", seed, ["variant_id"], resume, pinned=True)
    # The base stock is the seed this ledger once wrote, not the shop's present table,
    # which may already hold the ledger's own result after a restart.
    static = table.read(0).select("variant_id", F.col("stock").alias("_s0"))

    def upsert(batch: DataFrame, b: int) -> None:
        table.upsert(b, batch.join(static, "variant_id").select(
            "variant_id", (F.col("_s0") - F.col("_taken")).alias("stock")))

    use_rocksdb_state(spark)

    def start(stream: DataFrame, ckpt: str):
        agg = stream.groupBy("variant_id").agg(
            F.sum(F.col("sign") * F.col("quantity")).cast("long").alias("_taken"))
        return (agg.writeStream.outputMode("update").foreachBatch(upsert)
                .option("checkpointLocation", ckpt).trigger(availableNow=True).start())

    run_steps(spark, steps or line_feed_steps(shop), LINE_FEED, root, start)
    return table.latest()


# ---- order-status feed --------------------------------------------------------
STATUS_FEED = T.StructType([T.StructField("order_id", T.LongType()),
                            T.StructField("status", T.StringType()),
                            T.StructField("seq", T.LongType())])


def status_feed_steps(shop: Shop) -> list[DataFrame]:
    """Every order arrives with its status; then every order in Shipping is
    cancelled."""
    orders = shop.orders.select("order_id", "status")
    return [orders.withColumn("seq", F.lit(1).cast("long")),
            orders.filter(F.col("status") == "Shipping")
            .select("order_id", F.lit(CANCELLED).alias("status"), F.lit(2).cast("long").alias("seq"))]


def cancel_moves(before: DataFrame, changes: DataFrame) -> DataFrame:
    """order_id, moves: by how much ``changes`` (order_id, seq, status; none of them in
    ``before``) alter the count of moves into Cancelled from another status. An order's
    first status is an insert, not a move. A change that comes late may add a move or undo
    one (+1, -1)."""
    own = before.join(changes.select("order_id").distinct(), "order_id", "left_semi")
    rows = (own.select("order_id", "seq", "status", F.lit(False).alias("_new"))
            .unionByName(changes.select("order_id", "seq", "status", F.lit(True).alias("_new"))))
    w = Window.partitionBy("order_id").orderBy("seq")
    status = F.struct("status")
    rows = (rows.withColumn("_last", F.lag(status).over(w))
            .withColumn("_had", F.last(F.when(~F.col("_new"), status), ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, -1))))

    def moved(last: str):
        return ((F.col("status") == CANCELLED) & F.col(last).isNotNull()
                & ~F.col(f"{last}.status").eqNullSafe(CANCELLED))

    one = F.lit(1).cast("long")
    return (rows.groupBy("order_id")
            .agg((F.count(F.when(moved("_last"), one))
                  - F.count(F.when(~F.col("_new") & moved("_had"), one))).alias("moves"))
            .filter("moves <> 0"))


def s_cancel_restores(shop: Shop, steps: list[DataFrame] | None = None,
                      root: str | None = None) -> DataFrame:
    """Quantities given back per variant, once per transition into Cancelled
    (a first sighting of an order is an insert, not a transition)."""
    spark = shop.spark
    resume = root is not None
    root = root or scratch(spark, "cancel-restores")
    restored = BucketedState(spark, f"{root}/restored", keys=["variant_id"], resume=resume,
                             seed=spark.createDataFrame([], "variant_id long, restored long"))
    lines = shop.order_details.select("order_id", "variant_id", "quantity")

    def add(stored: DataFrame, changed: DataFrame) -> DataFrame:
        return (stored.unionByName(changed).groupBy("variant_id")
                .agg(F.sum("restored").cast("long").alias("restored")))

    # The status changes of each order by sequence number; one seen before is a replay.
    history = BucketedState(spark, f"{root}/history", keys=["order_id"], resume=resume,
                            seed=spark.createDataFrame([], STATUS_FEED))

    def apply(batch: DataFrame, b: int) -> None:
        changes = stored(
            batch.filter("order_id is not null and seq is not null").groupBy("order_id", "seq")
            .agg(F.min_by("status", F.coalesce("status", F.lit(""))).alias("status")))
        before = history.read_for(b, changes)
        fresh = changes.join(before, ["order_id", "seq"], "left_anti")
        back = (lines.join(cancel_moves(before, fresh), "order_id").groupBy("variant_id")
                .agg(F.sum(F.col("quantity") * F.col("moves")).cast("long").alias("restored")))
        restored.upsert(b, back, add)
        history.upsert(b, fresh, DataFrame.unionByName)

    def start(stream: DataFrame, ckpt: str):
        return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())

    run_steps(spark, steps or status_feed_steps(shop), STATUS_FEED, root, start)
    return restored.latest().filter("restored <> 0")


# ---- add-to-cart feed ---------------------------------------------------------
CART_FEED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("user_id", T.LongType()),
                          T.StructField("variant_id", T.LongType()),
                          T.StructField("quantity", T.IntegerType())])


def cart_feed_steps(events: DataFrame) -> list[DataFrame]:
    """The feed in two arrivals, split at the middle of the sequence range so
    that every event of the second arrival comes after the first's."""
    ev = events.select("seq", "user_id", "variant_id", "quantity")
    mid = ev.select(((F.min("seq") + F.max("seq")) / 2).cast("long")).scalar()
    return [ev.filter(F.col("seq") <= mid), ev.filter(F.col("seq") > mid)]


def s_cart_merge(shop: Shop, steps: list[DataFrame], root: str | None = None) -> DataFrame:
    spark = shop.spark
    resume = root is not None
    root = root or scratch(spark, "cart-merge")
    table = BucketedState(spark, f"{root}/cart-items", shop.cart_items, ["cart_id"], resume)

    def apply(batch: DataFrame, b: int) -> None:
        state = shop.with_tables(cart_items=table.read(b))
        after = checkout.p_bulk_add_to_cart(state, batch)["cart_items"]
        carts = (shop.cart.join(batch.select("user_id").distinct(), "user_id", "left_semi")
                 .select("cart_id").distinct())
        # Lines of the carts that the batch names; others stay in their files.
        table.upsert(b, after.join(carts, "cart_id", "left_semi"), lambda stored, changed: (
            stored.join(carts, "cart_id", "left_anti").unionByName(changed)))

    def start(stream: DataFrame, ckpt: str):
        return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())

    run_steps(spark, steps, CART_FEED, root, start)
    return table.latest().select("cart_id", "variant_id", "quantity")
