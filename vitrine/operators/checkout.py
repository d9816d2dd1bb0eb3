"""Order-dependent bulk jobs: checkout of many carts, add-to-cart events and
review batches. Each returns a per-request outcome and the next version of every
table that it changes (whole tables, ready for ``Shop.with_tables``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import TOTAL
from ..functions.text import sql_len
from ..model import Shop
from ..plans.allocate import allocate_in_order
from ..plans.keys import next_keys
from .changes import purchases

PENDING = "Pending"


def p_bulk_checkout(shop: Shop, requests: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Turn the carts of the requesting users into orders.

    Carts are decided in ascending cart_id, all-or-nothing: a user without a
    cart, an empty cart, or a line above the stock left by earlier accepted
    carts rejects the cart (it takes nothing). Lines carry the list price (no
    discount); stock falls once; the total is sum(q * p); accepted carts are
    emptied. Lines of unknown variants are skipped, as the procedure's join
    skips them.
    """
    t = F.lit(as_of or shop.as_of).cast("timestamp")
    req = requests.select("user_id").distinct().join(shop.cart.select("cart_id", "user_id"),
                                                     "user_id", "left")
    items = shop.cart_items.join(req.select("cart_id"), "cart_id", "left_semi")
    nonempty = items.select("cart_id").distinct().withColumn("_has", F.lit(True))
    priced = items.join(shop.product_variants.select("variant_id", "price", "stock"), "variant_id")
    decided = allocate_in_order(
        priced.select(F.col("cart_id").alias("req_id"), F.col("cart_id").alias("seq"),
                      "variant_id", F.col("quantity").alias("qty")),
        shop.product_variants.select("variant_id", F.col("stock").alias("cap")), ["variant_id"])
    verdict = decided.select(F.col("req_id").alias("cart_id"), "accepted")
    out = (req.join(nonempty, "cart_id", "left").join(verdict, "cart_id", "left")
           .withColumn("reason",
                       F.when(F.col("cart_id").isNull(), F.lit("no cart"))
                        .when(F.col("_has").isNull(), F.lit("empty cart"))
                        .when(F.col("accepted") == F.lit(False), F.lit("insufficient stock")))
           .withColumn("accepted", F.col("reason").isNull()))
    accepted_carts = out.filter("accepted").select("cart_id", "user_id")
    totals = (priced.join(accepted_carts, "cart_id", "left_semi").groupBy("cart_id")
              .agg(F.sum(F.col("quantity") * F.col("price")).cast(TOTAL).alias("total_amount")))
    new_orders = (next_keys(accepted_carts, shop.orders, "order_id", [F.col("cart_id").asc()])
                  .join(totals, "cart_id", "left")
                  .select("order_id", "user_id", t.alias("order_date"), F.lit(PENDING).alias("status"),
                          "total_amount", "cart_id"))
    new_lines = (priced.join(new_orders.select("cart_id", "order_id"), "cart_id")
                 .select("order_id", "variant_id", "quantity", "price"))
    new_lines = next_keys(new_lines, shop.order_details, "order_detail_id",
                          [F.col("order_id").asc(), F.col("variant_id").asc()])
    taken = new_lines.groupBy("variant_id").agg(F.sum("quantity").alias("_taken"))
    stock = (shop.product_variants.join(taken, "variant_id", "left")
             .withColumn("stock", (F.col("stock") - F.coalesce(F.col("_taken"), F.lit(0))).cast("int"))
             .drop("_taken"))
    cart_items = shop.cart_items.join(accepted_carts.select("cart_id"), "cart_id", "left_anti")
    outcome = (out.join(new_orders.select("cart_id", "order_id", "total_amount"), "cart_id", "left")
               .select("user_id", "cart_id", "accepted", "reason", "order_id", "total_amount"))
    stored = new_orders.select(
        "order_id", "user_id",
        F.col("order_date").cast(shop.orders.schema["order_date"].dataType).alias("order_date"),
        "status", F.col("total_amount").cast(shop.orders.schema["total_amount"].dataType)
        .alias("total_amount"))
    return {"outcome": outcome, "orders": shop.orders.unionByName(stored),
            "order_details": shop.order_details.unionByName(new_lines),
            "product_variants": stock.select(*shop.product_variants.columns),
            "cart_items": cart_items}


def p_bulk_add_to_cart(shop: Shop, events: DataFrame) -> dict[str, DataFrame]:
    """Apply add-to-cart events (seq, user_id, variant_id, quantity) in seq order.

    quantity <= 0, no cart, or an unknown variant rejects the event; so does a
    running quantity above the stock - and a rejected event does not count
    towards later ones (each (cart, variant) is a resource whose capacity is
    stock minus what the cart already holds). Accepted quantities are summed
    into the cart lines (update or insert).
    """
    ev = (events.select("seq", "user_id", "variant_id", "quantity")
          .join(shop.cart.select("cart_id", "user_id"), "user_id", "left")
          .join(shop.product_variants.select("variant_id", "stock"), "variant_id", "left"))
    reason = (F.when(F.coalesce(F.col("quantity") <= 0, F.lit(True)),
                     F.lit("invalid quantity"))
              .when(F.col("cart_id").isNull(), F.lit("no cart"))
              .when(F.col("stock").isNull(), F.lit("unknown variant")))
    ev = ev.withColumn("reason", reason)
    candidates = ev.filter(F.col("reason").isNull())
    held = shop.cart_items.select("cart_id", "variant_id", F.col("quantity").alias("_held"))
    cap = (candidates.select("cart_id", "variant_id", "stock").distinct()
           .join(held, ["cart_id", "variant_id"], "left")
           .select("cart_id", "variant_id",
                   (F.col("stock") - F.coalesce(F.col("_held"), F.lit(0))).alias("cap")))
    decided = allocate_in_order(
        candidates.select(F.col("seq").alias("req_id"), "seq", "cart_id", "variant_id",
                          F.col("quantity").alias("qty")),
        cap, ["cart_id", "variant_id"])
    outcome = (ev.join(decided.select(F.col("req_id").alias("seq"), F.col("accepted").alias("_ok")),
                       "seq", "left")
               .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                           .when(~F.col("_ok"), F.lit("insufficient stock")))
               .select("seq", "user_id", "cart_id", "variant_id", "quantity",
                       F.col("reason").isNull().alias("accepted"), "reason"))
    added = (outcome.filter("accepted").groupBy("cart_id", "variant_id")
             .agg(F.sum("quantity").alias("_add")))
    merged = (shop.cart_items.join(added, ["cart_id", "variant_id"], "full")
              .withColumn("quantity", (F.coalesce(F.col("quantity"), F.lit(0))
                                       + F.coalesce(F.col("_add"), F.lit(0))).cast("int")))
    kept = merged.filter(F.col("cart_item_id").isNotNull()).select(
        "cart_item_id", "cart_id", "variant_id", "quantity")
    fresh = next_keys(merged.filter(F.col("cart_item_id").isNull()).select("cart_id", "variant_id",
                                                                           "quantity"),
                      shop.cart_items, "cart_item_id",
                      [F.col("cart_id").asc(), F.col("variant_id").asc()])
    cart_items = kept.unionByName(fresh.select("cart_item_id", "cart_id", "variant_id", "quantity"))
    return {"outcome": outcome, "cart_items": cart_items}


def p_bulk_review_insert(shop: Shop, batch: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Insert a batch of reviews (seq, user_id, product_id, rating, comment).

    Rejected with a reason: rating outside 1-5, no Completed purchase of the
    product by the user (the purchase trigger, per row), comment shorter than
    5 characters, or a (user, product) review that already exists or came
    earlier in the batch. Accepted reviews get new ids in seq order.
    """
    t = F.lit(as_of or shop.as_of).cast("timestamp")
    ok_buy = purchases(shop.orders, shop.order_details, shop.product_variants) \
        .withColumn("_bought", F.lit(True))
    existing = shop.reviews.select("user_id", "product_id").distinct() \
        .withColumn("_exists", F.lit(True))
    b = (batch.join(ok_buy, ["user_id", "product_id"], "left")
         .join(existing, ["user_id", "product_id"], "left"))
    reason = (F.when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)),
                     F.lit("rating out of range"))
              .when(F.col("_bought").isNull(), F.lit("no purchase"))
              .when(F.coalesce(sql_len(F.col("comment")) < 5, F.lit(False)), F.lit("comment too short"))
              .when(F.col("_exists").isNotNull(), F.lit("duplicate review")))
    b = b.withColumn("reason", reason)
    first = (b.filter(F.col("reason").isNull()).groupBy("user_id", "product_id")
             .agg(F.min("seq").alias("_first")))
    b = (b.join(first, ["user_id", "product_id"], "left")
         .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                     .when(F.col("seq") != F.col("_first"), F.lit("duplicate review"))))
    outcome = b.select("seq", "user_id", "product_id", "rating", "comment",
                       F.col("reason").isNull().alias("accepted"), "reason")
    fresh = next_keys(outcome.filter("accepted"), shop.reviews, "review_id", [F.col("seq").asc()])
    reviews = shop.reviews.unionByName(
        fresh.select("review_id", "user_id", "product_id", "rating", "comment",
                     t.cast(shop.reviews.schema["review_date"].dataType).alias("review_date")))
    return {"outcome": outcome, "reviews": reviews}


# ---- driver-run request feeds (derived from the events table) ---------------
def shop_requests(events: DataFrame, n_parts, n_products) -> DataFrame:
    """Every driver event read as shop requests: an add-to-cart of variant
    (event_id * 17) mod parts and a review of product (event_id * 31) mod
    products. Some quantities are 0 or NULL, some ratings out of range, some
    comments too short or NULL, so that every rule has something to refuse."""
    n = F.col("event_id")
    return events.select(
        n.alias("seq"), "user_id", ((n * 17) % n_parts).alias("variant_id"),
        F.when(n % 97 != 0, n % 4).cast("int").alias("quantity"),
        ((n * 31) % n_products).alias("product_id"),
        F.when(n % 89 != 0, n % 7).cast("int").alias("rating"),
        F.when(n % 9 == 0, F.lit("ok")).when(n % 10 != 0, F.concat(F.lit("review "),
                                                                   n.cast("string")))
        .alias("comment"))
