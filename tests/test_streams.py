"""Streaming jobs equal their batch twins once all input is processed."""

from pyspark.sql import functions as F

from vitrine.operators import changes as C
from vitrine.operators import checkout as K
from vitrine.streaming import feeds as S


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cart_merge_stream_equals_batch(spark, shop_small):
    from vitrine.registry import _request_feed
    feed = _request_feed(shop_small).select("seq", "user_id", "variant_id", "quantity")
    streamed = S.s_cart_merge(shop_small, S.cart_feed_steps(feed))
    batch = K.p_bulk_add_to_cart(shop_small, feed)["cart_items"]
    cols = ["cart_id", "variant_id", "quantity"]
    assert rows(streamed, cols) == rows(batch, cols)


def test_cancel_restores_stream_equals_trigger_job(spark, shop_small):
    streamed = S.s_cancel_restores(shop_small)
    after = shop_small.orders.withColumn(
        "status", F.when(F.col("status") == "Shipping", F.lit("Cancelled")).otherwise(F.col("status")))
    batch = C.t_cancel_restores_stock(shop_small.orders, after, shop_small.order_details,
                                      shop_small.product_variants)
    known = streamed.join(shop_small.product_variants.select("variant_id"), "variant_id")
    assert rows(known, ["variant_id", "restored"]) == rows(batch, ["variant_id", "restored"])


def test_order_totals_stream_equals_recompute(spark, shop_small):
    streamed = S.s_order_totals(shop_small)
    b = C.demo_batches(shop_small)
    # Every order's lines arrive, then Cancelled orders' lines leave.
    batch = C.t_order_total_recompute(b["lines_after"], shop_small.order_details, b["deleted"])
    assert rows(streamed, ["order_id", "total_amount"]) == rows(batch, ["order_id", "total_amount"])


def test_order_totals_stream_resumes_after_restart(spark, shop_small):
    steps = S.line_feed_steps(shop_small)
    root = S.scratch(spark, "restart-test")
    S.s_order_totals(shop_small, steps[:1], root=root)        # first arrival, then stop
    resumed = S.s_order_totals(shop_small, steps[1:], root=root)
    once = S.s_order_totals(shop_small)
    assert rows(resumed, ["order_id", "total_amount"]) == rows(once, ["order_id", "total_amount"])


# ---- keyed state and partial snapshots -------------------------------------------
FEED = "order_id long, status string, seq long"


def _cancel_shop(spark):
    from vitrine.sources.tables import load_seed
    lines = [(1, 1, 10, 2), (2, 1, 11, 3), (3, 2, 10, 5), (4, 3, 12, 7)]
    from decimal import Decimal
    return load_seed(spark, {"order_details": [(*x, Decimal("1.00")) for x in lines]})


def _expected(history, lines={1: {10: 2, 11: 3}, 2: {10: 5}, 3: {12: 7}}):
    """Restores of the whole history taken in order of its sequence numbers."""
    out = {}
    orders = {}
    for order, status, seq in history:
        orders.setdefault(order, {}).setdefault(seq, status)
    for order, by_seq in orders.items():
        last = None
        for seq in sorted(by_seq):
            if by_seq[seq] == "Cancelled" and last not in (None, "Cancelled"):
                for v, q in lines.get(order, {}).items():
                    out[v] = out.get(v, 0) + q
            last = by_seq[seq]
    return sorted(out.items())


def test_cancel_restores_of_late_and_replayed_changes(spark):
    history = [(1, "Pending", 1), (1, "Cancelled", 3), (2, "Cancelled", 1), (3, "Pending", 1),
               (1, "Cancelled", 9), (2, "Pending", 2), (2, "Cancelled", 5), (1, "Pending", 6),
               (3, "Shipping", 4), (2, "Cancelled", 5), (1, "Cancelled", 2), (9, "Cancelled", 8)]
    shop = _cancel_shop(spark)
    want = _expected(history)
    assert want
    one = S.s_cancel_restores(shop, [spark.createDataFrame(history, FEED)])
    assert rows(one, ["variant_id", "restored"]) == want
    parts = [history[8:], history[:5], history[:8]]  # late first, then a replay
    many = S.s_cancel_restores(shop, [spark.createDataFrame(p, FEED) for p in parts])
    assert rows(many, ["variant_id", "restored"]) == want


def test_cancel_restores_resumes_after_restart(spark):
    history = [(1, "Pending", 1), (2, "Pending", 1), (1, "Cancelled", 2), (2, "Cancelled", 7),
               (2, "Shipping", 4), (2, "Cancelled", 3)]
    shop = _cancel_shop(spark)
    root = S.scratch(spark, "cancel-restart")
    S.s_cancel_restores(shop, [spark.createDataFrame(history[:3], FEED)], root=root)
    got = S.s_cancel_restores(shop, [spark.createDataFrame(history[3:], FEED)], root=root)
    assert rows(got, ["variant_id", "restored"]) == _expected(history)


def test_state_rewrites_only_touched_buckets_and_forgets_old_files(spark):
    from vitrine.streaming.state import BucketedState
    table = BucketedState(spark, S.scratch(spark, "state-test"), keys=["id"], buckets=16,
                          seed=spark.range(1000).selectExpr("id", "0L as n"))
    first = table.placement(0)
    want = {i: 0 for i in range(1000)}
    for b in range(4):
        changed = spark.createDataFrame([(7, b + 1), (5000 + b, b)], "id long, n long")
        table.upsert(b, changed)
        table.upsert(b, changed)  # a retried batch
        want |= {7: b + 1, 5000 + b: b}
        assert dict(rows(table.read(b + 1), ["id", "n"])) == want
    now = table.placement(4)
    touched = {k for k in now if now[k] != first[k]}
    assert 1 <= len(touched) <= 5 and len(now) == 16
    assert not table._exists(table._manifest(1)) and table._exists(table._manifest(3))
    seventh = spark.range(1).selectExpr("pmod(xxhash64(7L), 16) as b").first().b
    assert not table._exists(table._data(1, seventh)) and table._exists(table._data(4, seventh))
    resumed = BucketedState(spark, table.path, spark.range(0).selectExpr("id", "0L as n"), ["id"],
                            resume=True, buckets=16)
    assert resumed.last == 4 and dict(rows(resumed.latest(), ["id", "n"])) == want


def test_cancel_restores_keeps_no_state_in_python(spark):
    before = spark.createDataFrame([(1, "Pending", 1), (1, "Cancelled", 5), (2, None, 1)], FEED)
    changes = spark.createDataFrame([(1, "Cancelled", 3), (1, "Pending", 4), (2, "Cancelled", 2),
                                     (3, "Cancelled", 1)], FEED)
    df = S.cancel_moves(before, changes)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df, ["order_id", "moves"]) == [(1, 1), (2, 1)]
    undone = S.cancel_moves(before, spark.createDataFrame([(1, "Cancelled", 2)], FEED))
    assert rows(undone, ["order_id", "moves"]) == []
