"""Roll-ups under deletes against the batch roll-ups of what is left."""

import os
import random
from collections import Counter
from decimal import Decimal

from vitrine.operators import shared as SH
from vitrine.streaming import rollups as RU

V = "product_id long, price decimal(10,2), stock int, sign int"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _variants(spark, steps, shop, root=None):
    frames = [spark.createDataFrame(s, V) for s in steps]
    return _rows(RU.s_variant_rollup(shop, frames, root))


def _left(rows):
    """Batch result of a bag of (product, price, stock)."""
    out = {}
    for (p, price, stock), n in rows.items():
        out.setdefault(p, []).extend([(price, stock)] * n)
    return sorted((p, len(x), sum(s for _, s in x), min(a for a, _ in x), max(a for a, _ in x))
                  for p, x in out.items() if x)


def test_random_changes_equal_the_batch(spark, shop_small):
    rng = random.Random(9)
    bag, steps = Counter(), []
    for _ in range(4):
        step = []
        for _ in range(120):
            if rng.random() < 0.45 and +bag:
                row, sign = rng.choice(sorted((+bag).elements())), -1
            else:  # product 0 holds a third of all rows
                row = (rng.choice([0, rng.randrange(30)]) if rng.random() < 0.7 else 0,
                       Decimal(rng.randrange(1, 9)), rng.randrange(5))
                sign = 1
            bag[row] += sign
            step.append((*row, sign))
        steps.append(step)
    assert _variants(spark, steps, shop_small) == _left(+bag)


def test_minimum_and_maximum_survive_deletes(spark, shop_small):
    d = Decimal
    steps = [[(1, d(5), 1, 1), (1, d(3), 2, 1), (1, d(3), 2, 1), (1, d(9), 0, 1), (2, d(4), 7, 1)],
             [(1, d(3), 2, -1)], [(1, d(3), 2, -1), (1, d(9), 0, -1), (2, d(4), 7, -1)]]
    assert _variants(spark, steps[:2], shop_small) == [(1, 3, 3, d(3), d(9)), (2, 1, 7, d(4), d(4))]
    assert _variants(spark, steps, shop_small) == [(1, 1, 1, d(5), d(5))]


def test_delete_before_insert_nulls_and_no_changes(spark, shop_small):
    d = Decimal
    early = [[(1, d(2), 3, -1), (1, d(7), 1, 1), (1, d(8), 1, 1)], [(1, d(2), 3, 1)]]
    assert _variants(spark, early[:1], shop_small) == [(1, 1, -1, d(7), d(8))]
    assert _variants(spark, early, shop_small) == [(1, 2, 2, d(7), d(8))]
    odd = [[(None, d(1), 1, 1), (3, None, 2, 1)], [(3, d(4), None, 1)]]
    assert _variants(spark, odd, shop_small) == [(3, 2, 2, d(4), d(4))]
    assert _variants(spark, [[]], shop_small) == []


def test_resumed_stream_counts_once_and_rewrites_touched_buckets(spark, shop_small, tmp_path):
    d = Decimal
    root = str(tmp_path / "r")
    first = [(p, d(p + 1), 1, 1) for p in range(200)]
    _variants(spark, [first], shop_small, root)
    got = _variants(spark, [[(7, d(8), 1, -1), (9, d(1), 4, 1)]], shop_small, root)
    want = Counter({(p, d(p + 1), 1): 1 for p in range(200) if p != 7})
    want[(9, d(1), 4)] += 1
    assert got == _left(want)
    newest = sorted(os.listdir(f"{root}/counts/data"))[-1]
    written = [x for x in os.listdir(f"{root}/counts/data/{newest}") if x.startswith("_bucket")]
    assert 1 <= len(written) <= 2


def test_feed_without_deletes_equals_the_batch_rollups(spark, shop_small):
    steps = RU.variant_feed_steps(shop_small)[:1]
    assert _rows(RU.s_variant_rollup(shop_small, steps)) == _rows(SH.agg_variant_rollup(shop_small))
    steps = RU.review_feed_steps(shop_small)[:1]
    assert _rows(RU.s_review_rollup(shop_small, steps)) == _rows(SH.agg_review_rollup(shop_small))


def test_null_ratings_count_as_reviews_only(spark, shop_small):
    feed = spark.createDataFrame([(1, None, 1), (1, 4, 1), (1, 5, 1), (1, 5, -1), (2, None, 1)],
                                 "product_id long, rating int, sign int")
    assert _rows(RU.s_review_rollup(shop_small, [feed])) == [(1, Decimal("4.00"), 2), (2, None, 1)]
