"""Search for a table of keywords against plain substring tests."""

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import search as S
from vitrine.plans import substrings as B


def _find(spark, texts, words, **kw):
    t = spark.createDataFrame(texts, "id long, text string")
    k = spark.createDataFrame([(w,) for w in words], "keyword string")
    return sorted((r.keyword, r.id) for r in B.find(t, k, ["id"], **kw).collect())


def _brute(texts, words):
    return sorted({(w.lower(), i) for w in words if w is not None
                   for i, t in texts if t is not None and w.lower() in t.lower()})


@pytest.mark.parametrize("salts", [1, 16])
def test_find_against_all_pairs(spark, salts):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice("aB é%_日") for _ in range(rng.randrange(30))))
             for i in range(150)]
    texts += texts[:20] + [(200, None), (201, ""), (202, "aaaa" * 500)]
    words = ["", None, "a", "A", "ab", "%", "_", "é", "日", "zzz", "zz", "aaa", "AAAA", "aaaab"]
    words += [t[k:k + n] for _, t in texts[:60] for k in (0, 3) for n in (1, 2, 3, 4, 7)]
    want = _brute(texts, words)
    assert want and _find(spark, texts, words, salts=salts) == want


def test_no_texts_or_no_keywords(spark):
    assert _find(spark, [], ["", "a", "abc"]) == []
    assert _find(spark, [(1, "abc")], []) == []


def test_all_trigrams_held_but_not_the_keyword(spark):
    texts = [(1, "abcd bcde"), (2, "abcde")]
    assert _find(spark, texts, ["abcde", "abcdeabc"]) == [("abcde", 2)]


def test_a_gram_of_every_text_is_spread(spark):
    """One gram in all texts: its postings meet their keyword in many partitions."""
    t = spark.range(4000).select("id", F.lit("the same name").alias("text"))
    k = spark.createDataFrame([("the",)], "keyword string")
    posted = B.postings(t, ["id"])
    salt = F.pmod(F.xxhash64("id"), F.lit(B.SALTS))
    per = posted.filter("_gram = 'the'").groupBy(salt.alias("s")).count().collect()
    assert len(per) == B.SALTS and max(r["count"] for r in per) < 400
    assert B.find(t, k, ["id"]).count() == 4000


def test_no_pair_join(spark, shop_small):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.keyword_matches(shop_small, S.driver_keywords(shop_small)
                                 )._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_keyword_equals_the_search_page(spark, shop_small):
    from vitrine.operators.documents import api_product_search
    for word in ("ring", " RING ", "", "brand#1", "o p"):
        k = spark.createDataFrame([(word,)], "keyword string")
        got = sorted(r.product_id for r in S.keyword_matches(shop_small, k).collect())
        want = sorted(r.product_id for r in api_product_search(shop_small, word).collect())
        assert got == want


def test_report_counts_keywords_without_products(spark, shop_small):
    k = spark.createDataFrame([("nothing like it",), (None,), ("ring",), ("RING",)], "keyword string")
    rows = {r.keyword: r for r in S.keyword_report(shop_small, k).collect()}
    assert set(rows) == {"nothing like it", "", "ring"}
    assert rows["nothing like it"].n_products == 0 and rows["nothing like it"].min_price is None
    assert rows[""].n_products == shop_small.products.count() >= rows["ring"].n_products
