"""Product search for many keywords at once.

``documents.api_product_search`` answers one keyword with a scan of its own. Here a whole
table of keywords (the searches of a day, a list of watched words) meets all products by
posting lists (``plans.substrings``). Names and descriptions are indexed per product,
brands and categories once each, their finds then joined to the products that carry
them. A blank keyword finds every product, as the search page does without a keyword.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shop
from ..plans.substrings import find

FIELDS = ("name", "description", "brand", "category")


def keyword_matches(shop: Shop, keywords: DataFrame) -> DataFrame:
    """keyword, product_id and in which of the four fields it occurs. Keywords are
    trimmed, lower-cased and taken once; NULL ones are blank."""
    asked = keywords.select(F.lower(F.trim(F.coalesce("keyword", F.lit("")))).alias("keyword"))
    p = shop.products
    blank = F.lit("")

    def texts(kind: str, rows: DataFrame, key: str, col: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("field"), F.col(key).cast("long").alias("id"),
                           F.coalesce(F.col(col), blank).alias("text"))

    indexed = reduce(DataFrame.unionByName, [
        texts("name", p, "product_id", "name"),
        texts("description", p, "product_id", "description"),
        texts("brand", shop.brands, "brand_id", "name"),
        texts("category", shop.categories, "category_id", "name")])
    found = find(indexed, asked, ["field", "id"])
    own = (found.filter(F.col("field").isin("name", "description"))
           .select("keyword", F.col("id").alias("product_id"), "field"))

    def carried(kind: str) -> DataFrame:
        hits = found.filter(F.col("field") == kind).select(
            "keyword", F.col("id").alias(f"{kind}_id"), "field")
        return p.select("product_id", F.col(f"{kind}_id").cast("long").alias(f"{kind}_id")).join(
            hits, f"{kind}_id").select("keyword", "product_id", "field")

    hits = own.unionByName(carried("brand")).unionByName(carried("category"))
    return (hits.groupBy("keyword", "product_id")
            .agg(*[F.max(F.col("field") == f).alias(f"in_{f}") for f in FIELDS]))


def keyword_report(shop: Shop, keywords: DataFrame) -> DataFrame:
    """Per asked keyword the number of products it finds (0 too), how many of them by
    name, and the lowest price of a variant among them."""
    asked = keywords.select(
        F.lower(F.trim(F.coalesce("keyword", F.lit("")))).alias("keyword")).distinct()
    low = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("price"))
    sums = (keyword_matches(shop, keywords).join(low, "product_id", "left").groupBy("keyword")
            .agg(F.count(F.lit(1)).alias("n_products"),
                 F.count_if("in_name").alias("n_by_name"), F.min("price").alias("min_price")))
    return (asked.join(sums, "keyword", "left")
            .select("keyword", F.coalesce("n_products", F.lit(0)).cast("bigint").alias("n_products"),
                    F.coalesce("n_by_name", F.lit(0)).cast("bigint").alias("n_by_name"), "min_price"))


def driver_keywords(shop: Shop) -> DataFrame:
    """Keywords from the shop's own words: whole words of names, starts of one to three
    characters, runs across a blank, brands in capitals, words that no product holds."""
    name = F.col("name")
    words = shop.products.select(F.explode(F.split(name, " ")).alias("w"))
    parts = [words.select(F.col("w").alias("keyword")),
             *[words.select(F.substr("w", F.lit(1), F.lit(n)).alias("keyword")) for n in (1, 2, 3)],
             words.select(F.concat(F.col("w"), F.lit("q%")).alias("keyword")),
             shop.products.select(F.substr(name, F.lit(3), F.lit(7)).alias("keyword")),
             shop.brands.select(F.upper(name).alias("keyword")),
             shop.categories.select(F.substr(name, F.lit(2), F.lit(3)).alias("keyword"))]
    return reduce(DataFrame.unionByName, parts).distinct()
