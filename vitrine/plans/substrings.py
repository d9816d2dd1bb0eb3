"""Substring search for a table of keywords.

``find`` returns which keywords occur in which texts, as ``lower(text)`` contains
``lower(keyword)`` does, without comparing each keyword with each text. Posting lists
hold, for every distinct run of up to three characters of a text (a gram), the text's
key. A keyword of three characters or more is looked up by the rarest of its trigrams,
and its finds are verified on the text; a shorter one *is* a gram, so its posting list
is the answer.

Postings are dealt by gram and salt (a hash of the text's key), and a keyword's row is
repeated for each salt, so a gram that occurs in every text is spread over ``salts``
tasks. The counts that choose the rarest trigram are summed map-side. Texts travel once
per candidate, not per gram: postings carry keys only.

Defined cases: a NULL keyword or text is found nowhere and holds nothing; the empty
keyword is in every text that is not NULL; keywords that differ in case or are repeated
are one keyword, lower-cased, and return one row a text; ``%`` and ``_`` are literal
characters; repeated rows of ``texts`` return their finds once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
SALTS = 16


def _grams(c: Column, sizes: range) -> Column:
    """Distinct runs of the given numbers of characters."""
    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))),
                           lambda i: F.substr(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, runs).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) if n else F.array(F.lit("")) for n in sizes]))


def postings(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, _gram): each gram of up to ``GRAM`` characters of each text."""
    low = F.lower(F.col(text))
    return (texts.filter(F.col(text).isNotNull())
            .select(*keys, F.explode(_grams(low, range(GRAM + 1))).alias("_gram")))


def lookups(keywords: DataFrame, posted: DataFrame) -> DataFrame:
    """(keyword, _gram): the gram each lower-cased keyword is looked up by. Keywords with
    a trigram that no text holds are left out, as they are found nowhere."""
    words = (keywords.select(F.lower("keyword").alias("keyword")).filter("keyword IS NOT NULL")
             .distinct())
    short = words.filter(F.length("keyword") < GRAM).select("keyword", F.col("keyword").alias("_gram"))
    parts = (words.filter(F.length("keyword") >= GRAM)
             .select("keyword", _grams(F.col("keyword"), range(GRAM, GRAM + 1)).alias("_all")))
    parts = parts.select("keyword", F.size("_all").alias("_n"), F.explode("_all").alias("_gram"))
    counts = (posted.filter(F.length("_gram") == GRAM)
              .groupBy("_gram").agg(F.count(F.lit(1)).alias("_df")))
    rarest = (parts.join(counts, "_gram").groupBy("keyword", "_n")
              .agg(F.count(F.lit(1)).alias("_found"),
                   F.min(F.struct("_df", "_gram")).alias("_low"))
              .filter("_found = _n").select("keyword", F.col("_low._gram").alias("_gram")))
    return short.unionByName(rarest)


def find(texts: DataFrame, keywords: DataFrame, keys: list[str], text: str = "text",
         salts: int = SALTS) -> DataFrame:
    """(keyword, *keys) for each lower-cased keyword and text that holds it. ``keys``
    name a text of ``texts``; ``keywords`` has a column ``keyword``."""
    posted = postings(texts, keys, text)
    salt = F.pmod(F.xxhash64(*keys), F.lit(salts))
    asked = (lookups(keywords, posted)
             .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.lit(salts - 1).cast("long")))))
    met = (posted.withColumn("_salt", salt).join(asked, ["_gram", "_salt"])
           .select("keyword", *keys).distinct())
    sure = met.filter(F.length("keyword") <= GRAM)  # the gram is the whole keyword
    low = texts.select(*keys, F.lower(F.col(text)).alias("_low"))
    verified = (met.filter(F.length("keyword") > GRAM).join(low, keys)
                .filter(F.col("_low").contains(F.col("keyword"))).select("keyword", *keys))
    return sure.unionByName(verified.distinct())
