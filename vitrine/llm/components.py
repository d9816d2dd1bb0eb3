"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step is
one minimum per node (aggregated before the shuffle) and one join, and the number
of rounds is logarithmic. The edges are written to the shared checkpoint folder
after each round, which cuts the lineage and survives lost executors. Nothing but
two counts per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node u to the smallest node around u: those larger
    than u (large-star), or those smaller and u itself (small-star)."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = (both.groupBy("u").agg(F.min("v").alias("m"))
           .select("u", F.least("u", "m").alias("m")))
    linked = both.join(low, "u")
    if larger:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of an edge
    ``(u long, v long)``; a loop edge gives its node no row."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                     .first())

    cur = edges.filter("u <> v").select("u", "v").distinct().checkpoint()
    seen = state(cur)
    while seen[0]:
        cur = _star(_star(cur, True), False).checkpoint()
        now = state(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
