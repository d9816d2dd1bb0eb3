"""Constraint audits: one long report (rule, tbl, key, detail).

The shop declares its integrity rules in DDL; over DataFrames nothing enforces
them, so each rule becomes a filter, an anti join or a grouped count, and the
violations are reported (never repaired). A table is read once per audit, whatever
the number of its rules; the report is the union over the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_len
from ..model import Shop

# ---- fixed values: the shop's declared constraints --------------------------
PRIMARY_KEYS = {
    "users": ["user_id"], "brands": ["brand_id"], "categories": ["category_id"],
    "colors": ["color_id"], "sizes": ["size_id"], "products": ["product_id"],
    "product_variants": ["variant_id"], "sales": ["sale_id"],
    "product_sales": ["product_id", "sale_id"], "product_images": ["image_id"],
    "cart": ["cart_id"], "cart_items": ["cart_item_id"], "orders": ["order_id"],
    "order_details": ["order_detail_id"], "payments": ["payment_id"],
    "shipping": ["shipping_id"], "reviews": ["review_id"],
}
UNIQUE_RULES = [
    ("users", ["email"]), ("brands", ["name"]), ("categories", ["name"]), ("colors", ["name"]),
    ("sizes", ["name"]), ("product_variants", ["product_id", "size_id", "color_id"]),
    ("cart", ["user_id"]), ("cart_items", ["cart_id", "variant_id"]),
    ("order_details", ["order_id", "variant_id"]), ("reviews", ["user_id", "product_id"]),
]
DOMAIN_LISTS = [
    ("users", "role", ["admin", "user"]),
    ("sizes", "name", ["S", "M", "L", "XL", "XXL", "40", "41", "42", "43", "44", "45"]),
    ("orders", "status", ["Pending", "Confirmed", "Shipping", "Completed", "Cancelled"]),
    ("payments", "method", ["COD", "Bank"]),
]
DOMAIN_RANGES = [("reviews", "rating", 1, 5), ("sales", "discount_percent", 0, 100)]
# (table, column, comparison, bound); a NULL value passes, as in a CHECK.
RANGE_RULES = [
    ("product_variants", "price", ">", 0), ("product_variants", "stock", ">=", 0),
    ("cart_items", "quantity", ">", 0), ("order_details", "quantity", ">", 0),
    ("order_details", "price", ">", 0),
]
FOREIGN_KEYS = [  # (child, column, parent, parent column, on delete)
    ("products", "brand_id", "brands", "brand_id", "set null"),
    ("products", "category_id", "categories", "category_id", "set null"),
    ("product_variants", "product_id", "products", "product_id", "cascade"),
    ("product_variants", "size_id", "sizes", "size_id", "no action"),
    ("product_variants", "color_id", "colors", "color_id", "no action"),
    ("product_sales", "product_id", "products", "product_id", "cascade"),
    ("product_sales", "sale_id", "sales", "sale_id", "cascade"),
    ("product_images", "product_id", "products", "product_id", "cascade"),
    ("cart", "user_id", "users", "user_id", "cascade"),
    ("cart_items", "cart_id", "cart", "cart_id", "cascade"),
    ("cart_items", "variant_id", "product_variants", "variant_id", "cascade"),
    ("orders", "user_id", "users", "user_id", "cascade"),
    ("order_details", "order_id", "orders", "order_id", "cascade"),
    ("order_details", "variant_id", "product_variants", "variant_id", "cascade"),
    ("payments", "order_id", "orders", "order_id", "cascade"),
    ("shipping", "order_id", "orders", "order_id", "cascade"),
    ("reviews", "user_id", "users", "user_id", "cascade"),
    ("reviews", "product_id", "products", "product_id", "cascade"),
]
NOT_NULL = {
    "users": ["name", "email", "role"], "brands": ["name"], "categories": ["name"],
    "colors": ["name"], "sizes": ["name"], "products": ["name"],
    "product_variants": ["product_id", "size_id", "color_id", "price", "stock"],
    "sales": ["discount_percent", "start_date", "end_date"],
    "product_sales": ["product_id", "sale_id"], "product_images": ["product_id", "image_url"],
    "cart": ["user_id"], "cart_items": ["cart_id", "variant_id", "quantity"],
    "orders": ["user_id"], "order_details": ["order_id", "variant_id", "quantity", "price"],
    "payments": ["order_id"], "shipping": ["order_id"],
    "reviews": ["user_id", "product_id", "rating"],
}
MAX_LENGTHS = [
    ("users", "name", 100), ("users", "email", 100), ("users", "phone", 15),
    ("users", "address", 255), ("users", "role", 20), ("brands", "name", 100),
    ("categories", "name", 100), ("colors", "name", 50), ("colors", "hex_code", 10),
    ("sizes", "name", 10), ("products", "name", 150), ("products", "description", 500),
    ("sales", "name", 100), ("product_images", "image_url", 500), ("orders", "status", 50),
    ("payments", "method", 50), ("payments", "status", 50), ("shipping", "address", 255),
    ("shipping", "status", 50), ("reviews", "comment", 500),
]
MIN_COMMENT_LEN = 5
# -----------------------------------------------------------------------------

REPORT_COLS = ["rule", "tbl", "key", "detail"]


def _key(cols: list[str]) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def _report(df: DataFrame, rule: str, table: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("tbl"), key.alias("key"),
                     detail.alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _table(shop: Shop, name: str) -> DataFrame:
    return getattr(shop, name)


def c_unique(shop: Shop) -> DataFrame:
    parts = []
    for table, cols in UNIQUE_RULES:
        dup = (_table(shop, table).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
               .filter(F.col("_n") > 1))
        parts.append(_report(dup, "c_unique", table, _key(cols),
                             F.concat(F.lit("count="), F.col("_n").cast("string"))))
    return _union(parts)


def _value_detail(col: str) -> Column:
    return F.concat(F.lit(col + "="), F.col(col).cast("string"))


def c_domain(shop: Shop) -> DataFrame:
    parts = []
    for table, col, allowed in DOMAIN_LISTS:
        bad = _table(shop, table).filter(~F.col(col).isin(allowed))
        parts.append(_report(bad, "c_domain", table, _key(PRIMARY_KEYS[table]), _value_detail(col)))
    for table, col, lo, hi in DOMAIN_RANGES:
        bad = _table(shop, table).filter(~F.col(col).between(lo, hi))
        parts.append(_report(bad, "c_domain", table, _key(PRIMARY_KEYS[table]), _value_detail(col)))
    return _union(parts)


_OPS = {">": lambda c, b: c > b, ">=": lambda c, b: c >= b}


def _checked(shop: Shop, rule: str, checks: dict[str, list[tuple[Column, Column]]]) -> DataFrame:
    """One pass over each table: every row's violated checks, exploded.

    ``checks`` maps a table to (violated, detail) pairs; a NULL verdict passes,
    as in a CHECK.
    """
    parts = []
    for table, pairs in checks.items():
        found = F.array_compact(F.array(*[F.when(bad, detail) for bad, detail in pairs]))
        rows = _table(shop, table).filter(reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False))
                                                                      for bad, _ in pairs]))
        rows = rows.select(_key(PRIMARY_KEYS[table]).alias("_key"), F.explode(found).alias("_detail"))
        parts.append(_report(rows, rule, table, F.col("_key"), F.col("_detail")))
    return _union(parts)


def c_range(shop: Shop) -> DataFrame:
    checks: dict[str, list] = {}
    for table, col, op, bound in RANGE_RULES:
        checks.setdefault(table, []).append((~_OPS[op](F.col(col), F.lit(bound)), _value_detail(col)))
    checks["sales"] = [(~(F.col("start_date") <= F.col("end_date")), F.lit("start_date>end_date"))]
    length = sql_len(F.col("comment"))
    checks["reviews"] = [(~(length >= MIN_COMMENT_LEN),
                          F.concat(F.lit("comment_len="), length.cast("string")))]
    return _checked(shop, "c_range", checks)


def c_foreign_keys(shop: Shop) -> DataFrame:
    """Children without their parent. Every child is read once, its references
    exploded into (parent, value) rows; every parent gives one set of keys; a
    single anti join on both finds the orphans. An anti join ignores duplicate
    keys on its right side, and adaptive execution splits a hot key's left side."""
    refs: dict[str, list[tuple[str, str]]] = {}
    parents = {}
    for child, col, parent, pcol, _action in FOREIGN_KEYS:
        refs.setdefault(child, []).append((col, parent))
        parents[parent] = pcol
    uses = []
    for child, cols in refs.items():
        each = F.explode(F.array(*[F.struct(F.lit(col).alias("col"), F.lit(parent).alias("parent"),
                                            F.col(col).cast("long").alias("value"))
                                   for col, parent in cols]))
        uses.append(_table(shop, child).select(
            F.lit(child).alias("tbl"), _key(PRIMARY_KEYS[child]).alias("key"), each.alias("ref"))
            .select("tbl", "key", "ref.*").filter("value is not null"))
    keys = _union([_table(shop, parent).select(F.lit(parent).alias("parent"),
                                               F.col(pcol).cast("long").alias("value"))
                   for parent, pcol in parents.items()])
    orphan = _union(uses).join(keys, ["parent", "value"], "left_anti")
    return orphan.select(F.lit("c_foreign_keys").alias("rule"), "tbl", "key",
                         F.concat("col", F.lit("="), F.col("value").cast("string"),
                                  F.lit(" missing in "), "parent").alias("detail"))


def c_not_null(shop: Shop) -> DataFrame:
    return _checked(shop, "c_not_null", {
        table: [(F.col(col).isNull(), F.lit(f"{col} is null")) for col in cols]
        for table, cols in NOT_NULL.items()})


def c_length(shop: Shop) -> DataFrame:
    checks: dict[str, list] = {}
    for table, col, n in MAX_LENGTHS:
        length = F.length(F.col(col))
        checks.setdefault(table, []).append(
            (length > n, F.concat(F.lit(f"{col} length="), length.cast("string"))))
    return _checked(shop, "c_length", checks)


def c_price_snapshot_drift(shop: Shop) -> DataFrame:
    """Order lines whose stored price differs from the variant's current one
    (the line price is a snapshot taken at checkout)."""
    v = shop.product_variants.select("variant_id", F.col("price").alias("_vp"))
    rows = shop.order_details.join(v, "variant_id").filter(F.col("price") != F.col("_vp"))
    return _report(rows, "c_price_snapshot_drift", "order_details", _key(["order_detail_id"]),
                   F.concat(F.lit("line="), F.col("price").cast("string"), F.lit(" variant="),
                            F.col("_vp").cast("string")))


def c_delete_cascade(shop: Shop, deleted: dict[str, DataFrame]) -> DataFrame:
    """Rows that a delete of the given keys removes (cascade) or changes (set
    null), following the foreign-key graph; each step is a semi join.

    ``deleted`` maps a table to a DataFrame of its primary-key columns.
    """
    gone: dict[str, DataFrame] = {t: df.select(*PRIMARY_KEYS[t]).distinct()
                                  for t, df in deleted.items()}
    parts = []
    frontier = list(gone)
    while frontier:
        nxt = []
        for parent in frontier:
            pk = PRIMARY_KEYS[parent]
            keys = gone[parent].select(F.col(pk[0]).alias("_pk"))
            for child, col, p, pcol, action in FOREIGN_KEYS:
                if p != parent or action not in ("cascade", "set null"):
                    continue
                hit = _table(shop, child).join(keys, F.col(col) == F.col("_pk"), "left_semi")
                ck = PRIMARY_KEYS[child]
                if action == "set null":
                    parts.append(_report(hit, "c_delete_cascade", child, _key(ck),
                                         F.lit(f"set null {col}")))
                    continue
                parts.append(_report(hit, "c_delete_cascade", child, _key(ck),
                                     F.lit(f"cascade from {parent}")))
                rows = hit.select(*ck)
                gone[child] = gone[child].unionByName(rows) if child in gone else rows
                if child not in nxt:
                    nxt.append(child)
        frontier = nxt
    return _union(parts).distinct()
