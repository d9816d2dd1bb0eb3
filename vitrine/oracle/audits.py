"""Oracle SQL (DuckDB) for the constraint audits, written from the rule lists."""

from __future__ import annotations

from . import with_shop
from ..operators import audits as A


def _key(cols):
    return "concat_ws(',', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _sel(rule, table, key, detail, frm, where):
    return (f"SELECT '{rule}' AS rule, '{table}' AS tbl, {key} AS key, {detail} AS detail "
            f"FROM {frm} WHERE {where}")


def _lit_list(vals):
    return ", ".join("'" + v + "'" for v in vals)


# The faults of registry.with_faults.
FAULTS = [
    ("faulty_users", """SELECT * REPLACE (CASE WHEN user_id % 13 = 0 THEN phone || phone ELSE phone END AS phone,
       CASE WHEN user_id % 17 <> 0 THEN role END AS role) FROM shop_users"""),
    ("faulty_reviews", """SELECT * REPLACE (CASE WHEN review_id % 19 = 0 THEN repeat('x', 501) ELSE comment END AS comment,
       CASE WHEN review_id % 23 <> 0 THEN rating END AS rating) FROM shop_reviews"""),
    ("faulty_order_details", """SELECT * REPLACE (CASE WHEN order_id % 31 <> 0 THEN price END AS price,
       CASE WHEN order_id % 37 <> 0 THEN quantity END AS quantity) FROM shop_order_details"""),
]


def _faulty(table: str) -> str:
    return f"faulty_{table}" if f"faulty_{table}" in dict(FAULTS) else f"shop_{table}"


def oracle() -> dict[str, str]:
    q = {}
    parts, tabs = [], []
    for table, cols in A.UNIQUE_RULES:
        tabs.append(table)
        cl = ", ".join(cols)
        parts.append(f"SELECT 'c_unique' AS rule, '{table}' AS tbl, {_key(cols)} AS key, "
                     f"'count=' || CAST(count(*) AS VARCHAR) AS detail FROM shop_{table} "
                     f"GROUP BY {cl} HAVING count(*) > 1")
    q["c_unique"] = with_shop(tabs, "\nUNION ALL\n".join(parts))

    parts, tabs = [], []
    for table, col, allowed in A.DOMAIN_LISTS:
        tabs.append(table)
        parts.append(_sel("c_domain", table, _key(A.PRIMARY_KEYS[table]),
                          f"'{col}=' || CAST({col} AS VARCHAR)", f"shop_{table}",
                          f"NOT ({col} IN ({_lit_list(allowed)}))"))
    for table, col, lo, hi in A.DOMAIN_RANGES:
        tabs.append(table)
        parts.append(_sel("c_domain", table, _key(A.PRIMARY_KEYS[table]),
                          f"'{col}=' || CAST({col} AS VARCHAR)", f"shop_{table}",
                          f"NOT ({col} BETWEEN {lo} AND {hi})"))
    q["c_domain"] = with_shop(tabs, "\nUNION ALL\n".join(parts))

    parts, tabs = [], ["sales", "reviews"]
    for table, col, op, bound in A.RANGE_RULES:
        tabs.append(table)
        parts.append(_sel("c_range", table, _key(A.PRIMARY_KEYS[table]),
                          f"'{col}=' || CAST({col} AS VARCHAR)", f"shop_{table}",
                          f"NOT ({col} {op} {bound})"))
    parts.append(_sel("c_range", "sales", _key(["sale_id"]), "'start_date>end_date'", "shop_sales",
                      "NOT (start_date <= end_date)"))
    parts.append(_sel("c_range", "reviews", _key(["review_id"]),
                      "'comment_len=' || CAST(length(rtrim(comment)) AS VARCHAR)", "shop_reviews",
                      f"NOT (length(rtrim(comment)) >= {A.MIN_COMMENT_LEN})"))
    q["c_range"] = with_shop(tabs, "\nUNION ALL\n".join(parts))

    parts, tabs = [], []
    for child, col, parent, pcol, _a in A.FOREIGN_KEYS:
        tabs += [child, parent]
        parts.append(_sel("c_foreign_keys", child, _key(A.PRIMARY_KEYS[child]),
                          f"'{col}=' || CAST({col} AS VARCHAR) || ' missing in {parent}'",
                          f"shop_{child} c",
                          f"{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shop_{parent} p "
                          f"WHERE p.{pcol} = c.{col})"))
    q["c_foreign_keys"] = with_shop(tabs, "\nUNION ALL\n".join(parts))

    parts, tabs = [], []
    for table, cols in A.NOT_NULL.items():
        tabs.append(table)
        for col in cols:
            parts.append(_sel("c_not_null", table, _key(A.PRIMARY_KEYS[table]),
                              f"'{col} is null'", _faulty(table), f"{col} IS NULL"))
    q["c_not_null"] = with_shop(tabs, "\nUNION ALL\n".join(parts), extra=FAULTS)

    parts, tabs = [], []
    for table, col, n in A.MAX_LENGTHS:
        tabs.append(table)
        parts.append(_sel("c_length", table, _key(A.PRIMARY_KEYS[table]),
                          f"'{col} length=' || CAST(length({col}) AS VARCHAR)", _faulty(table),
                          f"length({col}) > {n}"))
    q["c_length"] = with_shop([*tabs, "order_details"], "\nUNION ALL\n".join(parts), extra=FAULTS)

    q["c_price_snapshot_drift"] = with_shop(["order_details", "product_variants"], """
SELECT 'c_price_snapshot_drift' AS rule, 'order_details' AS tbl, CAST(od.order_detail_id AS VARCHAR) AS key,
       'line=' || CAST(od.price AS VARCHAR) || ' variant=' || CAST(v.price AS VARCHAR) AS detail
FROM shop_order_details od JOIN shop_product_variants v ON v.variant_id = od.variant_id
WHERE od.price <> v.price""")

    q["c_delete_cascade"] = with_shop(
        ["products", "product_variants", "product_sales", "product_images", "reviews",
         "cart_items", "order_details", "brands"], f"""
SELECT DISTINCT * FROM (
SELECT 'c_delete_cascade' AS rule, 'product_variants' AS tbl, CAST(variant_id AS VARCHAR) AS key,
       'cascade from products' AS detail FROM shop_product_variants WHERE product_id IN (SELECT product_id FROM del_products)
UNION ALL SELECT 'c_delete_cascade', 'product_sales', {_key(['product_id', 'sale_id'])}, 'cascade from products'
  FROM shop_product_sales WHERE product_id IN (SELECT product_id FROM del_products)
UNION ALL SELECT 'c_delete_cascade', 'product_images', CAST(image_id AS VARCHAR), 'cascade from products'
  FROM shop_product_images WHERE product_id IN (SELECT product_id FROM del_products)
UNION ALL SELECT 'c_delete_cascade', 'reviews', CAST(review_id AS VARCHAR), 'cascade from products'
  FROM shop_reviews WHERE product_id IN (SELECT product_id FROM del_products)
UNION ALL SELECT 'c_delete_cascade', 'cart_items', CAST(cart_item_id AS VARCHAR), 'cascade from product_variants'
  FROM shop_cart_items WHERE variant_id IN (SELECT variant_id FROM shop_product_variants
                                            WHERE product_id IN (SELECT product_id FROM del_products))
UNION ALL SELECT 'c_delete_cascade', 'order_details', CAST(order_detail_id AS VARCHAR), 'cascade from product_variants'
  FROM shop_order_details WHERE variant_id IN (SELECT variant_id FROM shop_product_variants
                                               WHERE product_id IN (SELECT product_id FROM del_products))
UNION ALL SELECT 'c_delete_cascade', 'products', CAST(product_id AS VARCHAR), 'set null brand_id'
  FROM shop_products WHERE brand_id IN (SELECT brand_id FROM del_brands)
) x""", extra=[("del_products", "SELECT product_id FROM shop_products WHERE category_id IS NULL"),
               ("del_brands", "SELECT brand_id FROM shop_brands WHERE brand_id = 1")])
    return q
