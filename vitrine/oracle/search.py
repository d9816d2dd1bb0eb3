"""Oracle SQL (DuckDB) for product search by a table of keywords."""

from __future__ import annotations

from . import with_shop

_TABLES = ["products", "brands", "categories", "product_variants"]

_EXTRA = [
    ("words", "SELECT unnest(string_split(name, ' ')) AS w FROM shop_products"),
    ("asked", """SELECT DISTINCT lower(trim(k)) AS keyword FROM (
    SELECT w AS k FROM words UNION ALL SELECT substring(w, 1, 1) FROM words
    UNION ALL SELECT substring(w, 1, 2) FROM words UNION ALL SELECT substring(w, 1, 3) FROM words
    UNION ALL SELECT w || 'q%' FROM words
    UNION ALL SELECT substring(name, 3, 7) FROM shop_products
    UNION ALL SELECT upper(name) FROM shop_brands
    UNION ALL SELECT substring(name, 2, 3) FROM shop_categories) t"""),
    ("matched", """SELECT a.keyword, p.product_id, contains(lower(coalesce(p.name, '')), a.keyword) AS in_name,
         contains(lower(coalesce(p.description, '')), a.keyword) AS in_description,
         b.name IS NOT NULL AND contains(lower(b.name), a.keyword) AS in_brand,
         c.name IS NOT NULL AND contains(lower(c.name), a.keyword) AS in_category
  FROM asked a CROSS JOIN shop_products p
  LEFT JOIN shop_brands b ON b.brand_id = p.brand_id
  LEFT JOIN shop_categories c ON c.category_id = p.category_id"""),
]


def _with(body: str) -> str:
    return with_shop(_TABLES, body, extra=_EXTRA)


def oracle() -> dict[str, str]:
    return {
        "keyword_matches": _with("""SELECT * FROM matched
WHERE in_name OR in_description OR in_brand OR in_category"""),
        "keyword_report": _with("""SELECT a.keyword, count(m.product_id) AS n_products,
       count(m.product_id) FILTER (WHERE m.in_name) AS n_by_name, min(v.price) AS min_price
FROM asked a
LEFT JOIN (SELECT * FROM matched WHERE in_name OR in_description OR in_brand OR in_category) m
       ON m.keyword = a.keyword
LEFT JOIN (SELECT product_id, min(price) AS price FROM shop_product_variants GROUP BY product_id) v
       ON v.product_id = m.product_id
GROUP BY a.keyword"""),
    }
