"""Oracle SQL (DuckDB) for the final state of the streaming jobs: each equals
a batch aggregate over the whole feed."""

from __future__ import annotations

from . import with_shop

LINE_FEED = """SELECT order_id, variant_id, quantity, price, 1 AS sign FROM shop_order_details
UNION ALL SELECT order_id, variant_id, quantity, price, -1 FROM shop_order_details
WHERE order_id IN (SELECT order_id FROM shop_orders WHERE status = 'Cancelled')"""


def oracle() -> dict[str, str]:
    q = {}
    q["s_order_totals"] = with_shop(["order_details", "orders"], """
SELECT order_id, CAST(sum(sign * quantity * price) AS DECIMAL(38,2)) AS total_amount FROM feed GROUP BY order_id""",
        extra=[("feed", LINE_FEED)])
    q["s_stock_ledger"] = with_shop(["order_details", "orders", "product_variants"], """
SELECT v.variant_id, CAST(v.stock - coalesce(f.taken, 0) AS BIGINT) AS stock
FROM shop_product_variants v
LEFT JOIN (SELECT variant_id, sum(sign * quantity) AS taken FROM feed GROUP BY variant_id) f
       ON f.variant_id = v.variant_id""", extra=[("feed", LINE_FEED)])
    q["s_cancel_restores"] = with_shop(["order_details", "orders"], """
SELECT od.variant_id, CAST(sum(od.quantity) AS BIGINT) AS restored FROM shop_order_details od
JOIN shop_orders o ON o.order_id = od.order_id WHERE o.status = 'Shipping' GROUP BY od.variant_id""")
    q["s_variant_rollup"] = with_shop(["product_variants"], """
SELECT product_id, count(*) AS total_variants, CAST(sum(stock) AS BIGINT) AS total_stock,
       min(price) AS min_price, max(price) AS max_price
FROM (SELECT variant_id, product_id,
             CASE WHEN product_id % 4 = 0 THEN CAST(price - 1 AS DECIMAL(10,2)) ELSE price END AS price,
             CASE WHEN product_id % 4 = 0 THEN stock + 1 ELSE stock END AS stock
      FROM shop_product_variants) v
WHERE variant_id % 5 <> 0 AND product_id % 7 <> 0 GROUP BY product_id""")
    q["s_review_rollup"] = with_shop(["reviews"], """
SELECT product_id,
       CAST(((sum(rating) * 200 + count(*)) // (2 * count(*))) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS avg_rating,
       count(*) AS review_count
FROM (SELECT review_id, product_id, CASE WHEN review_id % 3 = 0 THEN 6 - rating ELSE rating END AS rating
      FROM shop_reviews) r
WHERE review_id % 5 <> 0 AND product_id % 11 <> 0 GROUP BY product_id""")
    return q
