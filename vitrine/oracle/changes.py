"""Oracle SQL (DuckDB) for the trigger jobs over the driver-run change batches."""

from __future__ import annotations

from . import with_shop

BATCHES = [
    ("ins", "SELECT od.* FROM shop_order_details od WHERE od.order_id IN "
            "(SELECT order_id FROM shop_orders WHERE status = 'Pending')"),
    ("del", "SELECT od.* FROM shop_order_details od WHERE od.order_id IN "
            "(SELECT order_id FROM shop_orders WHERE status = 'Cancelled')"),
]


def oracle() -> dict[str, str]:
    q = {}
    lv = ["order_details", "orders", "product_variants"]
    q["t_stock_check"] = with_shop(["order_details", "product_variants"], """
SELECT i.order_detail_id, i.order_id, i.variant_id, i.quantity, v.stock
FROM shop_order_details i JOIN shop_product_variants v ON i.variant_id = v.variant_id WHERE i.quantity > v.stock""")
    q["t_stock_delta"] = with_shop(lv, """
SELECT v.variant_id, CAST(v.stock + coalesce(d.qty, 0) - coalesce(i.qty, 0) AS BIGINT) AS stock
FROM shop_product_variants v
LEFT JOIN (SELECT variant_id, sum(quantity) AS qty FROM del GROUP BY variant_id) d ON v.variant_id = d.variant_id
LEFT JOIN (SELECT variant_id, sum(quantity) AS qty FROM ins GROUP BY variant_id) i ON v.variant_id = i.variant_id""",
        extra=BATCHES)
    q["affected_orders"] = with_shop(lv, "SELECT order_id FROM ins UNION SELECT order_id FROM del", extra=BATCHES)
    q["t_order_total_recompute"] = with_shop(lv, """
SELECT a.order_id, CAST(coalesce((SELECT sum(od.quantity * od.price) FROM shop_order_details od
                                 WHERE od.order_id = a.order_id
                                   AND od.order_id NOT IN (SELECT order_id FROM shop_orders WHERE status = 'Cancelled')), 0)
                        AS DECIMAL(38,2)) AS total_amount
FROM (SELECT order_id FROM ins UNION SELECT order_id FROM del) a""", extra=BATCHES)
    q["t_cancel_restores_stock"] = with_shop(lv, """
SELECT v.variant_id, v.stock AS stock_before, CAST(r.restored AS BIGINT) AS restored,
       CAST(v.stock + r.restored AS BIGINT) AS stock_after
FROM shop_product_variants v JOIN (
  SELECT od.variant_id, sum(od.quantity) AS restored FROM shop_order_details od
  JOIN shop_orders d ON d.order_id = od.order_id
  WHERE d.status = 'Shipping' GROUP BY od.variant_id) r ON r.variant_id = v.variant_id""")
    q["t_sold_product_delete_guard"] = with_shop(["products", "product_variants", "order_details"], """
SELECT p.product_id, EXISTS (SELECT 1 FROM shop_product_variants v JOIN shop_order_details od ON od.variant_id = v.variant_id
                             WHERE v.product_id = p.product_id) AS blocked
FROM (SELECT DISTINCT product_id FROM shop_products) p""")
    q["t_review_purchase_check"] = with_shop(["reviews", "orders", "order_details", "product_variants"], """
SELECT r.*, EXISTS (SELECT 1 FROM shop_orders o JOIN shop_order_details od ON o.order_id = od.order_id
                    JOIN shop_product_variants v ON od.variant_id = v.variant_id
                    WHERE o.user_id = r.user_id AND v.product_id = r.product_id AND o.status = 'Completed') AS allowed
FROM shop_reviews r""")
    q["t_missing_carts"] = with_shop(["users", "cart"], """
SELECT (SELECT coalesce(max(cart_id), 0) FROM shop_cart) + row_number() OVER (ORDER BY u.user_id) AS cart_id, u.user_id
FROM shop_users u WHERE NOT EXISTS (SELECT 1 FROM shop_cart c WHERE c.user_id = u.user_id)""")
    return q
