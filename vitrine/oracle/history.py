"""Oracle SQL (DuckDB) for prices and sales at the time of each order."""

from __future__ import annotations

from . import with_shop

_TABLES = ["product_variants", "orders", "order_details", "product_sales", "sales"]


def oracle() -> dict[str, str]:
    q = {}
    q["price_at_order"] = with_shop(_TABLES, """
SELECT d.order_id, d.variant_id, v.product_id, o.order_date, d.quantity, d.price AS paid_price,
       v.price AS list_price, b.pct AS discount_percent,
       CAST(v.price * (100 - coalesce(b.pct, 0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS price_then,
       CAST(d.quantity * v.price * (100 - coalesce(b.pct, 0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS line_then
FROM shop_order_details d JOIN shop_orders o ON o.order_id = d.order_id
JOIN shop_product_variants v ON v.variant_id = d.variant_id
LEFT JOIN (
  SELECT days.order_date, ps.product_id, max(s.discount_percent) AS pct
  FROM (SELECT DISTINCT order_date FROM shop_orders) days
  JOIN shop_sales s ON s.start_date <= days.order_date AND days.order_date <= s.end_date
  JOIN shop_product_sales ps ON ps.sale_id = s.sale_id
  GROUP BY days.order_date, ps.product_id) b
ON b.order_date = o.order_date AND b.product_id = v.product_id""")
    q["sale_results"] = with_shop(_TABLES, """
SELECT s.sale_id, s.name AS sale_name, s.discount_percent, count(t.order_id) AS total_lines,
       CAST(coalesce(sum(t.quantity), 0) AS BIGINT) AS total_units,
       CAST(coalesce(sum(t.quantity * t.price), 0) AS DECIMAL(38,2)) AS total_paid
FROM shop_sales s LEFT JOIN (
  SELECT ps.sale_id, d.order_id, d.quantity, d.price, o.order_date
  FROM shop_order_details d JOIN shop_orders o ON o.order_id = d.order_id
  JOIN shop_product_variants v ON v.variant_id = d.variant_id
  JOIN (SELECT DISTINCT product_id, sale_id FROM shop_product_sales) ps ON ps.product_id = v.product_id) t
ON t.sale_id = s.sale_id AND t.order_date >= s.start_date AND t.order_date <= s.end_date
GROUP BY s.sale_id, s.name, s.discount_percent""")
    return q
