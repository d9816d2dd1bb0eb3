"""Oracle SQL (DuckDB) for the shared sub-plans, the size chart and the
label maps."""

from __future__ import annotations

from ..functions.sizes import CLOTHING_CHART, SHOE_CHART
from . import with_shop


def _chart_values() -> str:
    rows = [(size, chart, value) for chart, m in SHOE_CHART.items() for size, value in m.items()]
    rows += [(size, f"{unit} {measure}", value) for unit, ms in CLOTHING_CHART.items()
             for measure, m in ms.items() for size, value in m.items()]
    return ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)


def oracle() -> dict[str, str]:
    q = {}
    q["agg_variant_rollup"] = with_shop([], """SELECT product_id, total_variants, CAST(total_stock AS BIGINT) AS total_stock,
       min_price, max_price FROM shop_variant_rollup""", shared=["variant_rollup"])
    q["agg_review_rollup"] = with_shop([], "SELECT * FROM shop_review_rollup", shared=["review_rollup"])
    q["agg_active_discount"] = with_shop([], "SELECT * FROM shop_active_discount", shared=["active_discount"])
    q["top1_best_discount"] = q["agg_active_discount"]
    q["top1_first_image"] = with_shop([], "SELECT * FROM shop_first_image", shared=["first_image"])
    q["top1_latest_payment"] = with_shop([], "SELECT * FROM shop_latest_payment", shared=["latest_payment"])
    q["top1_latest_shipping"] = with_shop([], "SELECT * FROM shop_latest_shipping", shared=["latest_shipping"])
    q["op_size_guide"] = with_shop(["product_variants", "sizes", "colors"], f"""
SELECT pv.variant_id, pv.product_id, s.name AS size_name, g.chart, g.value
FROM shop_product_variants pv JOIN shop_sizes s ON pv.size_id = s.size_id JOIN shop_colors c ON pv.color_id = c.color_id
JOIN (VALUES {_chart_values()}) g(size, chart, value) ON upper(s.name) = g.size""")
    q["status_maps"] = with_shop(["payments", "orders"], """
SELECT p.payment_id, p.order_id,
  CASE WHEN lower(coalesce(o.status, '')) IN ('pending','confirmed','shipping','completed','cancelled')
       THEN lower(o.status) ELSE 'pending' END AS norm_order_status,
  CASE WHEN lower(coalesce(p.status, '')) IN ('pending','paid','failed') THEN lower(p.status) ELSE 'pending' END
       AS norm_payment_status,
  CASE WHEN lower(coalesce(p.method, '')) = 'bank' THEN 'banking' WHEN lower(coalesce(p.method, '')) = '' THEN 'cod'
       ELSE lower(p.method) END AS norm_payment_method,
  CASE lower(coalesce(o.status, '')) WHEN 'confirmed' THEN 'Confirmed' WHEN 'shipping' THEN 'Shipping'
       WHEN 'completed' THEN 'Completed' WHEN 'cancelled' THEN 'Cancelled' ELSE 'Pending' END AS db_order_status,
  CASE lower(coalesce(p.status, '')) WHEN 'paid' THEN 'Paid' WHEN 'failed' THEN 'Failed' ELSE 'Pending' END
       AS db_payment_status,
  CASE WHEN lower(coalesce(p.method, '')) IN ('banking', 'bank') THEN 'Bank' ELSE 'COD' END AS db_payment_method,
  CASE lower(coalesce(p.method, '')) WHEN 'cod' THEN 'COD' WHEN 'banking' THEN 'Bank' WHEN 'momo' THEN 'Momo'
       ELSE 'COD' END AS intake_payment_method
FROM shop_payments p JOIN shop_orders o ON o.order_id = p.order_id""")
    return q
