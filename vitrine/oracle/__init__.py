"""Independent SQL texts of every registered query, for DuckDB.

Each text starts with the shop projections of FIXTURES F2 as CTEs named
``shop_<table>`` (the prefix keeps them apart from the driver's own ``orders``
view), then the operator's query in plain SQL. Only the CTEs a query needs
(and their dependencies) are emitted.
"""

from __future__ import annotations

SHOP_CTES = {
    "users": """SELECT c_custkey AS user_id, c_name AS name,
       'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '09' || CAST(10000000 + c_custkey AS VARCHAR) END AS phone,
       n_name AS address, CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role,
       CAST(NULL AS TIMESTAMP) AS created_at
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "brands": "SELECT DISTINCT CAST(substring(p_brand, 7) AS INT) AS brand_id, p_brand AS name FROM part",
    "categories": """SELECT DISTINCT CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
       WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS INT) AS category_id, p_type AS name FROM part""",
    "colors": """SELECT CAST(dense_rank() OVER (ORDER BY name) AS INT) AS color_id, name, '#' || name AS hex_code
FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) c""",
    "sizes": "SELECT DISTINCT p_size AS size_id, CAST(p_size AS VARCHAR) AS name FROM part",
    "products": """SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS product_id, p_name AS name,
       p_name || ' ' || p_type AS description,
       CASE WHEN floor(p_partkey / 4) % 17 = 0 THEN NULL ELSE CAST(substring(p_brand, 7) AS INT) END AS brand_id,
       CASE WHEN floor(p_partkey / 4) % 19 = 0 THEN NULL WHEN p_type = 'ECONOMY' THEN 1 WHEN p_type = 'LARGE' THEN 2
            WHEN p_type = 'MEDIUM' THEN 3 WHEN p_type = 'PROMO' THEN 4 WHEN p_type = 'SMALL' THEN 5 ELSE 6 END AS category_id,
       CAST(NULL AS TIMESTAMP) AS created_at
FROM part WHERE p_partkey % 4 = 0""",
    "product_variants": """SELECT v.variant_id, v.product_id, v.size_id, c.color_id, v.price, v.stock,
       CAST(NULL AS TIMESTAMP) AS created_at
FROM (SELECT p_partkey AS variant_id, CAST(floor(p_partkey / 4) AS BIGINT) AS product_id, p_size AS size_id,
             split_part(p_name, ' ', 1) AS color_name, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
             CAST(CASE WHEN floor(p_partkey / 4) % 5 = 0 THEN 0 WHEN floor(p_partkey / 4) % 5 = 1 THEN p_partkey % 2
                       ELSE (p_partkey * 7) % 13 END AS INT) AS stock
      FROM part WHERE floor(p_partkey / 4) % 23 <> 0) v
JOIN shop_colors c ON c.name = v.color_name""",
    "sales": """SELECT * FROM (VALUES (1, 'Sale A', 30, TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '1998-12-31 00:00:00'),
       (2, 'Sale B', 20, TIMESTAMP '1999-01-01 00:00:00', TIMESTAMP '1999-12-31 00:00:00'),
       (3, 'Sale C', 10, TIMESTAMP '1998-06-01 00:00:00', TIMESTAMP '1998-06-30 00:00:00'))
       t(sale_id, name, discount_percent, start_date, end_date)""",
    "product_sales": """SELECT DISTINCT CAST(floor(p_partkey / 4) AS BIGINT) AS product_id,
       CASE WHEN floor(p_partkey / 4) % 3 = 0 THEN 1 ELSE 2 END AS sale_id FROM part WHERE floor(p_partkey / 4) % 3 <> 2
UNION ALL SELECT DISTINCT CAST(floor(p_partkey / 4) AS BIGINT), 3 FROM part WHERE floor(p_partkey / 4) % 2 = 0""",
    "product_images": """SELECT CAST(floor(p_partkey / 4) * 4 + p_partkey % 4 AS BIGINT) AS image_id,
       CAST(floor(p_partkey / 4) AS BIGINT) AS product_id, 'img/' || CAST(p_partkey AS VARCHAR) AS image_url
FROM part WHERE p_partkey % 4 IN (1, 2) AND floor(p_partkey / 4) % 29 <> 0""",
    "orders": """SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_date,
       CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'P' THEN 'Pending'
            WHEN o_orderkey % 3 = 0 THEN 'Confirmed' WHEN o_orderkey % 3 = 1 THEN 'Shipping' ELSE 'Cancelled' END AS status,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount
FROM orders""",
    "order_details": """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS order_detail_id,
       l_orderkey AS order_id, l_partkey AS variant_id, CAST(l_quantity AS INT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price
FROM lineitem""",
    "payments": """SELECT o_orderkey * 2 AS payment_id, o_orderkey AS order_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Bank' ELSE 'COD' END AS method, 'Pending' AS status
FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, 'Bank', CASE WHEN o_orderkey % 8 = 0 THEN 'Paid' ELSE 'Failed' END
FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0""",
    "shipping": """SELECT l_orderkey * 1000 + l_linenumber AS shipping_id, l_orderkey AS order_id,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE 'addr ' || CAST(l_orderkey * 1000 + l_linenumber AS VARCHAR) END AS address,
       CASE WHEN l_linenumber % 2 = 0 THEN 'Delivered' ELSE 'Preparing' END AS status
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) s""",
    "reviews": """SELECT min(event_id) AS review_id, user_id, product_id, CAST(1 + min(event_id) % 5 AS INT) AS rating,
       CASE WHEN min(event_id) % 9 = 0 THEN 'ok' WHEN min(event_id) % 10 = 0 THEN NULL
            ELSE 'review ' || CAST(min(event_id) AS VARCHAR) END AS comment, min(ts) AS review_date
FROM (SELECT event_id, user_id, ts, (event_id * 31) % (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS product_id
      FROM events) e
GROUP BY user_id, product_id""",
    "cart": "SELECT DISTINCT user_id AS cart_id, user_id FROM events",
    "cart_items": """SELECT cart_id * (SELECT count(*) FROM part) + variant_id AS cart_item_id, cart_id, variant_id, CAST(sum(qty) AS INT) AS quantity
FROM (SELECT user_id AS cart_id, (event_id * 17) % (SELECT count(*) FROM part) AS variant_id, 1 + event_id % 3 AS qty
      FROM events) c
GROUP BY cart_id, variant_id""",
}

DEPENDS = {"product_variants": ["colors"]}

AS_OF_SQL = "TIMESTAMP '1998-06-15 00:00:00'"

# Oracle forms of the shared sub-plans.
SHARED_CTES = {
    "active_discount": f"""SELECT ps.product_id, max(s.discount_percent) AS max_discount_percent
FROM shop_product_sales ps JOIN shop_sales s ON ps.sale_id = s.sale_id
WHERE {AS_OF_SQL} BETWEEN s.start_date AND s.end_date GROUP BY ps.product_id""",
    "review_rollup": """SELECT product_id,
       CAST(((sum(rating) * 200 + count(*)) // (2 * count(*))) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS avg_rating,
       count(*) AS review_count
FROM shop_reviews GROUP BY product_id""",
    "first_image": """SELECT product_id, image_url FROM (
  SELECT product_id, image_url, row_number() OVER (PARTITION BY product_id ORDER BY image_id) AS rn
  FROM shop_product_images) x WHERE rn = 1""",
    "latest_payment": """SELECT order_id, method, status FROM (
  SELECT order_id, method, status, row_number() OVER (PARTITION BY order_id ORDER BY payment_id DESC) AS rn
  FROM shop_payments) x WHERE rn = 1""",
    "latest_shipping": """SELECT order_id, address, status FROM (
  SELECT order_id, address, status, row_number() OVER (PARTITION BY order_id ORDER BY shipping_id DESC) AS rn
  FROM shop_shipping) x WHERE rn = 1""",
    "variant_rollup": """SELECT product_id, count(*) AS total_variants, sum(stock) AS total_stock,
       min(price) AS min_price, max(price) AS max_price
FROM shop_product_variants GROUP BY product_id""",
}
SHARED_DEPENDS = {
    "active_discount": ["product_sales", "sales"],
    "review_rollup": ["reviews"],
    "first_image": ["product_images"],
    "latest_payment": ["payments"],
    "latest_shipping": ["shipping"],
    "variant_rollup": ["product_variants"],
}


def with_shop(tables: list[str], body: str, shared: list[str] | None = None,
              extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it reads."""
    order: list[str] = []

    def add(t: str) -> None:
        for d in DEPENDS.get(t, []):
            add(d)
        if t not in order:
            order.append(t)

    for t in tables:
        add(t)
    for s in shared or []:
        for t in SHARED_DEPENDS[s]:
            add(t)
    parts = [f"shop_{t} AS (\n{SHOP_CTES[t]}\n)" for t in order]
    parts += [f"shop_{s} AS (\n{SHARED_CTES[s]}\n)" for s in shared or []]
    parts += [f"{name} AS (\n{sql}\n)" for name, sql in extra or []]
    return "WITH " + ",\n".join(parts) + "\n" + body
