"""Oracle SQL (DuckDB) for backend lists, documents and list-page logic."""

from __future__ import annotations

from . import with_shop

PRODUCT_LIST = """SELECT CAST(p.product_id AS VARCHAR) AS id, p.product_id, coalesce(p.name, '') AS name,
       coalesce(p.description, '') AS description, coalesce(c.name, '') AS category, coalesce(b.name, '') AS brand,
       coalesce(v.minp, CAST(0 AS DECIMAL(10,2))) AS price, coalesce(img.image_url, '') AS image
FROM shop_products p LEFT JOIN shop_brands b ON p.brand_id = b.brand_id
LEFT JOIN shop_categories c ON p.category_id = c.category_id
LEFT JOIN (SELECT product_id, min(price) AS minp FROM shop_product_variants GROUP BY product_id) v
       ON v.product_id = p.product_id
LEFT JOIN shop_first_image img ON img.product_id = p.product_id"""
LIST_TABLES = ["products", "brands", "categories", "product_variants"]

VARIANTS_NAMED = """SELECT pv.*, s.name AS size_name, c.name AS color_name, c.hex_code
FROM shop_product_variants pv JOIN shop_sizes s ON pv.size_id = s.size_id JOIN shop_colors c ON pv.color_id = c.color_id"""

ADMIN_PRODUCTS = """SELECT p.product_id, coalesce(p.name, '') AS name, coalesce(p.description, '') AS description,
       coalesce(st.nz_price, CAST(0 AS DECIMAL(10,2))) AS price, coalesce(c.name, '') AS category,
       coalesce(b.name, '') AS brand, coalesce(img.image_url, '') AS image,
       CAST(coalesce(st.stock, 0) AS BIGINT) AS stock, coalesce(sz.sizes, CAST([] AS VARCHAR[])) AS sizes
FROM shop_products p LEFT JOIN shop_brands b ON p.brand_id = b.brand_id
LEFT JOIN shop_categories c ON p.category_id = c.category_id
LEFT JOIN shop_first_image img ON img.product_id = p.product_id
LEFT JOIN (SELECT product_id, sum(stock) AS stock,
                  arg_min(price, variant_id) FILTER (WHERE price <> 0) AS nz_price
           FROM vn GROUP BY product_id) st ON st.product_id = p.product_id
LEFT JOIN (SELECT product_id, list(size_name ORDER BY first_vid) AS sizes
           FROM (SELECT product_id, size_name, min(variant_id) AS first_vid FROM vn GROUP BY product_id, size_name) x
           GROUP BY product_id) sz ON sz.product_id = p.product_id"""

ADMIN_ORDERS = """SELECT CAST(o.order_id AS VARCHAR) AS id, o.order_id,
       CASE WHEN u.name IS NULL OR u.name = '' THEN 'Khách hàng' ELSE u.name END AS customer_name,
       coalesce(u.phone, '') AS phone, coalesce(ship.address, '') AS address,
       coalesce(o.total_amount, CAST(0 AS DECIMAL(12,2))) AS total_amount,
       CASE WHEN lower(coalesce(pay.method, '')) = 'bank' THEN 'banking'
            WHEN lower(coalesce(pay.method, '')) = '' THEN 'cod' ELSE lower(pay.method) END AS payment_method,
       CASE WHEN lower(coalesce(pay.status, '')) IN ('pending', 'paid', 'failed') THEN lower(pay.status)
            ELSE 'pending' END AS payment_status,
       CASE WHEN lower(coalesce(o.status, '')) IN ('pending', 'confirmed', 'shipping', 'completed', 'cancelled')
            THEN lower(o.status) ELSE 'pending' END AS order_status,
       o.order_date AS created_at
FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id
LEFT JOIN shop_latest_shipping ship ON ship.order_id = o.order_id
LEFT JOIN shop_latest_payment pay ON pay.order_id = o.order_id"""

ADMIN_USERS = """SELECT user_id, coalesce(name, '') AS name, coalesce(email, '') AS email, coalesce(phone, '') AS phone,
       coalesce(address, '') AS address, coalesce(role, 'user') AS role, created_at FROM shop_users"""

GROUP3 = """CASE WHEN contains({t}, 'bolt') THEN 'bolt' WHEN contains({t}, 'ring') THEN 'ring'
     WHEN contains({t}, 'plate') THEN 'plate' ELSE {other} END"""

SIZE_KEY = """CASE WHEN coalesce(list_position(['XS','S','M','L','XL','2XL','3XL','4XL','5XL'], upper({s})), 0) > 0 THEN 0
     WHEN TRY_CAST({s} AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END,
  coalesce(list_position(['XS','S','M','L','XL','2XL','3XL','4XL','5XL'], upper({s})), 0),
  CASE WHEN coalesce(list_position(['XS','S','M','L','XL','2XL','3XL','4XL','5XL'], upper({s})), 0) > 0 THEN 0.0
       ELSE coalesce(TRY_CAST({s} AS DOUBLE), 0.0) END,
  {s}"""


def oracle() -> dict[str, str]:
    q = {}
    vn = [("vn", VARIANTS_NAMED)]
    vtabs = ["product_variants", "sizes", "colors"]
    q["api_product_search"] = with_shop(LIST_TABLES, f"""SELECT * FROM ({PRODUCT_LIST}) x
WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring')
   OR contains(lower(brand), 'ring') OR contains(lower(category), 'ring')""", shared=["first_image"])
    q["api_product_document"] = with_shop(LIST_TABLES + vtabs, f"""
SELECT x.*, coalesce(im.images, CAST([] AS VARCHAR[])) AS images,
       coalesce(im.images[1], '') AS image_first,
       coalesce(sz.sizes, CAST([] AS VARCHAR[])) AS sizes,
       coalesce(co.colors, []) AS colors, coalesce(va.variants, []) AS variants
FROM (SELECT id, product_id, name, description, category, brand, price FROM ({PRODUCT_LIST}) l) x
LEFT JOIN (SELECT product_id, list(image_url ORDER BY image_id) AS images FROM shop_product_images GROUP BY product_id) im
       ON im.product_id = x.product_id
LEFT JOIN (SELECT product_id, list(size_name ORDER BY size_name) AS sizes
           FROM (SELECT DISTINCT product_id, size_name FROM vn) d GROUP BY product_id) sz ON sz.product_id = x.product_id
LEFT JOIN (SELECT product_id, list({{'name': color_name, 'hex': hex}} ORDER BY color_name, hex) AS colors
           FROM (SELECT DISTINCT product_id, color_name, coalesce(hex_code, '#000000') AS hex FROM vn) d
           GROUP BY product_id) co ON co.product_id = x.product_id
LEFT JOIN (SELECT product_id, list({{'variantId': variant_id, 'size': size_name, 'color': color_name,
                  'hex': coalesce(hex_code, '#000000'), 'price': price, 'stock': stock}} ORDER BY variant_id) AS variants
           FROM vn GROUP BY product_id) va ON va.product_id = x.product_id""",
        shared=["first_image"], extra=vn).replace("image_first", "image")
    q["admin_product_list"] = with_shop(LIST_TABLES + vtabs, ADMIN_PRODUCTS, shared=["first_image"], extra=vn)
    q["admin_order_list"] = with_shop(["orders", "users"], ADMIN_ORDERS,
                                      shared=["latest_payment", "latest_shipping"])
    q["api_order_list"] = with_shop(["orders", "users"], """
SELECT CAST(o.order_id AS VARCHAR) AS id, o.order_id, o.order_date, o.status,
       coalesce(o.total_amount, CAST(0 AS DECIMAL(12,2))) AS total_amount,
       {'name': coalesce(u.name, ''), 'email': coalesce(u.email, ''), 'phone': coalesce(u.phone, '')} AS customer
FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id""")
    q["admin_user_search"] = with_shop(["users"], f"SELECT * FROM ({ADMIN_USERS}) x WHERE contains(lower(email), 'c10')")
    q["admin_user_filter"] = with_shop(["users"], f"SELECT * FROM ({ADMIN_USERS}) x WHERE role = 'admin'")
    q["shop_filter"] = with_shop(LIST_TABLES, f"SELECT * FROM ({PRODUCT_LIST}) x WHERE price >= 900 AND price <= 990",
                                 shared=["first_image"])
    q["sort_price"] = with_shop(LIST_TABLES, PRODUCT_LIST, shared=["first_image"])
    q["facet_brands"] = with_shop(LIST_TABLES, f"SELECT DISTINCT trim(brand) AS brand FROM ({PRODUCT_LIST}) x WHERE trim(brand) <> ''",
                                  shared=["first_image"])
    q["home_popular"] = with_shop(LIST_TABLES, f"SELECT * FROM ({PRODUCT_LIST}) x ORDER BY product_id DESC LIMIT 8",
                                  shared=["first_image"])
    grp = GROUP3.format(t="lower(concat_ws(' ', category, name))", other="'Khác'")
    q["admin_product_filter"] = with_shop(LIST_TABLES + vtabs, f"""
SELECT *, {grp} AS product_group FROM ({ADMIN_PRODUCTS}) x
WHERE (contains(lower(CAST(product_id AS VARCHAR)), 'ring') OR contains(lower(name), 'ring')
       OR contains(lower(brand), 'ring') OR contains(lower(category), 'ring'))
  AND {grp} = 'ring'""", shared=["first_image"], extra=vn)
    q["admin_order_filter"] = with_shop(["orders", "users"], f"""
SELECT * FROM ({ADMIN_ORDERS}) x
WHERE contains(lower(payment_method), 'bank') AND order_status IN ('completed', 'shipping')""",
        shared=["latest_payment", "latest_shipping"])
    q["admin_counts_by_group"] = with_shop(LIST_TABLES + vtabs + ["users"], f"""
SELECT 'product_group' AS kind, {grp} AS grp, count(*) AS n FROM ({ADMIN_PRODUCTS}) x GROUP BY 2
UNION ALL SELECT 'role', role, count(*) FROM ({ADMIN_USERS}) u GROUP BY role""", shared=["first_image"], extra=vn)
    q["category_group"] = with_shop(LIST_TABLES, f"""
SELECT product_id, category, {GROUP3.format(t="lower(trim(category))", other="''")} AS category_group
FROM ({PRODUCT_LIST}) x""", shared=["first_image"])
    q["product_group"] = with_shop(LIST_TABLES + vtabs, f"""
SELECT product_id, name, category, {grp} AS product_group FROM ({ADMIN_PRODUCTS}) x""", shared=["first_image"], extra=vn)
    q["is_shoe"] = with_shop(LIST_TABLES, """
SELECT product_id, contains(lower(concat_ws(' ', category, name, brand)), 'giày')
       OR contains(lower(concat_ws(' ', category, name, brand)), 'shoe') AS is_shoe
FROM (""" + PRODUCT_LIST + ") x", shared=["first_image"])
    q["distinct_sizes"] = with_shop(vtabs, """
SELECT product_id, list(size_name ORDER BY size_name) AS sizes
FROM (SELECT DISTINCT product_id, size_name FROM vn) d GROUP BY product_id""", extra=vn)
    q["distinct_colors"] = with_shop(vtabs, """
SELECT product_id, list({'name': color_name, 'hex': hex} ORDER BY color_name, hex) AS colors
FROM (SELECT DISTINCT product_id, color_name, coalesce(hex_code, '#000000') AS hex FROM vn) d GROUP BY product_id""",
        extra=vn)
    q["sort_sizes"] = with_shop(vtabs, f"""
SELECT product_id, list(size_name ORDER BY {SIZE_KEY.format(s='size_name')}) AS sizes
FROM (SELECT DISTINCT product_id, trim(size_name) AS size_name FROM vn WHERE trim(size_name) <> '') d
GROUP BY product_id""", extra=vn)
    q["size_color_availability"] = with_shop(vtabs, f"""
SELECT a.product_id, a.color, a.hex, s.sizes FROM
 (SELECT product_id, color_name AS color, arg_min(coalesce(hex_code, '#000000'), variant_id) AS hex
  FROM vn WHERE size_name IS NOT NULL AND size_name <> '' GROUP BY product_id, color_name) a
 JOIN (SELECT product_id, color_name, list(size_name ORDER BY {SIZE_KEY.format(s='size_name')}) AS sizes
       FROM (SELECT DISTINCT product_id, color_name, trim(size_name) AS size_name FROM vn
             WHERE size_name IS NOT NULL AND trim(size_name) <> '') d
       GROUP BY product_id, color_name) s ON s.product_id = a.product_id AND s.color_name = a.color""", extra=vn)
    q["colors_by_size"] = with_shop(vtabs, """
SELECT product_id, size_name AS size, list({'name': color_name, 'hex': hex} ORDER BY first_vid) AS colors
FROM (SELECT product_id, size_name, color_name, min(variant_id) AS first_vid,
             arg_min(coalesce(hex_code, '#000000'), variant_id) AS hex
      FROM vn GROUP BY product_id, size_name, color_name) x
GROUP BY product_id, size_name""", extra=vn)
    q["cart_totals"] = with_shop(["cart_items", "product_variants"], """
SELECT ci.cart_id, CAST(sum(ci.quantity) AS BIGINT) AS total_items,
       CAST(sum(ci.quantity * m.p) AS DECIMAL(38,2)) AS total_price
FROM shop_cart_items ci JOIN shop_product_variants v ON v.variant_id = ci.variant_id
JOIN (SELECT product_id, min(price) AS p FROM shop_product_variants GROUP BY product_id) m ON m.product_id = v.product_id
GROUP BY ci.cart_id""")
    q["cart_merge"] = """
WITH RECURSIVE e AS (
SELECT user_id AS cart_id, (event_id * 17) % ((SELECT count(*) FROM part) // 50 + 1) AS product_id, event_id AS seq,
       CASE WHEN event_type = 'purchase' THEN 'set' WHEN event_type = 'signup' THEN 'remove'
            WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'clear' ELSE 'add' END AS op,
       CASE WHEN event_type = 'purchase' THEN event_id % 3 ELSE 1 + event_id % 3 END AS q FROM events),
seen AS (SELECT DISTINCT cart_id, product_id FROM e WHERE op <> 'clear'),
steps AS (SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY seq) AS n FROM (
  SELECT cart_id, product_id, seq, op, q FROM e WHERE op <> 'clear'
  UNION ALL SELECT s.cart_id, s.product_id, e.seq, 'remove', 0 FROM seen s JOIN e ON e.cart_id = s.cart_id AND e.op = 'clear') x),
fold AS (SELECT cart_id, product_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS held FROM seen
  UNION ALL
  SELECT f.cart_id, f.product_id, s.n,
         CASE s.op WHEN 'add' THEN coalesce(f.held, 0) + s.q WHEN 'remove' THEN NULL
                   ELSE CASE WHEN f.held IS NOT NULL AND s.q > 0 THEN s.q END END
  FROM fold f JOIN steps s ON s.cart_id = f.cart_id AND s.product_id = f.product_id AND s.n = f.n + 1)
SELECT cart_id, product_id, '' AS size, '' AS color, CAST(arg_max(held, n) AS INT) AS quantity FROM (
  SELECT *, max(n) OVER (PARTITION BY cart_id, product_id) AS last FROM fold) z
WHERE n = last AND held IS NOT NULL GROUP BY 1, 2"""
    return q
