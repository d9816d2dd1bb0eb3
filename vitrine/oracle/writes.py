"""Oracle SQL (DuckDB) for the write path over the driver-run request feeds."""

from __future__ import annotations

from . import with_shop
from .bulk import _recursive

HEADERS = """SELECT o_orderkey AS payload_id, c_name AS name,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
       ' 08' || CAST(c_custkey AS VARCHAR) AS phone, n_name AS address
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

ITEMS = """SELECT l_orderkey AS payload_id, l_linenumber - 1 AS pos, CAST(floor(l_partkey / 4) AS BIGINT) AS product_id,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size,
       CASE WHEN l_linenumber % 2 = 1 THEN split_part(p_name, ' ', 1) ELSE '' END AS color
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VN = """SELECT pv.*, s.name AS size_name, c.name AS color_name
FROM shop_product_variants pv JOIN shop_sizes s ON pv.size_id = s.size_id JOIN shop_colors c ON pv.color_id = c.color_id"""

PRODUCT_FEED = """SELECT p_partkey AS seq,
       CASE WHEN p_size > 25 THEN CAST(floor(p_partkey / 4) AS BIGINT) END AS product_id,
       p_name AS name, CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_type AS category, p_brand AS brand,
       p_type || ' ' || p_name AS description, p_size AS stock, ['' || p_size, '' || (p_size % 7 + 40)] AS size_names,
       concat_ws(', ', CAST(p_size AS VARCHAR), ' ', CAST(p_size % 7 + 40 AS VARCHAR)) AS sizes
FROM part"""

USER_FEED = """SELECT seq, c_custkey AS user_id, upper(c_name) AS name, box || '@example.com' AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' WHEN c_mktsegment = 'MACHINERY' THEN 'manager' ELSE 'user' END AS role
FROM (
  SELECT *, c_custkey AS seq,
         'c' || CAST(CASE WHEN c_acctbal < -800 THEN c_custkey % 50 + 1 ELSE c_custkey END AS VARCHAR) AS box FROM customer
  UNION ALL SELECT *, 1000000000000 + c_custkey, 'n' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT *, 3000000000000 - c_custkey, 'C' || CAST(c_custkey + 1 AS VARCHAR) FROM customer
  WHERE c_acctbal > 5000) x"""

# One step per valid edit: ``has`` maps users to addresses, ``held`` addresses to users.
USER_REPLAY = [
    ("feed", USER_FEED),
    ("v", """SELECT u.*, lower(rtrim(u.email)) AS k,
       CASE WHEN trim(u.name) = '' THEN 'name required' WHEN trim(u.email) = '' THEN 'email required'
            WHEN u.role NOT IN ('admin', 'user') THEN 'invalid role'
            WHEN NOT EXISTS (SELECT 1 FROM shop_users s WHERE s.user_id = u.user_id) THEN 'user not found'
       END AS reason FROM feed u"""),
    ("claim", "SELECT row_number() OVER (ORDER BY seq) AS i, seq, user_id, k FROM v WHERE reason IS NULL"),
    ("r", """SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS ok,
       (SELECT map(list(user_id), list(lower(rtrim(email)))) FROM shop_users) AS has,
       (SELECT map(list(lower(rtrim(email))), list(user_id)) FROM shop_users) AS held
UNION ALL
SELECT i, seq, ok,
       CASE WHEN ok THEN map_concat(has, MAP {user_id: k}) ELSE has END,
       CASE WHEN NOT ok OR mine = k THEN held ELSE map_concat(held, MAP {mine: CAST(-1 AS BIGINT), k: user_id}) END
FROM (SELECT c.i, c.seq, c.user_id, c.k, r.has, r.held, r.has[c.user_id] AS mine,
             coalesce(r.held[c.k], -1) IN (-1, c.user_id) AS ok
      FROM r JOIN claim c ON c.i = r.i + 1) s"""),
    ("w", """SELECT v.*, CASE WHEN v.reason IS NOT NULL THEN v.reason WHEN NOT r.ok THEN 'email exists' END AS r2
  FROM v LEFT JOIN r ON r.seq = v.seq"""),
    ("won", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS o
  FROM w WHERE r2 IS NULL) x WHERE o = 1""")]

DELETES = [
    ("lines", "SELECT * FROM shop_order_details WHERE floor(variant_id / 4) % 3 <> 0"),
    ("asked", """SELECT p_partkey AS seq, CASE WHEN p_size > 40 THEN -p_partkey - 1
       WHEN p_size > 1 THEN CAST(floor(p_partkey / 4) AS BIGINT) END AS product_id FROM part"""),
    ("gone", """SELECT DISTINCT product_id FROM asked WHERE product_id <> 0 AND product_id IN (SELECT product_id FROM shop_products)
  AND product_id NOT IN (SELECT pv.product_id FROM shop_product_variants pv JOIN lines l ON l.variant_id = pv.variant_id)""")]


def _dims_sql() -> str:
    blocks = []
    for kind, table, id_col, expr in (
            ("brand", "brands", "brand_id", "SELECT trim(brand) AS name, seq FROM feed"),
            ("category", "categories", "category_id", "SELECT trim(category) AS name, seq FROM feed"),
            ("size", "sizes", "size_id",
             "SELECT trim(unnest(string_split(sizes, ','))) AS name, seq FROM feed"),
            ("color", "colors", "color_id", "SELECT 'Default' AS name, seq FROM feed")):
        blocks.append(f"""SELECT '{kind}' AS kind,
       CAST((SELECT max({id_col}) FROM shop_{table}) + row_number() OVER (ORDER BY seq, k) AS BIGINT) AS id, name
FROM (SELECT lower(rtrim(name)) AS k, arg_min(name, seq) AS name, min(seq) AS seq
      FROM ({expr}) n WHERE name <> '' GROUP BY 1) f
WHERE k NOT IN (SELECT lower(rtrim(name)) FROM shop_{table})""")
    return "\nUNION ALL\n".join(blocks)


def oracle() -> dict[str, str]:
    q = {}
    q["w_variant_resolve"] = with_shop(["product_variants", "sizes", "colors"], """
SELECT i.payload_id, i.pos, i.product_id,
       CASE WHEN i.size <> '' AND i.color <> '' THEN e.vid ELSE f.vid END AS variant_id
FROM items i
LEFT JOIN (SELECT product_id, size_name, color_name, min(variant_id) AS vid FROM vn GROUP BY 1, 2, 3) e
       ON e.product_id = i.product_id AND e.size_name = i.size AND e.color_name = i.color
LEFT JOIN (SELECT product_id, min(variant_id) AS vid FROM vn GROUP BY 1) f ON f.product_id = i.product_id""",
        extra=[("items", ITEMS), ("vn", VN)])
    q["w_assign_keys"] = with_shop(["orders"], """
SELECT payload_id, (SELECT max(order_id) FROM shop_orders) + row_number() OVER (ORDER BY payload_id) AS order_id
FROM headers""", extra=[("headers", HEADERS)])
    q["w_customer_upsert"] = with_shop(["users"], """
SELECT * FROM shop_users WHERE user_id NOT IN (SELECT user_id FROM upd)
UNION ALL SELECT * FROM upd UNION ALL SELECT * FROM fresh""", extra=[
        ("headers", HEADERS),
        ("h", """SELECT payload_id,
       CASE WHEN trim(coalesce(email, '')) <> '' THEN trim(email)
            ELSE 'guest_' || CAST(payload_id AS VARCHAR) || '@guest.local' END AS email,
       CASE WHEN name IS NULL OR name = '' THEN 'Khách hàng' ELSE trim(name) END AS name,
       trim(coalesce(phone, '')) AS phone, trim(coalesce(address, '')) AS address FROM headers"""),
        ("per", """SELECT lower(rtrim(email)) AS k, arg_min(email, payload_id) AS email, min(payload_id) AS first_pid,
       arg_max(name, payload_id) FILTER (WHERE name <> '') AS nb_name,
       arg_max(phone, payload_id) FILTER (WHERE phone <> '') AS nb_phone,
       arg_max(address, payload_id) FILTER (WHERE address <> '') AS nb_address,
       arg_min(name, payload_id) AS first_name, arg_min(phone, payload_id) AS first_phone,
       arg_min(address, payload_id) AS first_address
FROM h GROUP BY 1"""),
        ("m", """SELECT per.*, uk.uid FROM per LEFT JOIN
       (SELECT lower(rtrim(email)) AS k, min(user_id) AS uid FROM shop_users GROUP BY 1) uk ON uk.k = per.k"""),
        ("upd", """SELECT u.user_id, coalesce(m.nb_name, u.name) AS name, u.email, coalesce(m.nb_phone, u.phone) AS phone,
       coalesce(m.nb_address, u.address) AS address, u.role, u.created_at
FROM shop_users u JOIN m ON m.uid = u.user_id"""),
        ("fresh", """SELECT (SELECT max(user_id) FROM shop_users) + row_number() OVER (ORDER BY first_pid) AS user_id,
       coalesce(nb_name, first_name) AS name, email, coalesce(nb_phone, first_phone) AS phone,
       coalesce(nb_address, first_address) AS address, 'user' AS role, TIMESTAMP '1998-06-15 00:00:00' AS created_at
FROM m WHERE uid IS NULL""")])
    q["w_dimension_get_or_create"] = with_shop(["brands", "categories", "sizes", "colors"], _dims_sql(),
                                               extra=[("feed", PRODUCT_FEED)])
    judged = [
        ("feed", PRODUCT_FEED),
        ("p", """SELECT f.*, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name required'
                     WHEN price IS NULL OR price < 0 THEN 'invalid price'
                     WHEN product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM shop_products)
                     THEN 'product not found' END AS reason FROM feed f"""),
        ("c", """SELECT seq, (SELECT max(product_id) FROM shop_products) + row_number() OVER (ORDER BY seq) AS new_id
FROM p WHERE reason IS NULL AND product_id IS NULL""")]
    # Brands and categories of the feed all exist; sizes and the default colour may not.
    chosen = judged + [
        ("chosen", """SELECT p.* REPLACE (coalesce(p.product_id, c.new_id) AS product_id) FROM p LEFT JOIN c ON c.seq = p.seq
WHERE p.reason IS NULL AND (c.seq IS NOT NULL OR p.seq = (
  SELECT max(o.seq) FROM p o WHERE o.reason IS NULL AND o.product_id = p.product_id))"""),
        ("parts", """SELECT c.product_id, c.seq, c.price, c.stock, i AS pos, c.size_names[i + 1] AS size_name
FROM chosen c CROSS JOIN (VALUES (0), (1)) two(i) WHERE i = 0 OR c.size_names[2] <> c.size_names[1]"""),
        ("new_sizes", """SELECT (SELECT max(size_id) FROM shop_sizes) + row_number() OVER (ORDER BY seq, size_name) AS size_id,
       size_name AS name FROM (SELECT size_name, min(seq) AS seq FROM parts GROUP BY 1) x
WHERE size_name NOT IN (SELECT name FROM shop_sizes)"""),
        ("all_sizes", "SELECT size_id, name FROM shop_sizes UNION ALL SELECT size_id, name FROM new_sizes")]
    tables = ["products", "brands", "categories", "sizes", "colors", "product_variants"]
    q["w_product_upsert"] = with_shop(["products"], """
SELECT p.seq, coalesce(p.product_id, c.new_id) AS product_id, p.reason IS NULL AS accepted, p.reason
FROM p LEFT JOIN c ON c.seq = p.seq""", extra=judged)
    q["w_product_upsert_products"] = with_shop(tables, """
SELECT product_id, name, description, brand_id, category_id, created_at FROM shop_products
WHERE product_id NOT IN (SELECT product_id FROM chosen)
UNION ALL SELECT c.product_id, trim(c.name), trim(c.description), b.brand_id, g.category_id, NULL
FROM chosen c JOIN shop_brands b ON b.name = c.brand JOIN shop_categories g ON g.name = c.category""", extra=chosen)
    q["w_product_upsert_variants"] = with_shop(tables, """
SELECT variant_id, product_id, size_id, color_id, price, stock, created_at FROM shop_product_variants
WHERE product_id NOT IN (SELECT product_id FROM chosen)
UNION ALL SELECT (SELECT max(variant_id) FROM shop_product_variants) + row_number() OVER (ORDER BY t.product_id, t.pos),
       t.product_id, z.size_id, (SELECT max(color_id) + 1 FROM shop_colors), t.price,
       CASE WHEN t.pos = 0 THEN t.stock ELSE 0 END, NULL
FROM parts t JOIN all_sizes z ON z.name = t.size_name""", extra=chosen)
    q["w_user_update"] = _recursive(with_shop(["users"], """
SELECT seq, user_id, r2 IS NULL AS accepted, r2 AS reason FROM w""", extra=USER_REPLAY))
    q["w_user_update_users"] = _recursive(with_shop(["users"], """
SELECT s.user_id, coalesce(w.name, s.name) AS name, coalesce(w.email, s.email) AS email,
       CASE WHEN w.user_id IS NULL THEN s.phone END AS phone, s.address, coalesce(w.role, s.role) AS role, s.created_at
FROM shop_users s LEFT JOIN won w ON w.user_id = s.user_id""", extra=USER_REPLAY))
    q["w_product_delete"] = with_shop(["products", "product_variants", "order_details"], """
SELECT seq, product_id, reason IS NULL AS accepted, reason FROM (
  SELECT seq, product_id, CASE WHEN product_id IS NULL OR product_id = 0 THEN 'invalid id'
    WHEN product_id NOT IN (SELECT product_id FROM shop_products) THEN 'product not found'
    WHEN product_id NOT IN (SELECT product_id FROM gone) THEN 'product was sold'
    WHEN row_number() OVER (PARTITION BY product_id ORDER BY seq) > 1 THEN 'product not found' END AS reason
  FROM asked) x""", extra=DELETES)
    for name, table in (("products", "products"), ("variants", "product_variants"),
                        ("sales", "product_sales"), ("images", "product_images"), ("reviews", "reviews")):
        q[f"w_product_delete_{name}"] = with_shop(
            ["products", "product_variants", "order_details", table],
            f"SELECT * FROM shop_{table} WHERE product_id NOT IN (SELECT product_id FROM gone)", extra=DELETES)
    for name, rows in (("carts", "shop_cart_items"), ("lines", "lines")):
        q[f"w_product_delete_{name}"] = with_shop(
            ["products", "product_variants", "order_details", "cart_items"], f"""
SELECT * FROM {rows} WHERE variant_id NOT IN (
  SELECT variant_id FROM shop_product_variants WHERE product_id IN (SELECT product_id FROM gone))""", extra=DELETES)
    edits = [("edits", """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS order_id,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Shipping' END AS new_status,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'F' THEN 'Paid' ELSE 'Pending' END AS new_pay
FROM orders""")]
    q["w_order_status_update"] = with_shop(["orders"], """
SELECT e.seq, e.order_id, s.order_id IS NOT NULL AS accepted,
       CASE WHEN s.order_id IS NULL THEN 'order not found' END AS reason
FROM edits e LEFT JOIN shop_orders s ON s.order_id = e.order_id""", extra=edits)
    q["w_order_status_update_orders"] = with_shop(["orders"], """
SELECT s.order_id, s.user_id, s.order_date, coalesce(e.new_status, s.status) AS status, s.total_amount
FROM shop_orders s LEFT JOIN edits e ON e.order_id = s.order_id""", extra=edits)
    q["w_order_status_update_payments"] = with_shop(["orders", "payments"], """
SELECT p.payment_id, p.order_id, p.method,
       CASE WHEN p.payment_id = max(p.payment_id) OVER (PARTITION BY p.order_id) THEN coalesce(e.new_pay, p.status)
            ELSE p.status END AS status
FROM shop_payments p LEFT JOIN edits e ON e.order_id = p.order_id
UNION ALL SELECT (SELECT max(payment_id) FROM shop_payments) + row_number() OVER (ORDER BY e.order_id), e.order_id, 'Bank', e.new_pay
FROM edits e JOIN shop_orders s ON s.order_id = e.order_id
WHERE e.new_pay IS NOT NULL AND e.order_id NOT IN (SELECT order_id FROM shop_payments)""", extra=edits)
    return q
