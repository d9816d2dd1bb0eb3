"""Oracle SQL (DuckDB) for the bulk jobs. The order-dependent ones are recursive
CTEs that take one request after the other, each with the stock that the accepted
ones before it left."""

from __future__ import annotations

from . import AS_OF_SQL, with_shop

REVIEW_FEED = """SELECT event_id AS seq, user_id,
       (event_id * 31) % (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS product_id,
       CAST(CASE WHEN event_id % 89 <> 0 THEN event_id % 7 END AS INT) AS rating,
       CASE WHEN event_id % 9 = 0 THEN 'ok' WHEN event_id % 10 = 0 THEN NULL
            ELSE 'review ' || CAST(event_id AS VARCHAR) END AS comment
FROM events"""


CART_FEED = """SELECT event_id AS seq, user_id, (event_id * 17) % (SELECT count(*) FROM part) AS variant_id,
       CAST(CASE WHEN event_id % 97 <> 0 THEN event_id % 4 END AS INT) AS quantity
FROM events"""

# The order-dependent jobs run on a restocked shop (see registry.restocked).
STOCKED = ("stocked", """SELECT * REPLACE (CAST(stock + CASE WHEN variant_id % 20 = 0 THEN 0 ELSE 100 END AS INT) AS stock)
FROM shop_product_variants""")

# The sequential add-to-cart fold per (cart, variant) as a recursive CTE: each
# step adds the next event's quantity when it fits the stock, else skips it.
CART_FOLD = [
    ("feed", CART_FEED),
    ("ev", """SELECT f.*, c.cart_id, v.stock,
       CASE WHEN f.quantity IS NULL OR f.quantity <= 0 THEN 'invalid quantity' WHEN c.cart_id IS NULL THEN 'no cart'
            WHEN v.stock IS NULL THEN 'unknown variant' END AS pre
FROM feed f LEFT JOIN shop_cart c ON c.user_id = f.user_id
LEFT JOIN shop_product_variants v ON v.variant_id = f.variant_id"""),
    ("cand", """SELECT ev.*, row_number() OVER (PARTITION BY cart_id, variant_id ORDER BY seq) AS rn
FROM ev WHERE pre IS NULL"""),
    ("r", """SELECT k.cart_id, k.variant_id, CAST(0 AS BIGINT) AS rn, CAST(coalesce(h.quantity, 0) AS BIGINT) AS cur,
       CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS ok
FROM (SELECT DISTINCT cart_id, variant_id FROM cand) k
LEFT JOIN shop_cart_items h ON h.cart_id = k.cart_id AND h.variant_id = k.variant_id
UNION ALL
SELECT r.cart_id, r.variant_id, c.rn,
       CASE WHEN r.cur + c.quantity <= c.stock THEN r.cur + c.quantity ELSE r.cur END,
       c.seq, r.cur + c.quantity <= c.stock
FROM r JOIN cand c ON c.cart_id = r.cart_id AND c.variant_id = r.variant_id AND c.rn = r.rn + 1"""),
]


# All-or-nothing requests in ``step`` order. The recursion keeps one row per
# variant ('v': what is left of it) and one per step ('s': 1 when accepted); a step
# reads and replaces the rows of its own variants.
ALLOCATE = [
    ("r(k, id, val, step) USING KEY (k, id)", """SELECT 'v', CAST(variant_id AS BIGINT), CAST(stock AS BIGINT), CAST(0 AS BIGINT)
FROM stocked WHERE variant_id IN (SELECT variant_id FROM lines)
UNION
(WITH t AS (SELECT l.step, l.variant_id, l.quantity, x.val, bool_and(l.quantity <= x.val) OVER () AS ok
            FROM lines l JOIN (SELECT max(step) + 1 AS s FROM r) n ON l.step = n.s
            JOIN recurring.r x ON x.k = 'v' AND x.id = l.variant_id)
 SELECT 'v', variant_id, val - CASE WHEN ok THEN quantity ELSE 0 END, step FROM t
 UNION ALL SELECT DISTINCT 's', step, CAST(ok AS BIGINT), step FROM t)"""),
]

CHECKOUT_FOLD = [
    STOCKED,
    ("carts", """SELECT DISTINCT cart_id FROM shop_cart_items
WHERE cart_id IN (SELECT c.cart_id FROM shop_cart c JOIN shop_users u ON u.user_id = c.user_id)"""),
    ("lines", """SELECT dense_rank() OVER (ORDER BY ci.cart_id) AS step, CAST(ci.cart_id AS BIGINT) AS cart_id,
       CAST(ci.variant_id AS BIGINT) AS variant_id, CAST(ci.quantity AS BIGINT) AS quantity, v.price
FROM shop_cart_items ci JOIN carts cs ON cs.cart_id = ci.cart_id
JOIN stocked v ON v.variant_id = ci.variant_id"""),
    *ALLOCATE,
    ("decided", """SELECT cs.cart_id, coalesce(r.val, 1) = 1 AS ok FROM carts cs
LEFT JOIN (SELECT DISTINCT cart_id, step FROM lines) l ON l.cart_id = cs.cart_id
LEFT JOIN r ON r.k = 's' AND r.id = l.step"""),
    ("outcome", """SELECT u.user_id, c.cart_id,
       CASE WHEN c.cart_id IS NULL THEN 'no cart' WHEN dc.cart_id IS NULL THEN 'empty cart'
            WHEN NOT dc.ok THEN 'insufficient stock' END AS reason
FROM shop_users u LEFT JOIN shop_cart c ON c.user_id = u.user_id
LEFT JOIN decided dc ON dc.cart_id = c.cart_id"""),
    ("acc", """SELECT user_id, cart_id, (SELECT max(order_id) FROM shop_orders) + row_number() OVER (ORDER BY cart_id) AS order_id
FROM outcome WHERE reason IS NULL"""),
]


INTAKE_FOLD = [
    STOCKED,
    ("headers", """SELECT o_orderkey AS payload_id, c_name AS name,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
       CAST(o_totalprice AS DECIMAL(12,2)) AS client_total, trim(n_name) AS address, o_orderdate AS order_date,
       CASE o_orderstatus WHEN 'F' THEN 'Bank' WHEN 'P' THEN 'Momo' ELSE 'COD' END AS method
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    ("items", """SELECT l_orderkey AS payload_id, l_linenumber - 1 AS pos, CAST(floor(l_partkey / 4) AS BIGINT) AS product_id,
       CASE WHEN l_linenumber % 2 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size,
       CASE WHEN l_linenumber % 2 = 1 THEN split_part(p_name, ' ', 1) ELSE '' END AS color,
       l_quantity AS quantity, p_retailprice AS price
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    ("vn", """SELECT pv.*, s.name AS size_name, c.name AS color_name
FROM stocked pv JOIN shop_sizes s ON pv.size_id = s.size_id JOIN shop_colors c ON pv.color_id = c.color_id"""),
    ("res", """SELECT i.*, CASE WHEN i.size <> '' AND i.color <> '' THEN e.vid ELSE f.vid END AS variant_id
FROM items i
LEFT JOIN (SELECT product_id, size_name, color_name, min(variant_id) AS vid FROM vn GROUP BY 1, 2, 3) e
       ON e.product_id = i.product_id AND e.size_name = i.size AND e.color_name = i.color
LEFT JOIN (SELECT product_id, min(variant_id) AS vid FROM vn GROUP BY 1) f ON f.product_id = i.product_id"""),
    ("why", """SELECT r.*, v.stock,
       CASE WHEN coalesce(r.product_id, 0) = 0 OR floor(r.quantity) < 1 OR r.price <= 0 THEN 'invalid item'
            WHEN r.variant_id IS NULL OR v.stock IS NULL THEN 'variant not found' END AS w
FROM res r LEFT JOIN stocked v ON v.variant_id = r.variant_id"""),
    ("pre", """SELECT h.payload_id,
       CASE WHEN n.n IS NULL THEN 'invalid payload' WHEN n.w IS NOT NULL THEN n.w
            WHEN n.variants < n.items THEN 'duplicate variant' END AS reason
FROM headers h LEFT JOIN (SELECT payload_id, count(*) AS n, arg_min(w, (pos, w)) FILTER (WHERE w IS NOT NULL) AS w,
                                 count(variant_id) AS items, count(DISTINCT variant_id) AS variants
                          FROM why GROUP BY payload_id) n ON n.payload_id = h.payload_id"""),
    ("steps", """SELECT payload_id, row_number() OVER (ORDER BY payload_id) AS step FROM pre WHERE reason IS NULL"""),
    ("lines", """SELECT s.step, CAST(w.variant_id AS BIGINT) AS variant_id, CAST(sum(CAST(w.quantity AS INT)) AS BIGINT) AS quantity
FROM why w JOIN steps s ON s.payload_id = w.payload_id GROUP BY 1, 2"""),
    *ALLOCATE,
    ("verdict", """SELECT p.payload_id,
       CASE WHEN p.reason IS NOT NULL THEN p.reason WHEN r.val = 0 THEN 'insufficient stock' END AS reason
FROM pre p LEFT JOIN steps s ON s.payload_id = p.payload_id LEFT JOIN r ON r.k = 's' AND r.id = s.step"""),
    ("acc", """SELECT v.payload_id, lower(rtrim(CASE WHEN trim(coalesce(h.email, '')) <> '' THEN trim(h.email)
            ELSE 'guest_' || CAST(v.payload_id AS VARCHAR) || '@guest.local' END)) AS k
FROM verdict v JOIN headers h ON h.payload_id = v.payload_id WHERE v.reason IS NULL"""),
    ("known", "SELECT lower(rtrim(email)) AS k, min(user_id) AS uid FROM shop_users GROUP BY 1"),
    ("fresh", """SELECT k, (SELECT max(user_id) FROM shop_users) + row_number() OVER (ORDER BY first_pid) AS uid
FROM (SELECT k, min(payload_id) AS first_pid FROM acc WHERE k NOT IN (SELECT k FROM known) GROUP BY k) x"""),
    ("placed", """SELECT a.payload_id, (SELECT max(order_id) FROM shop_orders) + row_number() OVER (ORDER BY a.payload_id) AS order_id,
       coalesce(kn.uid, fr.uid) AS user_id, h.order_date, h.client_total, h.method, h.address
FROM acc a JOIN headers h ON h.payload_id = a.payload_id
LEFT JOIN known kn ON kn.k = a.k LEFT JOIN fresh fr ON fr.k = a.k"""),
    ("new_lines", """SELECT p.order_id, w.pos, w.variant_id, CAST(w.quantity AS INT) AS quantity, CAST(w.price AS DECIMAL(10,2)) AS price
FROM why w JOIN placed p ON p.payload_id = w.payload_id"""),
]


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql[len("WITH "):]


def oracle() -> dict[str, str]:
    q = {}
    q["p_bulk_add_to_cart"] = _recursive(with_shop(["cart", "cart_items", "product_variants"], """
SELECT e.seq, e.user_id, e.cart_id, e.variant_id, e.quantity,
       coalesce(e.pre IS NULL AND r.ok, false) AS accepted,
       CASE WHEN e.pre IS NOT NULL THEN e.pre WHEN NOT r.ok THEN 'insufficient stock' END AS reason
FROM ev e LEFT JOIN r ON r.seq = e.seq AND r.rn > 0""", extra=CART_FOLD))
    q["p_bulk_add_to_cart_carts"] = _recursive(with_shop(["cart", "cart_items", "product_variants"], """
SELECT coalesce(h.cart_item_id, (SELECT max(cart_item_id) FROM shop_cart_items)
                + row_number() OVER (PARTITION BY h.cart_item_id IS NULL ORDER BY a.cart_id, a.variant_id)) AS cart_item_id,
       coalesce(h.cart_id, a.cart_id) AS cart_id, coalesce(h.variant_id, a.variant_id) AS variant_id,
       CAST(coalesce(h.quantity, 0) + coalesce(a.q, 0) AS INT) AS quantity
FROM shop_cart_items h FULL JOIN added a ON a.cart_id = h.cart_id AND a.variant_id = h.variant_id""",
        extra=[*CART_FOLD, ("added", """SELECT e.cart_id, e.variant_id, sum(e.quantity) AS q
FROM ev e JOIN r ON r.seq = e.seq AND r.rn > 0 AND r.ok GROUP BY 1, 2""")]))
    shop = ["users", "cart", "cart_items", "product_variants", "orders"]

    def checkout(body: str, *more: str) -> str:
        return _recursive(with_shop([*shop, *more], body, extra=CHECKOUT_FOLD))

    totals = "(SELECT cart_id, CAST(sum(quantity * price) AS DECIMAL(38,2)) AS total FROM lines GROUP BY cart_id)"
    q["p_bulk_checkout"] = checkout(f"""
SELECT o.user_id, o.cart_id, o.reason IS NULL AS accepted, o.reason, a.order_id,
       CASE WHEN o.reason IS NULL THEN t.total END AS total_amount
FROM outcome o LEFT JOIN acc a ON a.cart_id = o.cart_id LEFT JOIN {totals} t ON t.cart_id = o.cart_id""")
    q["p_bulk_checkout_orders"] = checkout(f"""
SELECT order_id, user_id, order_date, status, total_amount FROM shop_orders
UNION ALL SELECT a.order_id, a.user_id, {AS_OF_SQL}, 'Pending', CAST(t.total AS DECIMAL(12,2))
FROM acc a LEFT JOIN {totals} t ON t.cart_id = a.cart_id""")
    q["p_bulk_checkout_lines"] = checkout("""
SELECT order_detail_id, order_id, variant_id, quantity, price FROM shop_order_details
UNION ALL SELECT (SELECT max(order_detail_id) FROM shop_order_details)
                 + row_number() OVER (ORDER BY a.order_id, l.variant_id), a.order_id, l.variant_id, CAST(l.quantity AS INT), l.price
FROM lines l JOIN acc a ON a.cart_id = l.cart_id""", "order_details")
    q["p_bulk_checkout_stock"] = checkout("""
SELECT v.* REPLACE (CAST(v.stock - coalesce(t.q, 0) AS INT) AS stock) FROM stocked v
LEFT JOIN (SELECT l.variant_id, sum(l.quantity) AS q FROM lines l JOIN acc a ON a.cart_id = l.cart_id GROUP BY 1) t
       ON t.variant_id = v.variant_id""")
    q["p_bulk_checkout_carts"] = checkout("""
SELECT * FROM shop_cart_items WHERE cart_id NOT IN (SELECT cart_id FROM acc)""")

    def intake(body: str, *more: str) -> str:
        return _recursive(with_shop(["users", "product_variants", "sizes", "colors", "orders", *more], body,
                                    extra=INTAKE_FOLD))

    q["w_order_intake"] = intake("""
SELECT v.payload_id, v.reason IS NULL AS accepted, v.reason, p.order_id, p.user_id, h.client_total,
       CASE WHEN v.reason IS NULL THEN t.total END AS computed_total
FROM verdict v JOIN headers h ON h.payload_id = v.payload_id LEFT JOIN placed p ON p.payload_id = v.payload_id
LEFT JOIN (SELECT order_id, CAST(sum(quantity * price) AS DECIMAL(38,2)) AS total FROM new_lines GROUP BY order_id) t
       ON t.order_id = p.order_id""")
    q["w_order_intake_orders"] = intake("""
SELECT order_id, user_id, order_date, status, total_amount FROM shop_orders
UNION ALL SELECT order_id, user_id, order_date, 'Pending', client_total FROM placed""")
    q["w_order_intake_lines"] = intake("""
SELECT order_detail_id, order_id, variant_id, quantity, price FROM shop_order_details
UNION ALL SELECT (SELECT max(order_detail_id) FROM shop_order_details)
                 + row_number() OVER (ORDER BY order_id, pos, variant_id, quantity, price), order_id, variant_id, quantity, price
FROM new_lines""", "order_details")
    q["w_order_intake_payments"] = intake("""
SELECT payment_id, order_id, method, status FROM shop_payments
UNION ALL SELECT (SELECT max(payment_id) FROM shop_payments) + row_number() OVER (ORDER BY order_id), order_id, method, 'Pending'
FROM placed""", "payments")
    q["w_order_intake_shipping"] = intake("""
SELECT shipping_id, order_id, address, status FROM shop_shipping
UNION ALL SELECT (SELECT max(shipping_id) FROM shop_shipping) + row_number() OVER (ORDER BY order_id), order_id, address, 'Pending'
FROM placed""", "shipping")
    q["w_order_intake_stock"] = intake("""
SELECT v.* REPLACE (CAST(v.stock - coalesce(t.q, 0) AS INT) AS stock) FROM stocked v
LEFT JOIN (SELECT variant_id, sum(quantity) AS q FROM new_lines GROUP BY 1) t ON t.variant_id = v.variant_id""")
    q["s_cart_merge"] = _recursive(with_shop(["cart", "cart_items", "product_variants"], """
SELECT coalesce(h.cart_id, a.cart_id) AS cart_id, coalesce(h.variant_id, a.variant_id) AS variant_id,
       CAST(coalesce(h.quantity, 0) + coalesce(a.q, 0) AS INT) AS quantity
FROM shop_cart_items h FULL JOIN (
  SELECT e.cart_id, e.variant_id, sum(e.quantity) AS q FROM ev e JOIN r ON r.seq = e.seq AND r.rn > 0 AND r.ok
  GROUP BY 1, 2) a ON a.cart_id = h.cart_id AND a.variant_id = h.variant_id""", extra=CART_FOLD))
    reviews = ["reviews", "orders", "order_details", "product_variants"]
    judged = [("feed", REVIEW_FEED), ("bought", """SELECT DISTINCT o.user_id, v.product_id FROM shop_orders o
JOIN shop_order_details od ON od.order_id = o.order_id JOIN shop_product_variants v ON v.variant_id = od.variant_id
WHERE o.status = 'Completed'"""), ("first_look", """SELECT b.*,
       CASE WHEN coalesce(b.rating, 0) NOT BETWEEN 1 AND 5 THEN 'rating out of range'
            WHEN NOT EXISTS (SELECT 1 FROM bought g WHERE g.user_id = b.user_id AND g.product_id = b.product_id)
            THEN 'no purchase'
            WHEN length(rtrim(b.comment)) < 5 THEN 'comment too short'
            WHEN EXISTS (SELECT 1 FROM shop_reviews r WHERE r.user_id = b.user_id AND r.product_id = b.product_id)
            THEN 'duplicate review' END AS why
FROM feed b"""), ("judged", """SELECT * REPLACE (CASE WHEN why IS NULL AND EXISTS (
         SELECT 1 FROM first_look e WHERE e.why IS NULL AND e.user_id = f.user_id AND e.product_id = f.product_id
                                      AND e.seq < f.seq) THEN 'duplicate review' ELSE why END AS why) FROM first_look f""")]
    q["p_bulk_review_insert"] = with_shop(reviews, """
SELECT seq, user_id, product_id, rating, comment, why IS NULL AS accepted, why AS reason FROM judged""", extra=judged)
    q["p_bulk_review_insert_reviews"] = with_shop(reviews, f"""
SELECT review_id, user_id, product_id, rating, comment, review_date FROM shop_reviews
UNION ALL SELECT (SELECT max(review_id) FROM shop_reviews) + row_number() OVER (ORDER BY seq), user_id, product_id,
       rating, comment, {AS_OF_SQL} FROM judged WHERE why IS NULL""", extra=judged)
    return q
