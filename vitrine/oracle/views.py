"""Oracle SQL (DuckDB) for the views.

Computed from the rules of each output column, not by joining tables row by row:
facts about a product, a variant and an order are looked up one by one (scalar
subqueries and pre-sorted lists), and a view picks the facts it shows. A view whose
row needs a partner to exist says so with EXISTS.
"""

from __future__ import annotations

from . import AS_OF_SQL, with_shop

CENT = "CAST(0.01 AS DECIMAL(3,2))"


def one(table: str, column: str, key: str, value: str) -> str:
    """The only row's column of a key table, NULL where the key is unknown."""
    return f"(SELECT {column} FROM shop_{table} AS look WHERE look.{key} = {value})"


def cheaper(price: str, percent: str) -> str:
    return f"CAST({price} * (100 - {percent}) * {CENT} AS DECIMAL(10,2))"


def or_default(expr: str, default: str) -> str:
    return f"ifnull({expr}, {default})"


#: alias -> SQL over a product id {k}
PRODUCT = {
    "product_name": one("products", "name", "product_id", "{k}"),
    "description": one("products", "description", "product_id", "{k}"),
    "picture": "ifnull((SELECT min_by(image_url, image_id) FROM shop_product_images i "
               "WHERE i.product_id = {k}), '')",
    "brand_name": "(SELECT b.name FROM shop_brands b WHERE b.brand_id = "
                  + one("products", "brand_id", "product_id", "{k}") + ")",
    "category_name": "(SELECT c.name FROM shop_categories c WHERE c.category_id = "
                     + one("products", "category_id", "product_id", "{k}") + ")",
    "percent": "ifnull((SELECT max(s.discount_percent) FROM shop_sales s WHERE s.sale_id IN "
               "(SELECT sale_id FROM shop_product_sales l WHERE l.product_id = {k}) "
               f"AND NOT ({AS_OF_SQL} < s.start_date OR {AS_OF_SQL} > s.end_date)), 0)",
    "stock": "CAST(ifnull((SELECT sum(stock) FROM shop_product_variants v WHERE v.product_id = {k}), 0) AS BIGINT)",
    "variants": "(SELECT count(*) FROM shop_product_variants v WHERE v.product_id = {k})",
    "lowest": "(SELECT min(price) FROM shop_product_variants v WHERE v.product_id = {k})",
    "highest": "(SELECT max(price) FROM shop_product_variants v WHERE v.product_id = {k})",
    "rating": "ifnull((SELECT CAST(((sum(rating) * 200 + count(*)) // (2 * count(*))) * " + CENT
              + " AS DECIMAL(10,2)) FROM shop_reviews r WHERE r.product_id = {k} HAVING count(*) > 0), "
              "CAST(0 AS DECIMAL(10,2)))",
    "reviews": "(SELECT count(*) FROM shop_reviews r WHERE r.product_id = {k})",
}
PRODUCT_TABLES = ["products", "brands", "categories", "product_images", "product_sales", "sales",
                  "product_variants", "reviews"]


def about(fact: str, key: str) -> str:
    return PRODUCT[fact].replace("{k}", key)


def stock_label(amount: str) -> str:
    return f"if({amount} > 0, 'Còn hàng', 'Hết hàng')"


def latest(table: str, column: str) -> str:
    """The column of an order's row with the highest id."""
    return (f"(SELECT x[1].v FROM (SELECT list({{'v': {column}}} ORDER BY {table[:-1] if table[-1] == 's' else table}_id DESC) "
            f"AS x FROM shop_{table} t WHERE t.order_id = o.order_id))")


def order_columns(with_contact: bool) -> str:
    contact = (f"{one('users', 'email', 'user_id', 'o.user_id')} AS email, "
               f"{one('users', 'phone', 'user_id', 'o.user_id')} AS phone,") if with_contact else ""
    return f"""
SELECT order_id, user_id, {one('users', 'name', 'user_id', 'o.user_id')} AS customer_name, {contact}
       order_date, status AS order_status, total_amount,
       {or_default(latest('payments', 'method'), "''")} AS payment_method,
       {or_default(latest('payments', 'status'), "''")} AS payment_status,
       {or_default(latest('shipping', 'address'), one('users', 'address', 'user_id', 'o.user_id'))} AS shipping_address,
       {or_default(latest('shipping', 'status'), "''")} AS shipping_status
FROM shop_orders o WHERE user_id IN (SELECT user_id FROM shop_users)"""


SIZE = one("sizes", "name", "size_id", "v.size_id")
COLOR = one("colors", "name", "color_id", "v.color_id")
HEX = one("colors", "hex_code", "color_id", "v.color_id")
#: Variants whose product, size and colour all exist.
WHOLE = """v.product_id IN (SELECT product_id FROM shop_products)
  AND v.size_id IN (SELECT size_id FROM shop_sizes) AND v.color_id IN (SELECT color_id FROM shop_colors)"""


def oracle() -> dict[str, str]:
    q = {}
    k = "p.product_id"
    q["v_product_summary"] = with_shop(PRODUCT_TABLES, f"""
SELECT product_id, name AS product_name, description,
       {one('brands', 'brand_id', 'brand_id', 'p.brand_id')} AS brand_id, {about('brand_name', k)} AS brand_name,
       {one('categories', 'category_id', 'category_id', 'p.category_id')} AS category_id,
       {about('category_name', k)} AS category_name, {about('picture', k)} AS thumbnail,
       {about('variants', k)} AS total_variants, {about('stock', k)} AS total_stock,
       {about('lowest', k)} AS min_price, {about('highest', k)} AS max_price,
       {about('rating', k)} AS avg_rating, {about('reviews', k)} AS review_count, created_at
FROM shop_products p""")
    q["v_customer_product_list"] = with_shop(PRODUCT_TABLES, f"""
SELECT product_id, product_name, description, brand_name, category_name, thumbnail, total_stock,
       lowest AS original_price_from, {cheaper('lowest', 'discount_percent')} AS final_price_from,
       discount_percent, avg_rating, review_count, {stock_label('total_stock')} AS stock_status
FROM (SELECT product_id, name AS product_name, description, {about('brand_name', k)} AS brand_name,
             {about('category_name', k)} AS category_name, {about('picture', k)} AS thumbnail,
             {about('stock', k)} AS total_stock, {about('lowest', k)} AS lowest,
             {about('percent', k)} AS discount_percent, {about('rating', k)} AS avg_rating,
             {about('reviews', k)} AS review_count
      FROM shop_products p)""")
    q["v_product_stock_status"] = with_shop(PRODUCT_TABLES, f"""
SELECT product_id, product_name, brand_name, category_name, total_variants, total_stock,
       ['Hết hàng', 'Sắp hết hàng', 'Còn hàng'][1 + (total_stock <> 0)::INT
          + (total_stock <> 0 AND total_stock > 5)::INT] AS stock_status
FROM (SELECT product_id, name AS product_name, {about('brand_name', k)} AS brand_name,
             {about('category_name', k)} AS category_name, {about('variants', k)} AS total_variants,
             {about('stock', k)} AS total_stock FROM shop_products p)""")
    q["v_customer_sale_products"] = with_shop(PRODUCT_TABLES, f"""
SELECT product_id, {about('product_name', 'w.product_id')} AS product_name,
       {about('brand_name', 'w.product_id')} AS brand_name, {about('category_name', 'w.product_id')} AS category_name,
       sale_name, discount_percent, start_date, end_date, lowest AS original_price_from,
       {cheaper('lowest', 'discount_percent')} AS final_price_from, {about('picture', 'w.product_id')} AS thumbnail
FROM (SELECT DISTINCT product_id, s.name AS sale_name, discount_percent, start_date, end_date,
             {about('lowest', 'l.product_id')} AS lowest
      FROM shop_product_sales l JOIN shop_sales s USING (sale_id)
      WHERE NOT ({AS_OF_SQL} < start_date OR {AS_OF_SQL} > end_date)) w
WHERE lowest IS NOT NULL AND product_id IN (SELECT product_id FROM shop_products)""")
    k = "v.product_id"
    tables = [*PRODUCT_TABLES, "sizes", "colors"]
    q["v_product_variant_detail"] = with_shop(tables, f"""
SELECT variant_id, product_id, product_name, description, brand_name, category_name, size_name, color_name,
       hex_code, price AS original_price, percent AS discount_percent, {cheaper('price', 'percent')} AS final_price,
       stock, image_url, created_at
FROM (SELECT v.*, {about('product_name', k)} AS product_name, {about('description', k)} AS description,
             {about('brand_name', k)} AS brand_name, {about('category_name', k)} AS category_name,
             {SIZE} AS size_name, {COLOR} AS color_name, {HEX} AS hex_code, {about('percent', k)} AS percent,
             {about('picture', k)} AS image_url
      FROM shop_product_variants v WHERE {WHOLE})""")
    q["v_customer_product_detail"] = with_shop(tables, f"""
SELECT product_id, product_name, description, brand_name, category_name, variant_id, size_name, color_name,
       hex_code, price AS original_price, percent AS discount_percent, {cheaper('price', 'percent')} AS final_price,
       stock, {stock_label('stock')} AS stock_status, image_url, avg_rating, review_count
FROM (SELECT v.*, {about('product_name', k)} AS product_name, {about('description', k)} AS description,
             {about('brand_name', k)} AS brand_name, {about('category_name', k)} AS category_name,
             {SIZE} AS size_name, {COLOR} AS color_name, {HEX} AS hex_code, {about('percent', k)} AS percent,
             {about('picture', k)} AS image_url, {about('rating', k)} AS avg_rating,
             {about('reviews', k)} AS review_count
      FROM shop_product_variants v WHERE {WHOLE})""")
    order_tables = ["orders", "users", "payments", "shipping"]
    q["v_order_summary"] = with_shop(order_tables, order_columns(True))
    q["v_customer_order_tracking"] = with_shop(order_tables, order_columns(False))
    variant = f"""(SELECT variant_id, product_id, {about('product_name', k)} AS product_name, {SIZE} AS size_name,
       {COLOR} AS color_name, {about('picture', k)} AS image_url, price AS list_price,
       {about('percent', k)} AS percent, stock FROM shop_product_variants v WHERE {WHOLE})"""
    q["v_order_item_detail"] = with_shop([*tables, "order_details", "orders", "users"], f"""
SELECT order_detail_id, order_id, order_date, order_status, user_id,
       {one('users', 'name', 'user_id', 'o.user_id')} AS customer_name,
       {one('users', 'email', 'user_id', 'o.user_id')} AS email, product_id, product_name, variant_id, size_name,
       color_name, quantity, price AS unit_price, CAST(quantity * price AS DECIMAL(12,2)) AS line_total, image_url
FROM (SELECT order_id, order_date, status AS order_status, user_id FROM shop_orders
      WHERE user_id IN (SELECT user_id FROM shop_users)) o
JOIN shop_order_details USING (order_id) JOIN {variant} USING (variant_id)""")
    q["v_customer_cart_detail"] = with_shop([*tables, "cart", "users", "cart_items"], f"""
SELECT user_id, {one('users', 'name', 'user_id', 'c.user_id')} AS customer_name, cart_id, cart_item_id, product_id,
       product_name, variant_id, size_name, color_name, image_url, list_price AS original_price,
       percent AS discount_percent, {cheaper('list_price', 'percent')} AS final_price, quantity,
       CAST(quantity * list_price * (100 - percent) * {CENT} AS DECIMAL(12,2)) AS line_total, stock
FROM (SELECT cart_id, user_id FROM shop_cart WHERE user_id IN (SELECT user_id FROM shop_users)) c
JOIN shop_cart_items USING (cart_id) JOIN {variant} USING (variant_id)""")
    q["v_customer_product_reviews"] = with_shop(["reviews", "users", "products"], f"""
SELECT review_id, product_id, {one('products', 'name', 'product_id', 'r.product_id')} AS product_name, user_id,
       {one('users', 'name', 'user_id', 'r.user_id')} AS customer_name, rating, comment, review_date
FROM shop_reviews r
WHERE product_id IN (SELECT product_id FROM shop_products) AND user_id IN (SELECT user_id FROM shop_users)""")
    return q
