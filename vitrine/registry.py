"""Registered queries: name -> operator call on the shop over the driver tables.

Parameters are those of the driver run (FIXTURES F2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Shop
from .operators import reports as R
from .operators import audits as A
from .operators import changes as C
from .operators import checkout as K
from .operators import documents as D
from .operators import history as H
from .operators import lists as L
from .operators import views as V
from .sources.driver import load_shop

_SHOPS: dict = {}


def shop_for(spark: SparkSession, sf_dir: str) -> Shop:
    key = (spark.sparkContext.applicationId, spark, sf_dir.rstrip("/"))
    if key not in _SHOPS:
        _SHOPS[key] = load_shop(spark, sf_dir)
    return _SHOPS[key]


def _q(fn: Callable[[Shop], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    from .plans.encode import encode_nested

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Nested columns are registered in a canonical text form (see
        # plans.encode); the operators themselves return the nested documents.
        return encode_nested(fn(shop_for(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _operators() -> dict[str, Callable[[Shop], DataFrame]]:
    ops: dict[str, Callable[[Shop], DataFrame]] = {
        "q01_users": R.q01_users,
        "q02_products": R.q02_products,
        "q03_brands": R.q03_brands,
        "q04_products_in_category": lambda s: R.q04_products_in_category(s, 1),
        "q05_count_users": R.q05_count_users,
        "q06_price_above": lambda s: R.q06_price_above(s, 950),
        "q07_newest_products": R.q07_newest_products,
        "q08_product_brand_category": R.q08_product_brand_category,
        "q09_variant_list": R.q09_variant_list,
        "q10_products_per_category": R.q10_products_per_category,
        "q11_name_search": lambda s: R.q11_name_search(s, "ring"),
        "q12_orders_per_user": R.q12_orders_per_user,
        "q13_order_list": R.q13_order_list,
        "q14_completed_revenue": R.q14_completed_revenue,
        "q15_customer_rank": R.q15_customer_rank,
        "q16_best_seller_per_category": R.q16_best_seller_per_category,
        "q17_units_per_product": R.q17_units_per_product,
        "q18_monthly_revenue_lag": R.q18_monthly_revenue_lag,
        "q19_variant_count_rank": R.q19_variant_count_rank,
        "q20_price_and_sale_status": R.q20_price_and_sale_status,
        "p_all_products": R.p_all_products,
        "p_search_products": lambda s: R.p_search_products(s, "ring"),
        "p_orders_by_user": R.p_orders_by_user,
        "p_order_lines": R.p_order_lines,
        "p_top_selling_products": R.p_top_selling_products,
        "p_revenue_by_date": R.p_revenue_by_date,
    }
    for name in ("v_product_summary", "v_product_variant_detail", "v_order_summary",
                 "v_order_item_detail", "v_product_stock_status", "v_customer_product_list",
                 "v_customer_product_detail", "v_customer_sale_products",
                 "v_customer_cart_detail", "v_customer_order_tracking",
                 "v_customer_product_reviews"):
        ops[name] = getattr(V, name)
    ops.update(_document_ops())
    ops.update(_audit_ops())
    ops.update(_change_ops())
    ops.update(_bulk_ops())
    ops.update(_stream_ops())
    ops.update(_write_ops())
    ops.update(_source_ops())
    ops.update(_shared_ops())
    ops.update(_star_ops())
    ops.update({"price_at_order": H.price_at_order, "sale_results": H.sale_results})
    ops.update(_search_ops())
    return ops


def _search_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from .operators import search as SE
    return {
        "keyword_matches": lambda s: SE.keyword_matches(s, SE.driver_keywords(s)),
        "keyword_report": lambda s: SE.keyword_report(s, SE.driver_keywords(s)),
    }


_STARS: dict = {}


def star_for(shop: Shop):
    """The bucketed snapshot of a shop, each table written once for a session."""
    from .plans import bucketed
    key = (shop.spark.sparkContext.applicationId, shop.spark, shop.source)
    if key not in _STARS:
        least = max(8, int(shop.spark.conf.get("spark.sql.shuffle.partitions")))
        _STARS[key] = bucketed.build(shop, bucketed.buckets_for(shop, least))
    return _STARS[key]


def _star_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from .operators import star as ST
    return {
        "star_order_lines": lambda s: ST.star_order_lines(star_for(s)),
        "star_order_item_detail": lambda s: ST.star_order_item_detail(star_for(s)),
        "star_units_per_product": lambda s: ST.star_units_per_product(star_for(s)),
    }


def _shared_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from pyspark.sql import functions as F
    from .functions import labels as LB
    from .operators import shared as SH

    def status_maps(s: Shop) -> DataFrame:
        rows = s.payments.select("payment_id", "order_id", F.col("method"),
                                 F.col("status").alias("pay_status")).join(
            s.orders.select("order_id", "status"), "order_id")
        return rows.select(
            "payment_id", "order_id",
            LB.norm_order_status(F.col("status")).alias("norm_order_status"),
            LB.norm_payment_status(F.col("pay_status")).alias("norm_payment_status"),
            LB.norm_payment_method(F.col("method")).alias("norm_payment_method"),
            LB.db_order_status(F.col("status")).alias("db_order_status"),
            LB.db_payment_status(F.col("pay_status")).alias("db_payment_status"),
            LB.db_payment_method(F.col("method")).alias("db_payment_method"),
            LB.map_payment_method(F.col("method")).alias("intake_payment_method"))

    return {
        "agg_variant_rollup": SH.agg_variant_rollup,
        "agg_review_rollup": SH.agg_review_rollup,
        "agg_active_discount": SH.agg_active_discount,
        "top1_first_image": SH.top1_first_image,
        "top1_latest_payment": SH.top1_latest_payment,
        "top1_latest_shipping": SH.top1_latest_shipping,
        "top1_best_discount": SH.agg_active_discount,
        "op_size_guide": L.op_size_guide,
        "status_maps": status_maps,
    }


def _source_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from functools import reduce

    from pyspark.sql import functions as F
    from .model import TABLES
    from .sources import payloads as P
    from .sources import tables as TB
    from .streaming.feeds import scratch

    def src_tables(s: Shop) -> DataFrame:
        path = scratch(s.spark, "tables")
        TB.write_shop_tables(s, path)
        stored = TB.read_shop_tables(s.spark, path)
        parts = [getattr(stored, t).agg(F.count(F.lit(1)).alias("n_rows"))
                 .select(F.lit(t).alias("tbl"), "n_rows") for t in TABLES]
        return reduce(DataFrame.unionByName, parts)

    def snk_documents(s: Shop) -> DataFrame:
        doc = D.api_product_document(s)
        path = scratch(s.spark, "documents") + "/products"
        TB.write_documents(doc, path, "json")
        return TB.read_documents(s.spark, path, doc.schema, "json")

    def src_order_payloads(s: Shop) -> DataFrame:
        path = scratch(s.spark, "payloads")
        P.driver_payload_documents(s.spark, s.source).write.json(path)
        headers, items = P.explode_order_payloads(P.read_order_payloads(s.spark, path))
        n = items.groupBy("payload_id").agg(F.count(F.lit(1)).alias("n_items"))
        return (headers.join(n, "payload_id", "left")
                .select("payload_id", "name", "email", "phone", "address",
                        F.coalesce("n_items", F.lit(0)).alias("n_items")))

    return {"src_tables": src_tables, "snk_documents": snk_documents,
            "src_order_payloads": src_order_payloads}


def _write_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from pyspark.sql import functions as F
    from .operators import deletes as DL
    from .operators import writes as W
    from .sources import payloads as P

    def intake(s: Shop):
        return P.driver_order_payloads(s.spark, s.source)

    def dims(s: Shop) -> DataFrame:
        feed = P.driver_product_payloads(s.spark, s.source)
        parts = []
        for kind, table, id_col, names in (
                ("brand", s.brands, "brand_id", feed.select(F.col("brand").alias("name"), "seq")),
                ("category", s.categories, "category_id",
                 feed.select(F.col("category").alias("name"), "seq")),
                ("size", s.sizes, "size_id", feed.select(
                    F.explode(F.split("sizes", ",")).alias("name"), "seq")),
                ("color", s.colors, "color_id", feed.select(F.lit("Default").alias("name"), "seq"))):
            new = W.w_dimension_get_or_create(names, table, id_col)["new"]
            parts.append(new.select(F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"),
                                    "name"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def intake_table(table: str):
        return lambda s: W.w_order_intake(restocked(s), *intake(s), want=(table,))[table]

    def upsert_table(table: str):
        return lambda s: W.w_product_upsert(
            s, P.driver_product_payloads(s.spark, s.source))[table]

    def delete_table(table: str):
        return lambda s: DL.w_product_delete(
            unsold(s), P.driver_product_deletes(s.spark, s.source))[table]

    def status_table(table: str):
        return lambda s: W.w_order_status_update(
            s, P.driver_order_status_updates(s.spark, s.source))[table]

    return {
        "w_order_intake": intake_table("outcome"),
        "w_order_intake_orders": intake_table("orders"),
        "w_order_intake_lines": intake_table("order_details"),
        "w_order_intake_payments": intake_table("payments"),
        "w_order_intake_shipping": intake_table("shipping"),
        "w_order_intake_stock": intake_table("product_variants"),
        "w_variant_resolve": lambda s: W.w_variant_resolve(s, intake(s)[1]).select(
            "payload_id", "pos", "product_id", "variant_id"),
        "w_customer_upsert": lambda s: W.w_customer_upsert(s, intake(s)[0])["users"],
        "w_assign_keys": lambda s: W.w_assign_keys(intake(s)[0].select("payload_id"), s.orders,
                                                   "order_id", [F.col("payload_id").asc()]),
        "w_dimension_get_or_create": dims,
        "w_product_upsert": upsert_table("outcome"),
        "w_product_upsert_products": upsert_table("products"),
        "w_product_upsert_variants": upsert_table("product_variants"),
        "w_user_update": lambda s: W.w_user_update(
            s, P.driver_user_updates(s.spark, s.source))["outcome"],
        "w_user_update_users": lambda s: W.w_user_update(
            s, P.driver_user_updates(s.spark, s.source))["users"],
        "w_product_delete": delete_table("outcome"),
        "w_product_delete_products": delete_table("products"),
        "w_product_delete_variants": delete_table("product_variants"),
        "w_product_delete_sales": delete_table("product_sales"),
        "w_product_delete_images": delete_table("product_images"),
        "w_product_delete_reviews": delete_table("reviews"),
        "w_product_delete_carts": delete_table("cart_items"),
        "w_product_delete_lines": delete_table("order_details"),
        "w_order_status_update": status_table("outcome"),
        "w_order_status_update_orders": status_table("orders"),
        "w_order_status_update_payments": status_table("payments"),
    }


def _stream_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from .streaming import feeds as S
    from .streaming import rollups as RU

    def cart(s: Shop) -> DataFrame:
        feed = _request_feed(s).select("seq", "user_id", "variant_id", "quantity")
        return S.s_cart_merge(s, S.cart_feed_steps(feed))

    return {
        "s_order_totals": S.s_order_totals,
        "s_stock_ledger": S.s_stock_ledger,
        "s_cancel_restores": S.s_cancel_restores,
        "s_cart_merge": cart,
        "s_variant_rollup": RU.s_variant_rollup,
        "s_review_rollup": RU.s_review_rollup,
    }


def restocked(shop: Shop) -> Shop:
    """The shop after a delivery of 100 of every variant but each twentieth, so
    that checkout and intake accept some requests and refuse others."""
    from pyspark.sql import functions as F
    more = F.when(F.col("variant_id") % 20 == 0, F.lit(0)).otherwise(F.lit(100))
    return shop.with_tables(product_variants=shop.product_variants.withColumn(
        "stock", (F.col("stock") + more).cast("int")))


def unsold(shop: Shop) -> Shop:
    """The shop before the first sale of every third product, so that some products may
    be deleted with their variants."""
    from pyspark.sql import functions as F
    product = F.floor(F.col("variant_id") / 4)
    return shop.with_tables(order_details=shop.order_details.filter(product % 3 != 0))


def _request_feed(shop: Shop) -> DataFrame:
    from pyspark.sql import functions as F
    from .sources.driver import read_driver
    part = read_driver(shop.spark, shop.source, "part")
    n_parts = part.select(F.count(F.lit(1))).scalar()
    n_products = part.filter(F.col("p_partkey") % 4 == 0).select(F.count(F.lit(1))).scalar()
    return K.shop_requests(read_driver(shop.spark, shop.source, "events"), n_parts, n_products)


def _bulk_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    def checkout_table(table: str):
        return lambda s: K.p_bulk_checkout(restocked(s), s.users)[table]

    return {
        "p_bulk_checkout": checkout_table("outcome"),
        "p_bulk_checkout_orders": checkout_table("orders"),
        "p_bulk_checkout_lines": checkout_table("order_details"),
        "p_bulk_checkout_stock": checkout_table("product_variants"),
        "p_bulk_checkout_carts": checkout_table("cart_items"),
        "p_bulk_add_to_cart_carts": lambda s: K.p_bulk_add_to_cart(s, _request_feed(s))["cart_items"],
        "p_bulk_review_insert_reviews": lambda s: K.p_bulk_review_insert(
            s, _request_feed(s))["reviews"],
        "p_bulk_add_to_cart": lambda s: K.p_bulk_add_to_cart(s, _request_feed(s))["outcome"],
        "p_bulk_review_insert": lambda s: K.p_bulk_review_insert(s, _request_feed(s))["outcome"],
    }


def _change_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    def b(s: Shop) -> dict:
        return C.demo_batches(s)

    return {
        "t_stock_check": lambda s: C.t_stock_check(s.order_details, s.product_variants),
        "t_stock_delta": lambda s: C.t_stock_delta(s.product_variants, b(s)["inserted"],
                                                   b(s)["deleted"]),
        "affected_orders": lambda s: C.affected_orders(b(s)["inserted"], b(s)["deleted"]),
        "t_order_total_recompute": lambda s: C.t_order_total_recompute(
            b(s)["lines_after"], b(s)["inserted"], b(s)["deleted"]),
        "t_cancel_restores_stock": lambda s: C.t_cancel_restores_stock(
            s.orders, b(s)["after"], s.order_details, s.product_variants),
        "t_sold_product_delete_guard": lambda s: C.t_sold_product_delete_guard(
            s.products, s.product_variants, s.order_details),
        "t_review_purchase_check": lambda s: C.t_review_purchase_check(
            s.reviews, s.orders, s.order_details, s.product_variants),
        "t_missing_carts": lambda s: C.t_missing_carts(s.users, s.cart),
    }


def _audit_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from pyspark.sql import functions as F

    def cascade(s: Shop) -> DataFrame:
        return A.c_delete_cascade(s, {
            "products": s.products.filter(F.col("category_id").isNull()),
            "brands": s.brands.filter(F.col("brand_id") == 1)})

    def with_faults(s: Shop) -> Shop:
        """Missing and over-long values, which the driver tables do not have."""
        users = (s.users
                 .withColumn("phone", F.when(F.col("user_id") % 13 == 0, F.concat("phone", "phone"))
                             .otherwise(F.col("phone")))
                 .withColumn("role", F.when(F.col("user_id") % 17 != 0, F.col("role"))))
        reviews = (s.reviews
                   .withColumn("comment", F.when(F.col("review_id") % 19 == 0, F.repeat(F.lit("x"), 501))
                               .otherwise(F.col("comment")))
                   .withColumn("rating", F.when(F.col("review_id") % 23 != 0, F.col("rating"))))
        lines = (s.order_details
                 .withColumn("price", F.when(F.col("order_id") % 31 != 0, F.col("price")))
                 .withColumn("quantity", F.when(F.col("order_id") % 37 != 0, F.col("quantity"))))
        return s.with_tables(users=users, reviews=reviews, order_details=lines)

    ops = {name: getattr(A, name) for name in (
        "c_unique", "c_domain", "c_range", "c_foreign_keys", "c_price_snapshot_drift")}
    ops["c_not_null"] = lambda s: A.c_not_null(with_faults(s))
    ops["c_length"] = lambda s: A.c_length(with_faults(s))
    ops["c_delete_cascade"] = cascade
    return ops


# Category-group patterns of the driver run (FIXTURES F2).
DRIVER_GROUPS = [("bolt", ["bolt"]), ("ring", ["ring"]), ("plate", ["plate"])]


def _driver_events(shop: Shop):
    from pyspark.sql import functions as F
    from .sources.driver import read_driver
    part = read_driver(shop.spark, shop.source, "part")
    n_parts = part.select(F.count(F.lit(1))).scalar()
    return L.cart_events(read_driver(shop.spark, shop.source, "events"), n_parts)


def _document_ops() -> dict[str, Callable[[Shop], DataFrame]]:
    from pyspark.sql import functions as F
    from .functions import labels
    g = DRIVER_GROUPS
    return {
        "api_product_search": lambda s: D.api_product_search(s, "ring"),
        "api_product_document": D.api_product_document,
        "admin_product_list": D.admin_product_list,
        "admin_order_list": D.admin_order_list,
        "api_order_list": D.api_order_list,
        "admin_user_search": lambda s: D.admin_user_search(s, "c10"),
        "admin_user_filter": lambda s: L.admin_user_filter(D.admin_user_search(s, None), "admin"),
        "shop_filter": lambda s: L.shop_filter(D.api_product_search(s, ""), min_price=900,
                                               max_price=990, sort="asc", groups=g),
        "sort_price": lambda s: L.sort_price(D.api_product_search(s, ""), "asc"),
        "facet_brands": lambda s: L.facet_brands(D.api_product_search(s, "")),
        "home_popular": lambda s: L.home_popular(D.api_product_search(s, "")),
        "admin_product_filter": lambda s: L.admin_product_filter(D.admin_product_list(s), "ring",
                                                                 "ring", groups=g),
        "admin_order_filter": lambda s: L.admin_order_filter(
            D.admin_order_list(s), "bank", "paymentMethod", (), ("completed", "shipping")),
        "admin_counts_by_group": lambda s: L.admin_counts_by_group(
            D.admin_product_list(s), D.admin_user_search(s, None), groups=g),
        "category_group": lambda s: D.api_product_search(s, "").select(
            "product_id", "category",
            labels.category_group(F.col("category"), g).alias("category_group")),
        "product_group": lambda s: D.admin_product_list(s).select(
            "product_id", "name", "category",
            labels.product_group(F.col("category"), F.col("name"), g).alias("product_group")),
        "is_shoe": lambda s: D.api_product_search(s, "").select(
            "product_id", labels.is_shoe(F.col("category"), F.col("name"), F.col("brand"))
            .alias("is_shoe")),
        "distinct_sizes": D.distinct_sizes,
        "distinct_colors": D.distinct_colors,
        "sort_sizes": L.product_sizes_sorted,
        "size_color_availability": L.size_color_availability,
        "colors_by_size": L.colors_by_size,
        "cart_totals": L.cart_totals,
        "cart_merge": lambda s: L.cart_merge(_driver_events(s)),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in _operators().items()}


def oracle_sql() -> dict[str, str]:
    from .oracle.reports import oracle as reports_oracle
    sql: dict[str, str] = {}
    from .oracle.views import oracle as views_oracle
    sql.update(reports_oracle())
    sql.update(views_oracle())
    from .oracle.documents import oracle as documents_oracle
    sql.update(documents_oracle())
    from .oracle.audits import oracle as audits_oracle
    sql.update(audits_oracle())
    from .oracle.changes import oracle as changes_oracle
    sql.update(changes_oracle())
    from .oracle.bulk import oracle as bulk_oracle
    sql.update(bulk_oracle())
    from .oracle.streams import oracle as streams_oracle
    sql.update(streams_oracle())
    from .oracle.writes import oracle as writes_oracle
    sql.update(writes_oracle())
    from .oracle.sources import oracle as sources_oracle
    sql.update(sources_oracle())
    from .oracle.shared import oracle as shared_oracle
    sql.update(shared_oracle())
    from .oracle.history import oracle as history_oracle
    sql.update(history_oracle())
    from .oracle.search import oracle as search_oracle
    sql.update(search_oracle())
    for star, plain in (("star_order_lines", "p_order_lines"),
                        ("star_order_item_detail", "v_order_item_detail"),
                        ("star_units_per_product", "q17_units_per_product")):
        sql[star] = sql[plain]
    known = set(_operators())
    return {k: _encode_sql(k, v) for k, v in sql.items() if k in known}


# Nested output columns per query: name -> list of (column, kind, fields).
NESTED = {
    "api_product_document": [("images", "array", None), ("sizes", "array", None),
                             ("colors", "struct_array", ["name", "hex"]),
                             ("variants", "struct_array",
                              ["variantId", "size", "color", "hex", "price", "stock"])],
    "api_order_list": [("customer", "struct", ["name", "email", "phone"])],
    "admin_product_list": [("sizes", "array", None)],
    "admin_product_filter": [("sizes", "array", None)],
    "distinct_sizes": [("sizes", "array", None)],
    "distinct_colors": [("colors", "struct_array", ["name", "hex"])],
    "sort_sizes": [("sizes", "array", None)],
    "size_color_availability": [("sizes", "array", None)],
    "colors_by_size": [("colors", "struct_array", ["name", "hex"])],
}
NESTED["snk_documents"] = NESTED["api_product_document"]


def _encode_sql(name: str, sql: str) -> str:
    from .plans.encode import sql_array, sql_struct, sql_struct_array
    spec = NESTED.get(name)
    if not spec:
        return sql
    cols = ", ".join(c for c, _, _ in spec)
    enc = []
    for col, kind, fields in spec:
        enc.append(sql_array(col) if kind == "array" else
                   sql_struct_array(col, fields) if kind == "struct_array" else
                   sql_struct(col, fields))
    return f"SELECT * EXCLUDE ({cols}), {', '.join(enc)} FROM (\n{sql}\n) nested_q"
