"""The shop model laid over the driver's parquet tables (FIXTURES F2).

Each shop table is a fixed projection of the driver tables, expressed with the
DataFrame API so that Catalyst prunes columns and pushes filters into the
parquet scans. Every projection is lazy: an operator that never touches a
table never reads its files.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Shop, schema_of

AS_OF = dt.datetime(1998, 6, 15)

# Fixed values of the driver mapping (FIXTURES F2): category codes by part type
# and the three sales.
CATEGORY_CODES = [("ECONOMY", 1), ("LARGE", 2), ("MEDIUM", 3), ("PROMO", 4), ("SMALL", 5)]
CATEGORY_OTHER = 6
SALES_ROWS = [
    (1, "Sale A", 30, dt.datetime(1998, 1, 1), dt.datetime(1998, 12, 31)),
    (2, "Sale B", 20, dt.datetime(1999, 1, 1), dt.datetime(1999, 12, 31)),
    (3, "Sale C", 10, dt.datetime(1998, 6, 1), dt.datetime(1998, 6, 30)),
]

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _category_code(p_type):
    expr = F.when(p_type == CATEGORY_CODES[0][0], F.lit(CATEGORY_CODES[0][1]))
    for name, code in CATEGORY_CODES[1:]:
        expr = expr.when(p_type == name, F.lit(code))
    return expr.otherwise(F.lit(CATEGORY_OTHER)).cast("int")


def _product_of(partkey):
    return F.floor(partkey / 4).cast("bigint")


def load_shop(spark: SparkSession, sf_dir: str, as_of: dt.datetime = AS_OF) -> Shop:
    part = read_driver(spark, sf_dir, "part")
    customer = read_driver(spark, sf_dir, "customer")
    nation = read_driver(spark, sf_dir, "nation")
    orders_src = read_driver(spark, sf_dir, "orders")
    lineitem = read_driver(spark, sf_dir, "lineitem")
    events = read_driver(spark, sf_dir, "events")

    no_ts = F.lit(None).cast("timestamp_ntz")
    brand_no = F.expr("CAST(substring(p_brand, 7) AS INT)")
    pid = _product_of(F.col("p_partkey"))

    users = (customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
             .select(F.col("c_custkey").alias("user_id"),
                     F.col("c_name").alias("name"),
                     F.concat(F.lit("c"), F.col("c_custkey").cast("string"),
                              F.lit("@example.com")).alias("email"),
                     F.when(F.col("c_custkey") % 7 == 0, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lit("09"), (F.col("c_custkey") + 10000000)
                                          .cast("string"))).alias("phone"),
                     F.col("n_name").alias("address"),
                     F.when(F.col("c_custkey") % 100 == 0, F.lit("admin"))
                      .otherwise(F.lit("user")).alias("role"),
                     no_ts.alias("created_at")))

    brands = part.select(brand_no.alias("brand_id"), F.col("p_brand").alias("name")).distinct()
    categories = part.select(_category_code(F.col("p_type")).alias("category_id"),
                             F.col("p_type").alias("name")).distinct()
    colour_names = part.select(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
                               .alias("name")).distinct()
    # Colour ids number a vocabulary (distinct first words), a small set: the
    # global ordering runs after the distinct, never over part rows.
    colors = colour_names.select(
        F.dense_rank().over(Window.orderBy("name")).cast("int").alias("color_id"),
        "name", F.concat(F.lit("#"), F.col("name")).alias("hex_code"))
    sizes = part.select(F.col("p_size").alias("size_id"),
                        F.col("p_size").cast("string").alias("name")).distinct()

    products = (part.filter(F.col("p_partkey") % 4 == 0)
                .select(pid.alias("product_id"), F.col("p_name").alias("name"),
                        F.concat_ws(" ", "p_name", "p_type").alias("description"),
                        F.when(pid % 17 == 0, F.lit(None).cast("int"))
                         .otherwise(brand_no).alias("brand_id"),
                        F.when(pid % 19 == 0, F.lit(None).cast("int"))
                         .otherwise(_category_code(F.col("p_type"))).alias("category_id"),
                        no_ts.alias("created_at")))

    variants_raw = (part.filter(pid % 23 != 0)
                    .select(F.col("p_partkey").alias("variant_id"), pid.alias("product_id"),
                            F.col("p_size").alias("size_id"),
                            F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("color_name"),
                            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
                            F.when(pid % 5 == 0, F.lit(0))
                             .when(pid % 5 == 1, F.col("p_partkey") % 2)
                             .otherwise((F.col("p_partkey") * 7) % 13).cast("int").alias("stock")))
    product_variants = (variants_raw.join(colors.select(
        F.col("name").alias("color_name"), "color_id"), "color_name")
        .select("variant_id", "product_id", "size_id", "color_id", "price", "stock",
                no_ts.alias("created_at")))

    sales = spark.createDataFrame(SALES_ROWS, schema_of("sales"))

    ps_main = (part.filter(pid % 3 != 2)
               .select(pid.alias("product_id"),
                       F.when(pid % 3 == 0, F.lit(1)).otherwise(F.lit(2)).alias("sale_id"))
               .distinct())
    ps_third = part.filter(pid % 2 == 0).select(pid.alias("product_id"),
                                                F.lit(3).alias("sale_id")).distinct()
    product_sales = ps_main.unionByName(ps_third)

    product_images = (part.filter((F.col("p_partkey") % 4).isin(1, 2) & (pid % 29 != 0))
                      .select((pid * 4 + F.col("p_partkey") % 4).cast("bigint").alias("image_id"),
                              pid.alias("product_id"),
                              F.concat(F.lit("img/"), F.col("p_partkey").cast("string"))
                              .alias("image_url")))

    orders = orders_src.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Completed"))
         .when(F.col("o_orderstatus") == "P", F.lit("Pending"))
         .when(F.col("o_orderkey") % 3 == 0, F.lit("Confirmed"))
         .when(F.col("o_orderkey") % 3 == 1, F.lit("Shipping"))
         .otherwise(F.lit("Cancelled")).alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"))

    # The line number inside an order is a window over one order's lines; the
    # optimizer drops it from any plan that does not read order_detail_id.
    line_no = F.row_number().over(
        Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_quantity", "l_extendedprice", "l_shipdate"))
    order_details = lineitem.select(
        (F.col("l_orderkey") * 1000 + line_no).alias("order_detail_id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("variant_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"))

    keep = F.col("o_orderkey") % 11 != 0
    pay_first = orders_src.filter(keep).select(
        (F.col("o_orderkey") * 2).alias("payment_id"), F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("Bank")).otherwise(F.lit("COD")).alias("method"),
        F.lit("Pending").alias("status"))
    pay_second = orders_src.filter(keep & (F.col("o_orderkey") % 4 == 0)).select(
        (F.col("o_orderkey") * 2 + 1).alias("payment_id"), F.col("o_orderkey").alias("order_id"),
        F.lit("Bank").alias("method"),
        F.when(F.col("o_orderkey") % 8 == 0, F.lit("Paid")).otherwise(F.lit("Failed")).alias("status"))
    payments = pay_first.unionByName(pay_second)

    ship_key = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    shipping = (lineitem.select("l_orderkey", "l_linenumber").distinct()
                .select(ship_key.alias("shipping_id"), F.col("l_orderkey").alias("order_id"),
                        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("string"))
                         .otherwise(F.concat(F.lit("addr "), ship_key.cast("string")))
                         .alias("address"),
                        F.when(F.col("l_linenumber") % 2 == 0, F.lit("Delivered"))
                         .otherwise(F.lit("Preparing")).alias("status")))

    # Scalar subqueries (counts of products and parts) stay inside the plan.
    n_products = part.filter(F.col("p_partkey") % 4 == 0).select(F.count(F.lit(1))).scalar()
    n_parts = part.select(F.count(F.lit(1))).scalar()

    first_ev = F.min("event_id")
    reviews = (events.select("event_id", "user_id", "ts",
                       ((F.col("event_id") * 31) % n_products).alias("product_id"))
               .groupBy("user_id", "product_id")
               .agg(first_ev.alias("review_id"), F.min("ts").alias("review_date"))
               .select("review_id", "user_id", "product_id",
                       (1 + F.col("review_id") % 5).cast("int").alias("rating"),
                       F.when(F.col("review_id") % 9 == 0, F.lit("ok"))
                        .when(F.col("review_id") % 10 == 0, F.lit(None).cast("string"))
                        .otherwise(F.concat(F.lit("review "), F.col("review_id").cast("string")))
                        .alias("comment"),
                       "review_date"))

    cart = events.select(F.col("user_id").alias("cart_id"), "user_id").distinct()
    cart_items = (events.select(F.col("user_id").alias("cart_id"),
                                ((F.col("event_id") * 17) % n_parts).alias("variant_id"),
                                (1 + F.col("event_id") % 3).alias("qty"))
                  .groupBy("cart_id", "variant_id")
                  .agg(F.sum("qty").cast("int").alias("quantity"))
                  .select((F.col("cart_id") * n_parts + F.col("variant_id")).alias("cart_item_id"),
                          "cart_id", "variant_id", "quantity"))

    return Shop(spark=spark, users=users, brands=brands, categories=categories,
                colors=colors, sizes=sizes, products=products,
                product_variants=product_variants, sales=sales,
                product_sales=product_sales, product_images=product_images, cart=cart,
                cart_items=cart_items, orders=orders, order_details=order_details,
                payments=payments, shipping=shipping, reviews=reviews, as_of=as_of,
                source=sf_dir)
