"""Order and product payloads (the API's JSON documents) as DataFrames.

``read_order_payloads`` reads JSON documents with an explicit schema (no
inference); ``explode_order_payloads`` turns them into a header table and an
item table (``posexplode``), the shape every write job consumes. The driver
run derives the same two tables from its own orders, line items, customers and
parts, so the feed grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .driver import read_driver

ORDER_PAYLOAD = T.StructType([
    T.StructField("payload_id", T.LongType()),
    T.StructField("customer", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("email", T.StringType()),
        T.StructField("phone", T.StringType()), T.StructField("address", T.StringType())])),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("productId", T.StringType()), T.StructField("size", T.StringType()),
        T.StructField("color", T.StringType()), T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType())]))),
    T.StructField("totalAmount", T.DoubleType()),
    T.StructField("paymentMethod", T.StringType()),
    T.StructField("orderDate", T.TimestampType()),
])


def read_order_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDER_PAYLOAD).json(path)


def explode_order_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    headers = payloads.select(
        "payload_id", F.col("customer.name").alias("name"), F.col("customer.email").alias("email"),
        F.col("customer.phone").alias("phone"), F.col("customer.address").alias("address"),
        F.col("customer").isNotNull().alias("has_customer"),
        F.col("totalAmount").alias("total_amount"), F.col("paymentMethod").alias("payment_method"),
        F.col("orderDate").alias("order_date"))
    items = payloads.select("payload_id", F.posexplode("items").alias("pos", "it")).select(
        "payload_id", "pos", F.col("it.productId").alias("product_id_text"),
        F.col("it.size").alias("size"), F.col("it.color").alias("color"),
        F.col("it.quantity").alias("quantity"), F.col("it.price").alias("price"))
    return headers, items


def driver_order_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every driver order re-submitted through the order intake.

    The customer carries the shop user's e-mail, except household customers,
    who check out as guests (blank e-mail); items name a product with size and
    colour on odd line numbers and leave them blank on even ones (so the
    intake falls back to the product's first variant); the client price is
    the part's list price.
    """
    orders = read_driver(spark, sf_dir, "orders")
    customer = read_driver(spark, sf_dir, "customer")
    nation = read_driver(spark, sf_dir, "nation")
    lineitem = read_driver(spark, sf_dir, "lineitem")
    part = read_driver(spark, sf_dir, "part")
    guest = F.col("c_mktsegment") == "HOUSEHOLD"
    headers = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
               .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
               .select(F.col("o_orderkey").alias("payload_id"), F.col("c_name").alias("name"),
                       F.when(guest, F.lit("")).otherwise(
                           F.concat(F.lit("c"), F.col("c_custkey").cast("string"),
                                    F.lit("@example.com"))).alias("email"),
                       F.concat(F.lit(" 08"), F.col("c_custkey").cast("string")).alias("phone"),
                       F.col("n_name").alias("address"), F.lit(True).alias("has_customer"),
                       F.col("o_totalprice").alias("total_amount"),
                       F.when(F.col("o_orderstatus") == "F", F.lit("banking"))
                        .when(F.col("o_orderstatus") == "P", F.lit("momo"))
                        .otherwise(F.lit("cod")).alias("payment_method"),
                       F.col("o_orderdate").cast("timestamp").alias("order_date")))
    odd = F.col("l_linenumber") % 2 == 1
    items = (lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey",
                           "left_semi")
             .join(part, F.col("l_partkey") == F.col("p_partkey"))
             .select(F.col("l_orderkey").alias("payload_id"),
                     (F.col("l_linenumber") - 1).alias("pos"),
                     F.floor(F.col("l_partkey") / 4).cast("string").alias("product_id_text"),
                     F.when(odd, F.col("p_size").cast("string")).otherwise(F.lit("")).alias("size"),
                     F.when(odd, F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)))
                      .otherwise(F.lit("")).alias("color"),
                     F.col("l_quantity").alias("quantity"),
                     F.col("p_retailprice").alias("price")))
    return headers, items


def driver_payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same payloads as the JSON documents a client sends. An order's items
    are one array, bounded by the lines of an order."""
    headers, items = driver_order_payloads(spark, sf_dir)
    item = F.struct("pos", F.col("product_id_text").alias("productId"), "size", "color",
                    F.col("quantity").cast("double").alias("quantity"),
                    F.col("price").cast("double").alias("price"))
    lists = items.groupBy("payload_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return headers.join(lists, "payload_id", "left").select(
        "payload_id", F.struct("name", "email", "phone", "address").alias("customer"),
        F.transform("_items", lambda x: x.dropFields("pos")).alias("items"),
        F.col("total_amount").alias("totalAmount"), F.col("payment_method").alias("paymentMethod"),
        F.col("order_date").alias("orderDate"))


def driver_product_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part re-submitted from the admin product form: parts of size
    above 25 replace their product, the others create a new one."""
    part = read_driver(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") > 25, F.floor(F.col("p_partkey") / 4).cast("long")).alias("product_id"),
        F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_name").alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("img/new/"), F.col("p_partkey").cast("string")).alias("image"),
        F.col("p_size").alias("stock"),
        F.concat_ws(", ", F.col("p_size").cast("string"), F.lit(" "),
                    (F.col("p_size") % 7 + 40).cast("string")).alias("sizes"))


def driver_user_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin edits of every customer: names upper-cased, some e-mails taken
    from other users, a role that does not exist for machinery customers. Then customers
    in debt move to a new address, and after that wealthy ones, the last first, ask for the
    address of the customer behind them, who may have given it up."""
    c = read_driver(spark, sf_dir, "customer")
    nation = read_driver(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    edits = F.array(
        F.struct(key.alias("seq"), F.concat(
            F.lit("c"), F.when(F.col("c_acctbal") < -800, key % 50 + 1).otherwise(key).cast("string"))
            .alias("box")),
        F.when(F.col("c_acctbal") < 0, F.struct(
            (1_000_000_000_000 + key).alias("seq"), F.concat(F.lit("n"), key.cast("string")).alias("box"))),
        F.when(F.col("c_acctbal") > 5000, F.struct(
            (3_000_000_000_000 - key).alias("seq"),
            F.concat(F.lit("C"), (key + 1).cast("string")).alias("box"))))
    return (c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("*", F.explode(F.filter(edits, lambda e: e.isNotNull())).alias("e"))
            .select(F.col("e.seq").alias("seq"), key.alias("user_id"),
                    F.upper(F.col("c_name")).alias("name"),
                    F.concat(F.col("e.box"), F.lit("@example.com")).alias("email"),
                    F.lit("").alias("phone"), F.col("n_name").alias("address"),
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit("admin"))
                     .when(F.col("c_mktsegment") == "MACHINERY", F.lit("manager"))
                     .otherwise(F.lit("user")).alias("role")))


def driver_product_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete request per part: its product (so each product is asked for four
    times), an unknown one for parts of size over 40, and none for size 1."""
    part = read_driver(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") > 40, -F.col("p_partkey") - 1)
         .when(F.col("p_size") > 1, F.floor(F.col("p_partkey") / 4).cast("long")).alias("product_id"))


def driver_order_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin edits of every order: finished orders become completed and paid, the
    others shipping with a pending bank payment. Urgent orders are edited in
    their status alone, medium ones in their payment alone; every seventh edit
    names an order that does not exist."""
    o = read_driver(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    key = F.col("o_orderkey")
    return o.select(
        key.alias("seq"), F.when(key % 7 == 0, -key - 1).otherwise(key).alias("order_id"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM",
               F.when(done, F.lit("Completed")).otherwise(F.lit("shipping"))).alias("order_status"),
        F.when(F.col("o_orderpriority") != "1-URGENT",
               F.when(done, F.lit("PAID")).otherwise(F.lit("unknown"))).alias("payment_status"),
        F.lit("banking").alias("payment_method"))
