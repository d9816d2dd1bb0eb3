"""The shop data model: 17 tables as DataFrames plus the evaluation time.

Every operator is ``op(shop, **params) -> DataFrame``. ``as_of`` replaces the
server clock (``GETDATE()``) so that results are reproducible.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "users", "brands", "categories", "colors", "sizes", "products",
    "product_variants", "sales", "product_sales", "product_images", "cart",
    "cart_items", "orders", "order_details", "payments", "shipping", "reviews",
)

# Spark schemas of the shop tables (nullability as in the DDL).
SCHEMAS = {
    "users": "user_id BIGINT NOT NULL, name STRING NOT NULL, email STRING NOT NULL, "
             "phone STRING, address STRING, role STRING NOT NULL, created_at TIMESTAMP",
    "brands": "brand_id INT NOT NULL, name STRING NOT NULL",
    "categories": "category_id INT NOT NULL, name STRING NOT NULL",
    "colors": "color_id INT NOT NULL, name STRING NOT NULL, hex_code STRING",
    "sizes": "size_id INT NOT NULL, name STRING NOT NULL",
    "products": "product_id BIGINT NOT NULL, name STRING NOT NULL, description STRING, "
                "brand_id INT, category_id INT, created_at TIMESTAMP",
    "product_variants": "variant_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
                        "size_id INT NOT NULL, color_id INT NOT NULL, "
                        "price DECIMAL(10,2) NOT NULL, stock INT NOT NULL, created_at TIMESTAMP",
    "sales": "sale_id INT NOT NULL, name STRING, discount_percent INT NOT NULL, "
             "start_date TIMESTAMP NOT NULL, end_date TIMESTAMP NOT NULL",
    "product_sales": "product_id BIGINT NOT NULL, sale_id INT NOT NULL",
    "product_images": "image_id BIGINT NOT NULL, product_id BIGINT NOT NULL, image_url STRING NOT NULL",
    "cart": "cart_id BIGINT NOT NULL, user_id BIGINT NOT NULL",
    "cart_items": "cart_item_id BIGINT NOT NULL, cart_id BIGINT NOT NULL, "
                  "variant_id BIGINT NOT NULL, quantity INT NOT NULL",
    "orders": "order_id BIGINT NOT NULL, user_id BIGINT NOT NULL, order_date TIMESTAMP, "
              "status STRING, total_amount DECIMAL(12,2)",
    "order_details": "order_detail_id BIGINT NOT NULL, order_id BIGINT NOT NULL, "
                     "variant_id BIGINT NOT NULL, quantity INT NOT NULL, price DECIMAL(10,2) NOT NULL",
    "payments": "payment_id BIGINT NOT NULL, order_id BIGINT NOT NULL, method STRING, status STRING",
    "shipping": "shipping_id BIGINT NOT NULL, order_id BIGINT NOT NULL, address STRING, status STRING",
    "reviews": "review_id BIGINT NOT NULL, user_id BIGINT NOT NULL, product_id BIGINT NOT NULL, "
               "rating INT NOT NULL, comment STRING, review_date TIMESTAMP",
}


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])  # noqa: SLF001 - public DDL parser


@dataclass
class Shop:
    spark: SparkSession
    users: DataFrame
    brands: DataFrame
    categories: DataFrame
    colors: DataFrame
    sizes: DataFrame
    products: DataFrame
    product_variants: DataFrame
    sales: DataFrame
    product_sales: DataFrame
    product_images: DataFrame
    cart: DataFrame
    cart_items: DataFrame
    orders: DataFrame
    order_details: DataFrame
    payments: DataFrame
    shipping: DataFrame
    reviews: DataFrame
    as_of: dt.datetime = dt.datetime(1998, 6, 15)
    source: str | None = None

    def with_tables(self, **tables: DataFrame) -> "Shop":
        """A new snapshot with some tables replaced (write path output)."""
        return replace(self, **tables)
