"""Shop tables as files: read with explicit schemas, write new snapshots,
load literal seed rows, and write nested documents.

No schema is inferred: every read names its StructType, so a scan never
samples files and column pruning / filter pushdown reach the parquet reader.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES, Shop, schema_of

# Load order of the seed: parents before children.
SEED_ORDER = ["users", "brands", "categories", "colors", "sizes", "products",
              "product_variants", "sales", "product_sales", "product_images", "cart",
              "cart_items", "orders", "order_details", "payments", "shipping", "reviews"]


def read_shop_tables(spark: SparkSession, path: str, as_of: dt.datetime | None = None) -> Shop:
    """The 17 tables from ``path/<table>`` parquet folders."""
    tables = {t: spark.read.schema(schema_of(t)).parquet(f"{path.rstrip('/')}/{t}")
              for t in TABLES}
    kw = {"as_of": as_of} if as_of else {}
    return Shop(spark=spark, source=path, **tables, **kw)


def read_shop_tables_jdbc(spark: SparkSession, url: str, properties: dict,
                          table_names: dict[str, str] | None = None,
                          num_partitions: int = 64) -> Shop:
    """The 17 tables from a relational database (optional source).

    Each table is read in ``num_partitions`` parallel range reads on its first
    key column, so no single connection streams a whole table. ``table_names``
    maps shop table names to database table names. Not exercised by the tests:
    it needs a database server.
    """
    names = table_names or {}
    tables = {}
    for t in TABLES:
        key = schema_of(t).fields[0].name
        dbtable = names.get(t, t)
        bounds = (spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {dbtable}) b",
                                  properties=properties).first())
        if bounds is None or bounds["lo"] is None:
            df = spark.read.jdbc(url, dbtable, properties=properties)
        else:
            df = spark.read.jdbc(url, dbtable, column=key, lowerBound=int(bounds["lo"]),
                                 upperBound=int(bounds["hi"]) + 1, numPartitions=num_partitions,
                                 properties=properties)
        tables[t] = df.select(*[df[f.name].cast(f.dataType).alias(f.name)
                                for f in schema_of(t).fields])
    return Shop(spark=spark, source=url, **tables)


def write_shop_tables(shop: Shop, path: str, tables: list[str] | None = None) -> None:
    """Write a snapshot (e.g. the output of a write-path job); one folder per
    table, replaced as a whole."""
    for t in tables or TABLES:
        df = getattr(shop, t)
        df.select(*[f.name for f in schema_of(t).fields]).write.mode("overwrite") \
            .parquet(f"{path.rstrip('/')}/{t}")


def load_seed(spark: SparkSession, rows: dict[str, list[tuple]],
              as_of: dt.datetime | None = None) -> Shop:
    """Literal rows per table (tests and fixtures), created in dependency
    order with the shop schemas; missing tables are empty."""
    tables = {}
    for t in SEED_ORDER:
        tables[t] = spark.createDataFrame(rows.get(t, []), schema_of(t))
    kw = {"as_of": as_of} if as_of else {}
    return Shop(spark=spark, **tables, **kw)


def write_documents(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write nested documents (product / order documents) as JSON lines or
    parquet, nested columns kept."""
    df.write.mode("overwrite").format(fmt).save(path)


def read_documents(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)
