"""Garment and shoe sizes: display order and the conversion chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
# Display order of garment sizes; other sizes follow (numbers ascending, then
# text).
CLOTHING_ORDER = ["XS", "S", "M", "L", "XL", "2XL", "3XL", "4XL", "5XL"]

# Shoe size chart of the product page: EU size -> (chart, value).
SHOE_CHART = {
    "CM": {"38": "24.0", "39": "24.5", "40": "25.0", "41": "25.5", "42": "26.5",
           "43": "27.0", "44": "27.5"},
    "US Nam": {"38": "6", "39": "6.5", "40": "7", "41": "8", "42": "8.5", "43": "9.5",
               "44": "10"},
    "US Nữ": {"38": "7.5", "39": "8", "40": "8.5", "41": "9.5", "42": "10", "43": "11",
              "44": "11.5"},
    "UK": {"38": "5.5", "39": "6", "40": "6.5", "41": "7.5", "42": "8", "43": "9",
           "44": "9.5"},
}
# Garment chart of the product page: unit -> measure -> size -> range.
CLOTHING_CHART = {
    "cm": {
        "Ngực": {"XS": "83 - 86", "S": "87 - 92", "M": "93 - 100", "L": "101 - 108",
                 "XL": "109 - 118", "2XL": "119 - 130", "3XL": "131 - 142"},
        "Eo": {"XS": "71 - 74", "S": "75 - 80", "M": "81 - 88", "L": "89 - 96",
               "XL": "97 - 106", "2XL": "107 - 119", "3XL": "120 - 132"},
        "Hông": {"XS": "82 - 85", "S": "86 - 91", "M": "92 - 99", "L": "100 - 107",
                 "XL": "108 - 116", "2XL": "117 - 125", "3XL": "126 - 134"},
    },
    "inch": {
        "Ngực": {"XS": "32.7 - 33.9", "S": "34.3 - 36.2", "M": "36.6 - 39.4",
                 "L": "39.8 - 42.5", "XL": "42.9 - 46.5", "2XL": "46.9 - 51.2",
                 "3XL": "51.6 - 55.9"},
        "Eo": {"XS": "28.0 - 29.1", "S": "29.5 - 31.5", "M": "31.9 - 34.6",
               "L": "35.0 - 37.8", "XL": "38.2 - 41.7", "2XL": "42.1 - 46.9",
               "3XL": "47.2 - 52.0"},
        "Hông": {"XS": "32.3 - 33.5", "S": "33.9 - 35.8", "M": "36.2 - 39.0",
                 "L": "39.4 - 42.1", "XL": "42.5 - 45.7", "2XL": "46.1 - 49.2",
                 "3XL": "49.6 - 52.8"},
    },
}
# ----------------------------------------------------------------------------


def size_sort_key(s: Column) -> Column:
    """A struct that sorts sizes: garments in fixed order, then numbers
    ascending, then other text."""
    upper = F.upper(s)
    idx = F.array_position(F.array(*[F.lit(x) for x in CLOTHING_ORDER]), upper)
    num = s.try_cast("double")
    klass = F.when(idx > 0, F.lit(0)).when(num.isNotNull(), F.lit(1)).otherwise(F.lit(2))
    return F.struct(klass.alias("k"),
                    F.when(idx > 0, idx).otherwise(F.lit(0)).cast("long").alias("i"),
                    F.when(idx > 0, F.lit(0.0)).otherwise(F.coalesce(num, F.lit(0.0))).alias("n"),
                    s.alias("s"))


def sort_sizes(arr: Column) -> Column:
    """Distinct trimmed non-blank sizes of an array, in display order."""
    cleaned = F.array_distinct(F.filter(F.transform(arr, lambda x: F.trim(x)),
                                        lambda x: x != ""))
    keyed = F.array_sort(F.transform(cleaned, size_sort_key))
    return F.transform(keyed, lambda k: k["s"])


def size_guide_table(spark: SparkSession) -> DataFrame:
    """The conversion chart as a small table (size, chart, value)."""
    rows = [(size, chart, value) for chart, m in SHOE_CHART.items() for size, value in m.items()]
    rows += [(size, f"{unit} {measure}", value)
             for unit, measures in CLOTHING_CHART.items()
             for measure, m in measures.items() for size, value in m.items()]
    return spark.createDataFrame(rows, "size STRING, chart STRING, value STRING")
