"""Identity keys for new rows: max(existing id) + 1, 2, 3 ... in a business
order, numbered by the distributed running count of ``plans.scan`` (never a
one-partition ``row_number``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import row_numbers


def next_keys(new_rows: DataFrame, existing: DataFrame, id_col: str, order: list[Column],
              out: str | None = None) -> DataFrame:
    """Give ``new_rows`` ids after the largest ``existing[id_col]``.

    ``order`` must be a total order of ``new_rows`` (a business key) so that
    the ids are deterministic and survive task retries.
    """
    out = out or id_col
    base = F.coalesce(existing.select(F.max(id_col)).scalar(), F.lit(0)).cast("long")
    numbered = row_numbers(new_rows, order, "_key_n")
    return numbered.withColumn(out, base + F.col("_key_n")).drop("_key_n")


def aligned_keys(new_rows: DataFrame, numbered_by: str, numbered_from: DataFrame,
                 existing: DataFrame, id_col: str) -> DataFrame:
    """Ids for rows that come one to each new key of another table: the column
    ``numbered_by`` already counts on without gaps from the largest key of
    ``numbered_from``, so its distance from there is the row's number."""
    def top(df: DataFrame, col: str) -> Column:
        return F.coalesce(df.select(F.max(col)).scalar(), F.lit(0)).cast("long")

    return new_rows.withColumn(
        id_col, top(existing, id_col) + F.col(numbered_by) - top(numbered_from, numbered_by))
