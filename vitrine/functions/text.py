"""Text predicates used by searches and audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(keyword) -> bool:
    return keyword is None or str(keyword).strip() == ""


def contains_ci(c: Column, keyword: str) -> Column:
    """Case-insensitive substring test; the keyword is literal text (``%`` and
    ``_`` carry no wildcard meaning)."""
    return F.lower(c).contains(str(keyword).lower())


def sql_len(c: Column) -> Column:
    """Character length ignoring trailing blanks, as the shop's LEN does."""
    return F.length(F.rtrim(c))


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
