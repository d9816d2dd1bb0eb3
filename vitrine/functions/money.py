"""Decimal price rules.

Three rules coexist in the shop and stay distinct:
- views round the discounted price to 2 places (half up);
- procedures and the price report keep the exact value;
- cart lines round quantity x the *unrounded* discounted price.

``price * (100 - pct) * 0.01`` is exact at 4 places for a 2-place price and an
integer percent, so every rule is a cast of the same exact product.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(20,4)"
MONEY = "decimal(10,2)"
LINE = "decimal(12,2)"
TOTAL = "decimal(38,2)"


def _cent() -> Column:
    return F.lit(Decimal("0.01"))


def exact_discounted(price: Column, pct: Column) -> Column:
    return (price * (F.lit(100) - pct) * _cent()).cast(EXACT)


def rounded_discounted(price: Column, pct: Column) -> Column:
    return (price * (F.lit(100) - pct) * _cent()).cast(MONEY)


def line_total(quantity: Column, price: Column, pct: Column | None = None) -> Column:
    if pct is None:
        return (quantity * price).cast(LINE)
    return (quantity * price * (F.lit(100) - pct) * _cent()).cast(LINE)

