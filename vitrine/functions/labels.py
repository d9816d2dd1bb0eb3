"""Scalar label logic: status / payment normalisation and product grouping.

All of it is ``when`` chains over built-in string functions, so it stays in
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the shop's own lists) -----------------------
ORDER_STATUSES = ["pending", "confirmed", "shipping", "completed", "cancelled"]
PAYMENT_STATUSES = ["pending", "paid", "failed"]
DB_ORDER_STATUS = {"pending": "Pending", "confirmed": "Confirmed", "shipping": "Shipping",
                   "completed": "Completed", "cancelled": "Cancelled"}
DB_PAYMENT_STATUS = {"pending": "Pending", "paid": "Paid", "failed": "Failed"}
# Category groups of the shop pages, checked in this order; "ao" alone also
# marks a top (it matches any text containing those two letters).
DEFAULT_GROUPS = [("Giày", ["giày", "shoe"]), ("Quần", ["quần"]), ("Áo", ["áo", "ao"])]
OTHER_GROUP = "Khác"
SHOE_WORDS = ["giày", "shoe"]
STOCK_IN = "Còn hàng"
STOCK_LOW = "Sắp hết hàng"
STOCK_OUT = "Hết hàng"
SALE_ON = "Đang áp dụng"
SALE_OFF = "Không áp dụng"
GUEST_NAME = "Khách hàng"
# --------------------------------------------------------------------------


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def norm_payment_method(c: Column) -> Column:
    m = _low(c)
    return (F.when(m == "bank", F.lit("banking"))
            .when(m == "", F.lit("cod"))
            .otherwise(m))


def norm_payment_status(c: Column) -> Column:
    s = _low(c)
    return F.when(s.isin(*PAYMENT_STATUSES), s).otherwise(F.lit("pending"))


def norm_order_status(c: Column) -> Column:
    s = _low(c)
    return F.when(s.isin(*ORDER_STATUSES), s).otherwise(F.lit("pending"))


def _map(c: Column, mapping: dict, default: str) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v)))
    return out.otherwise(F.lit(default))


def db_order_status(c: Column) -> Column:
    return _map(norm_order_status(c), DB_ORDER_STATUS, "Pending")


def db_payment_status(c: Column) -> Column:
    return _map(norm_payment_status(c), DB_PAYMENT_STATUS, "Pending")


def db_payment_method(c: Column) -> Column:
    m = _low(c)
    return F.when(m.isin("banking", "bank"), F.lit("Bank")).otherwise(F.lit("COD"))


def map_payment_method(c: Column) -> Column:
    """Payment method of the order intake (note: "bank" becomes COD here)."""
    m = _low(c)
    return (F.when(m == "cod", F.lit("COD")).when(m == "banking", F.lit("Bank"))
            .when(m == "momo", F.lit("Momo")).otherwise(F.lit("COD")))


def _group(text: Column, groups, default: str) -> Column:
    out = None
    for label, needles in groups:
        cond = None
        for n in needles:
            c = text.contains(n.lower())
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def category_group(category: Column, groups=None) -> Column:
    """Group of the shop list page: looks at the category only, '' if none."""
    text = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    return _group(text, groups or DEFAULT_GROUPS, "")


def product_group(category: Column, name: Column, groups=None) -> Column:
    """Group of the admin page: category and name together, 'Khác' if none."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))
    return _group(text, groups or DEFAULT_GROUPS, OTHER_GROUP)


def is_shoe(category: Column, name: Column, brand: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")),
                               F.coalesce(name, F.lit("")), F.coalesce(brand, F.lit(""))))
    cond = None
    for w in SHOE_WORDS:
        cond = text.contains(w) if cond is None else (cond | text.contains(w))
    return cond


def stock_state3(total_stock: Column) -> Column:
    return (F.when(total_stock == 0, F.lit(STOCK_OUT))
            .when(total_stock <= 5, F.lit(STOCK_LOW)).otherwise(F.lit(STOCK_IN)))


def stock_state2(stock: Column) -> Column:
    return F.when(stock > 0, F.lit(STOCK_IN)).otherwise(F.lit(STOCK_OUT))
