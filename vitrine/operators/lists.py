"""List-page logic of the shop front end, as plans over the backend lists:
filters, facets, sorts, groups, size availability, cart merge and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.sizes import size_guide_table, sort_sizes
from ..functions.text import is_blank
from ..model import Shop
from . import documents, shared


def shop_filter(products: DataFrame, category: str | None = None, brand: str | None = None,
                min_price=0, max_price=None, sort: str | None = None,
                groups=None) -> DataFrame:
    """Category group, brand (case-insensitive), closed price range, optional
    price sort (ties keep the list's id order)."""
    rows = products
    if category:
        rows = rows.filter(labels.category_group(F.col("category"), groups) == category)
    if brand:
        rows = rows.filter(F.lower(F.coalesce(F.col("brand"), F.lit(""))) == brand.lower())
    rows = rows.filter(F.col("price") >= F.lit(min_price))
    if max_price is not None:  # a page's own cap is the page's to pass
        rows = rows.filter(F.col("price") <= F.lit(max_price))
    if sort == "asc":
        rows = rows.orderBy(F.col("price").asc(), F.col("product_id").desc())
    elif sort == "desc":
        rows = rows.orderBy(F.col("price").desc(), F.col("product_id").desc())
    return rows


def sort_price(products: DataFrame, direction: str = "asc") -> DataFrame:
    p = F.col("price").asc() if direction == "asc" else F.col("price").desc()
    return products.orderBy(p, F.col("product_id").desc())


def facet_brands(products: DataFrame) -> DataFrame:
    """Distinct trimmed non-blank brands of a product list."""
    b = F.trim(F.col("brand"))
    return products.select(b.alias("brand")).filter(F.col("brand") != "").distinct()


def home_popular(products: DataFrame, n: int = 8) -> DataFrame:
    """First n of the list (newest id first): the feature is the limit."""
    return products.orderBy(F.col("product_id").desc()).limit(n)


def with_product_group(products: DataFrame, groups=None) -> DataFrame:
    return products.withColumn("product_group",
                               labels.product_group(F.col("category"), F.col("name"), groups))


def admin_product_filter(products: DataFrame, keyword: str | None = None,
                         group: str | None = None, groups=None) -> DataFrame:
    """Keyword over id / name / brand / category and an optional group."""
    rows = with_product_group(products, groups)
    if not is_blank(keyword):
        q = str(keyword).strip().lower()
        cond = None
        for c in ("product_id", "name", "brand", "category"):
            t = F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q)
            cond = t if cond is None else (cond | t)
        rows = rows.filter(cond)
    if group and group != "all":
        rows = rows.filter(F.col("product_group") == group)
    return rows


def admin_order_filter(orders: DataFrame, keyword: str | None = None, field: str = "all",
                       payment_statuses=(), order_statuses=()) -> DataFrame:
    """Keyword in one field or any of id / name / phone / method; multi-select
    payment and order statuses (an empty selection means all)."""
    rows = orders
    if not is_blank(keyword):
        q = str(keyword).strip().lower()
        fields = {"id": "id", "customerName": "customer_name", "phone": "phone",
                  "paymentMethod": "payment_method"}
        cols = [fields[field]] if field in fields else list(fields.values())
        cond = None
        for c in cols:
            t = F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q)
            cond = t if cond is None else (cond | t)
        rows = rows.filter(cond)
    if payment_statuses:
        rows = rows.filter(F.col("payment_status").isin(list(payment_statuses)))
    if order_statuses:
        rows = rows.filter(F.col("order_status").isin(list(order_statuses)))
    return rows


def admin_user_filter(users: DataFrame, role: str = "all") -> DataFrame:
    return users if role == "all" else users.filter(F.col("role") == role)


def admin_counts_by_group(products: DataFrame, users: DataFrame, groups=None) -> DataFrame:
    """Counts shown on the admin pages: products per group, users per role."""
    g = (with_product_group(products, groups).groupBy("product_group")
         .agg(F.count(F.lit(1)).alias("n"))
         .select(F.lit("product_group").alias("kind"), F.col("product_group").alias("grp"), "n"))
    r = (users.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
         .select(F.lit("role").alias("kind"), F.col("role").alias("grp"), "n"))
    return g.unionByName(r)


def product_sizes_sorted(shop: Shop) -> DataFrame:
    """Every product's distinct sizes in display order (``sort_sizes``)."""
    v = shared.variants_named(shop)
    return (v.groupBy("product_id").agg(F.collect_set("size_name").alias("_s"))
            .select("product_id", sort_sizes(F.col("_s")).alias("sizes")))


def size_color_availability(shop: Shop) -> DataFrame:
    """Per product and colour: the colour's hex (first variant wins) and its
    sizes in display order. Groups are bounded by the size vocabulary."""
    v = shared.variants_named(shop).filter(F.col("size_name").isNotNull()
                                           & (F.col("size_name") != ""))
    return (v.groupBy("product_id", "color_name")
            .agg(F.min_by(F.coalesce(F.col("hex_code"), F.lit(documents.DEFAULT_HEX)),
                          F.col("variant_id")).alias("hex"),
                 F.collect_set("size_name").alias("_s"))
            .select("product_id", F.col("color_name").alias("color"), "hex",
                    sort_sizes(F.col("_s")).alias("sizes")))


def colors_by_size(shop: Shop) -> DataFrame:
    """Per product and size: colours in first-seen (variant id) order."""
    v = shared.variants_named(shop)
    first = v.groupBy("product_id", "size_name", "color_name").agg(
        F.min("variant_id").alias("_first"),
        F.min_by(F.coalesce(F.col("hex_code"), F.lit(documents.DEFAULT_HEX)),
                 F.col("variant_id")).alias("hex"))
    return (first.groupBy("product_id", "size_name")
            .agg(F.sort_array(F.collect_list(F.struct("_first", F.col("color_name").alias("name"),
                                                      "hex"))).alias("_c"))
            .select("product_id", F.col("size_name").alias("size"),
                    F.transform("_c", lambda x: F.struct(x["name"].alias("name"),
                                                         x["hex"].alias("hex"))).alias("colors")))


def op_size_guide(shop: Shop) -> DataFrame:
    """Variants joined to the size conversion chart (a fixed, small table)."""
    guide = F.broadcast(size_guide_table(shop.spark))
    v = shared.variants_named(shop).select("variant_id", "product_id", "size_name")
    return v.join(guide, F.upper(F.col("size_name")) == F.col("size")).select(
        "variant_id", "product_id", "size_name", "chart", "value")


def cart_merge(events: DataFrame) -> DataFrame:
    """Fold cart events per (cart, product, size, colour) in ``seq`` order.

    ``op`` is add (quantity adds, creating the line), set (quantity replaces
    it; <= 0 removes; on a missing line it does nothing), remove, or clear
    (empties the cart, whatever the line's other columns say). The fold is
    closed-form: nothing up to a cart's last clear has any effect; then the last
    set/remove decides the base, adds after it sum on top; a set finds the line
    present iff the last add/remove-like event before it was an add. Only
    aggregates and key joins - no per-key list.
    """
    key = ["cart_id", "product_id", "size", "color"]
    cleared = (events.filter(F.col("op") == "clear").groupBy("cart_id")
               .agg(F.max("seq").alias("_cleared")))
    ev = (events.filter(F.col("op") != "clear").join(cleared, "cart_id", "left")
          .filter(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared")))
          .select(*key, "seq", "op", F.col("quantity").cast("long").alias("quantity")))
    is_reset = F.col("op").isin("set", "remove")
    last_reset = (ev.filter(is_reset).groupBy(*key)
                  .agg(F.max_by(F.struct("op", "quantity"), "seq").alias("_r"),
                       F.max("seq").alias("_rseq")))
    j = ev.join(last_reset, key, "left")
    after = F.col("_rseq").isNull() | (F.col("seq") > F.col("_rseq"))
    before = F.col("_rseq").isNotNull() & (F.col("seq") < F.col("_rseq"))
    presence_change = (F.col("op") == "add") | (F.col("op") == "remove") | (
        (F.col("op") == "set") & (F.col("quantity") <= 0))
    agg = j.groupBy(*key).agg(
        F.sum(F.when(after & (F.col("op") == "add"), F.col("quantity"))).alias("_adds"),
        F.count(F.when(after & (F.col("op") == "add"), F.lit(1))).alias("_n_adds"),
        F.max_by(F.col("op") == "add",
                 F.when(before & presence_change, F.col("seq"))).alias("_present_before"),
        F.any_value("_r").alias("_r"))
    r_op, r_q = F.col("_r.op"), F.col("_r.quantity")
    base = (F.when(F.col("_r").isNull(), F.lit(None))
            .when((r_op == "set") & (r_q > 0) & F.coalesce(F.col("_present_before"), F.lit(False)),
                  r_q))
    adds = F.coalesce(F.col("_adds"), F.lit(0))
    quantity = F.when(base.isNotNull(), base + adds).when(F.col("_n_adds") > 0, adds)
    return (agg.select(*key, quantity.cast("int").alias("quantity"))
            .filter(F.col("quantity").isNotNull()))


def cart_totals(shop: Shop) -> DataFrame:
    """Per cart: items = sum of quantities, price = sum of product price x
    quantity (the product's list price, as the cart page uses)."""
    minp = shop.product_variants.groupBy("product_id").agg(F.min("price").alias("_p"))
    lines = (shop.cart_items.join(shop.product_variants.select("variant_id", "product_id"),
                                  "variant_id")
             .join(minp, "product_id"))
    return lines.groupBy("cart_id").agg(
        F.sum("quantity").cast("bigint").alias("total_items"),
        F.sum(F.col("quantity") * F.col("_p")).cast("decimal(38,2)").alias("total_price"))


def cart_events(shop_events: DataFrame, n_parts) -> DataFrame:
    """Every driver event as a cart event: purchases set a quantity (0 removes),
    signups remove, some errors clear the cart, all others add. A fiftieth of
    the parts are the products, so that lines of a cart meet again."""
    n = F.col("event_id")
    op = (F.when(F.col("event_type") == "purchase", F.lit("set"))
          .when(F.col("event_type") == "signup", F.lit("remove"))
          .when((F.col("event_type") == "error") & (n % 50 == 0), F.lit("clear"))
          .otherwise(F.lit("add")))
    return shop_events.select(
        F.col("user_id").alias("cart_id"),
        ((n * 17) % (F.floor(n_parts / 50) + 1)).cast("long").alias("product_id"),
        F.lit("").alias("size"), F.lit("").alias("color"), n.alias("seq"), op.alias("op"),
        F.when(op == "set", n % 3).otherwise(1 + n % 3).cast("int").alias("quantity"))

