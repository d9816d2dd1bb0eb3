"""The write path, re-aimed as bulk upserts that return new snapshots.

The shop writes one request at a time inside a transaction; here a batch of
requests becomes set-based joins and the result is the next version of each
table (plus an outcome per request). Rules that depend on request order are
resolved by payload / sequence order: "last non-blank value wins" is a
``max_by`` over the sequence, stock competition is ``plans.allocate``, and new
identity keys follow the largest existing key in a business order
(``plans.keys``), never a one-partition row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.money import TOTAL
from ..model import Shop
from ..plans.allocate import allocate_in_order
from ..plans.claims import decide_claims
from ..plans.keys import aligned_keys, next_keys
from ..session import ensure_checkpoint_dir, stored
from . import shared

# ---- fixed values ------------------------------------------------------------
GUEST_EMAIL = "guest_{}@guest.local"   # generated e-mail of a guest checkout
DEFAULT_COLOR = "Default"
DEFAULT_SIZE = "Default"
PENDING = "Pending"
ROLES = ["admin", "user"]
#: Why an item fails its payload, by code; ties on position go to the smaller one.
ITEM_REASONS = {1: "invalid item", 2: "variant not found", 3: "duplicate variant"}
# -----------------------------------------------------------------------------


def _trim_or_empty(c):
    return F.trim(F.coalesce(c, F.lit("")))


def _name_key(c):
    """Names compare case-insensitively and without trailing blanks, as the
    shop database's default collation does."""
    return F.lower(F.rtrim(c))


# ---- keys and dimensions -------------------------------------------------------
def w_assign_keys(new_rows: DataFrame, existing: DataFrame, id_col: str, order: list) -> DataFrame:
    """New rows get max(existing id) + 1, 2, ... in ``order``."""
    return next_keys(new_rows, existing, id_col, order)


def w_dimension_get_or_create(names: DataFrame, dim: DataFrame, id_col: str) -> dict[str, DataFrame]:
    """Trim names, skip blanks, add the unseen ones with new ids (in order of
    first appearance, ``seq``). Returns the new rows and the full table."""
    cand = (names.select(F.trim(F.col("name")).alias("name"), "seq")
            .filter(F.col("name") != "")
            .withColumn("_k", _name_key(F.col("name"))))
    first = cand.groupBy("_k").agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    known = dim.select(_name_key(F.col("name")).alias("_k")).distinct()
    unseen = first.join(known, "_k", "left_anti")
    new_rows = next_keys(unseen, dim, id_col, [F.col("seq").asc(), F.col("_k").asc()]) \
        .select(id_col, "name")
    return {"new": new_rows, "table": dim.select(id_col, "name").unionByName(new_rows)}


def _resolve_names(names: DataFrame, table: DataFrame, id_col: str, out: str) -> DataFrame:
    """name -> id through the (updated) dimension table; blank -> NULL."""
    t = table.select(_name_key(F.col("name")).alias("_k"), F.col(id_col).alias(out)) \
        .groupBy("_k").agg(F.min(out).alias(out))
    return names.withColumn("_k", _name_key(F.trim(F.col("name")))).join(t, "_k", "left").drop("_k")


# ---- order intake ----------------------------------------------------------------
def _parse_int(text):
    """JavaScript parseInt(text, 10): leading blanks skipped, leading digits read."""
    digits = F.regexp_extract(F.ltrim(F.coalesce(text.cast("string"), F.lit(""))), r"^[+-]?\d+", 0)
    return F.when(digits != "", digits.try_cast("long"))


def w_variant_resolve(shop: Shop, items: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Size and colour both given -> the exact variant; otherwise the lowest
    variant id of the product (chosen by presence of input, not by failure);
    none -> variant_id NULL. Both are one lookup (product, size, colour), where blanks stand
    for the lowest, so the items move once. ``carry``: variant_id and columns that are
    joined to the lookup's variants (left) and come with them."""
    v = shared.variants_named(shop)
    exact = (v.groupBy("product_id", F.col("size_name").alias("_s"), F.col("color_name").alias("_c"))
             .agg(F.min("variant_id").alias("variant_id"))
             .filter((F.col("_s") != "") & (F.col("_c") != "")))
    first = v.groupBy("product_id").agg(F.min("variant_id").alias("variant_id")).select(
        "product_id", F.lit("").alias("_s"), F.lit("").alias("_c"), "variant_id")
    lookup = exact.unionByName(first)
    if carry is not None:
        lookup = lookup.join(carry, "variant_id", "left")
    it = (items.withColumn("product_id", _parse_int(F.col("product_id_text")))
          .withColumn("_s", _trim_or_empty(F.col("size")))
          .withColumn("_c", _trim_or_empty(F.col("color"))))
    both = (F.col("_s") != "") & (F.col("_c") != "")
    for c in ("_s", "_c"):
        it = it.withColumn(c + "k", F.when(both, F.col(c)).otherwise(F.lit("")))
    it = it.drop("_s", "_c").withColumnsRenamed({"_sk": "_s", "_ck": "_c"})
    # The lookup is the small side, a share of it per task: the items need no sort.
    return it.join(lookup.hint("shuffle_hash"), ["product_id", "_s", "_c"], "left").drop("_s", "_c")


def w_customer_upsert(shop: Shop, headers: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """Match payload customers to users by e-mail; a blank e-mail is a guest
    with a generated one. Existing users take only non-blank values (the last
    one in payload order); new users start from their first payload."""
    t = F.lit(as_of or shop.as_of).cast("timestamp")
    email = F.trim(F.coalesce(F.col("email"), F.lit("")))
    h = headers.select(
        "payload_id",
        F.when(email != "", email).otherwise(
            F.concat(F.lit(GUEST_EMAIL.split("{}")[0]), F.col("payload_id").cast("string"),
                     F.lit(GUEST_EMAIL.split("{}")[1]))).alias("email"),
        F.when(F.col("name").isNull() | (F.col("name") == ""), F.lit(labels.GUEST_NAME))
         .otherwise(F.trim(F.col("name"))).alias("name"),
        _trim_or_empty(F.col("phone")).alias("phone"),
        _trim_or_empty(F.col("address")).alias("address"))
    h = h.withColumn("_k", _name_key(F.col("email")))

    def last_nonblank(c):
        return F.max_by(F.col(c), F.when(F.col(c) != "", F.col("payload_id")))

    first = ("email", "name", "phone", "address")
    per = h.groupBy("_k").agg(
        F.min("payload_id").alias("_first_pid"),
        *[last_nonblank(c).alias(f"_nb_{c}") for c in first[1:]],
        F.min_by(F.struct(*first), "payload_id").alias("_f")).select(
        "_k", F.col("_f.email").alias("email"), "_first_pid", *[f"_nb_{c}" for c in first[1:]],
        *[F.col(f"_f.{c}").alias(f"_first_{c}") for c in first[1:]])
    users = shop.users.withColumn("_k", _name_key(F.col("email")))
    hit_keys = users.groupBy("_k").agg(F.min("user_id").alias("_uid"))  # the first match
    matched = stored(per.join(hit_keys, "_k", "left"))  # the keys and the owners read it
    upd = matched.filter(F.col("_uid").isNotNull()).select(
        F.col("_uid").alias("user_id"), "_k", "_nb_name", "_nb_phone", "_nb_address")
    updated = (shop.users.join(upd, "user_id")
               .select("user_id", F.coalesce("_nb_name", "name").alias("name"), "email",
                       F.coalesce("_nb_phone", "phone").alias("phone"),
                       F.coalesce("_nb_address", "address").alias("address"), "role", "created_at"))
    fresh = next_keys(matched.filter(F.col("_uid").isNull()), shop.users, "user_id",
                      [F.col("_first_pid").asc()])
    created = fresh.select(
        "user_id", F.coalesce("_nb_name", "_first_name").alias("name"), "email",
        F.coalesce("_nb_phone", "_first_phone").alias("phone"),
        F.coalesce("_nb_address", "_first_address").alias("address"),
        F.lit("user").alias("role"),
        t.cast(shop.users.schema["created_at"].dataType).alias("created_at"))
    cols = ["user_id", "name", "email", "phone", "address", "role", "created_at"]
    table = (shop.users.join(updated.select("user_id"), "user_id", "left_anti").select(*cols)
             .unionByName(updated.select(*cols)).unionByName(created.select(*cols)))
    owner = upd.select("_k", "user_id").unionByName(fresh.select("_k", "user_id"))
    payload_user = h.select("payload_id", "_k").join(owner, "_k").select("payload_id", "user_id")
    return {"users": table, "payload_user": payload_user, "created": created, "updated": updated}


def w_order_intake(shop: Shop, headers: DataFrame, items: DataFrame,
                   as_of=None, want: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Order payloads -> users, orders, payments, shipping, lines, stock.

    A payload is rejected whole when it has no customer or no item, when an
    item has no valid product id, quantity (1 at least) or price, when no
    variant resolves, when two items are the same variant, or when stock (left by earlier accepted payloads, in payload
    order) is short. The stored total is the caller's; the computed one is
    reported beside it. ``want`` names the results that are used (None: all): the new lines
    are numbered, which takes jobs of its own, only when they are.
    """
    t = F.lit(as_of or shop.as_of).cast("timestamp")
    res = w_variant_resolve(shop, items, shop.product_variants.select("variant_id", "stock"))
    qty = F.coalesce(F.col("quantity"), F.lit(0.0))
    price = F.coalesce(F.col("price"), F.lit(0.0))
    item_reason = (F.when(F.coalesce(F.col("product_id"), F.lit(0)) == 0, F.lit(1))
                   .when(qty.cast("int") < 1, F.lit(1)).when(price <= 0, F.lit(1))
                   .when(F.col("variant_id").isNull() | F.col("stock").isNull(), F.lit(2)))
    # Items move to their payload once: its verdict stands beside each of them, and what
    # follows reads the written rows. Those of no customer's payload are in no result.
    known = headers.filter(F.coalesce(F.col("has_customer"), F.lit(False))).select("payload_id")
    own = Window.partitionBy("payload_id")
    # The first failing item decides the reason (ties on position: by reason).
    failing = F.min(F.when(F.col("_why").isNotNull(), F.struct("pos", "_why"))).over(own)
    # An order holds a variant once (unique order and variant).
    again = F.col("variant_id") == F.lag("variant_id").over(own.orderBy("variant_id"))
    res = stored(res.withColumn("_why", item_reason)
                 .join(known.hint("shuffle_hash"), "payload_id", "left_semi")
                 .withColumn("_again", again)
                 .select("payload_id", "pos", "variant_id", "stock", "quantity", "price",
                         F.coalesce(failing["_why"], F.when(F.max("_again").over(own), F.lit(3)))
                         .alias("_bad")))
    per_payload = res.groupBy("payload_id").agg(F.max("_bad").alias("_bad"),
                                                F.count(F.lit(1)).alias("_n"))
    reason = F.when(~F.coalesce(F.col("has_customer"), F.lit(False)) | F.col("_n").isNull(),
                    F.lit("invalid payload"))
    for code, text in ITEM_REASONS.items():
        reason = reason.when(F.col("_bad") == code, F.lit(text))
    h = headers.join(per_payload, "payload_id", "left").withColumn("reason", reason)
    lines = (res.filter(F.col("_bad").isNull())
             .withColumn("quantity_i", qty.cast("int"))
             .withColumn("price_d", price.cast("decimal(10,2)")))
    # A valid payload names a variant once, and its item has the variant's stock.
    decided = allocate_in_order(
        lines.select(F.col("payload_id").alias("req_id"), F.col("payload_id").alias("seq"),
                     "variant_id", F.col("quantity_i").alias("qty"), F.col("stock").alias("cap")),
        None, ["variant_id"])
    h = (h.join(decided.select(F.col("req_id").alias("payload_id"), "accepted"), "payload_id", "left")
         .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                     .when(~F.col("accepted"), F.lit("insufficient stock")))
         .withColumn("accepted", F.col("reason").isNull()))
    h = stored(h.drop("has_customer", "_n", "_bad"))
    ok = h.filter("accepted")
    cust = w_customer_upsert(shop, ok, as_of)
    orders_new = stored(next_keys(ok.select("payload_id", "total_amount", "order_date", "payment_method",
                                      "address"),
                            shop.orders, "order_id", [F.col("payload_id").asc()])
                  .join(cust["payload_user"], "payload_id"))
    ok_lines = lines.join(orders_new.select("payload_id", "order_id"), "payload_id")
    computed = ok_lines.groupBy("payload_id").agg(
        F.sum(F.col("quantity_i") * F.col("price_d")).cast(TOTAL).alias("computed_total"))
    orders_tbl = orders_new.select(
        "order_id", "user_id",
        F.coalesce(F.col("order_date"), t).cast(shop.orders.schema["order_date"].dataType)
        .alias("order_date"),
        F.lit(PENDING).alias("status"),
        F.coalesce(F.col("total_amount"), F.lit(0.0)).cast("decimal(12,2)").alias("total_amount"))
    payments = aligned_keys(orders_new, "order_id", shop.orders, shop.payments, "payment_id").select(
        "payment_id", "order_id", labels.map_payment_method(F.col("payment_method")).alias("method"),
        F.lit(PENDING).alias("status"))
    shipping = aligned_keys(orders_new, "order_id", shop.orders, shop.shipping, "shipping_id").select(
        "shipping_id", "order_id", _trim_or_empty(F.col("address")).alias("address"),
        F.lit(PENDING).alias("status"))
    taken = ok_lines.groupBy("variant_id").agg(F.sum("quantity_i").alias("_t"))
    stock = (shop.product_variants.join(taken, "variant_id", "left")
             .withColumn("stock", (F.col("stock") - F.coalesce(F.col("_t"), F.lit(0))).cast("int"))
             .drop("_t"))
    outcome = (h.join(orders_new.select("payload_id", "order_id", "user_id"), "payload_id", "left")
               .join(computed, "payload_id", "left")
               .select("payload_id", "accepted", "reason", "order_id", "user_id",
                       F.col("total_amount").cast("decimal(12,2)").alias("client_total"),
                       "computed_total"))
    out = {"outcome": outcome, "users": cust["users"],
           "orders": shop.orders.unionByName(orders_tbl),
           "payments": shop.payments.unionByName(payments),
           "shipping": shop.shipping.unionByName(shipping),
           "product_variants": stock}
    if want is None or "order_details" in want:
        details = next_keys(ok_lines.select("order_id", "pos", "variant_id",
                                            F.col("quantity_i").alias("quantity"),
                                            F.col("price_d").alias("price")),
                            shop.order_details, "order_detail_id",
                            [F.col("order_id").asc(), F.col("pos").asc(), F.col("variant_id").asc(),
                             F.col("quantity").asc(), F.col("price").asc()]
                            ).drop("pos")
        out["order_details"] = shop.order_details.unionByName(details)
    return out


# ---- product upsert ----------------------------------------------------------------
def _sizes_array(text):
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","),
                                                  lambda s: F.trim(s)), lambda s: s != ""))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(DEFAULT_SIZE)))


def w_product_upsert(shop: Shop, payloads: DataFrame) -> dict[str, DataFrame]:
    """Create (product_id NULL) or replace products.

    Payload: seq, product_id, name, description, price, category, brand, image,
    stock, sizes (comma text). Name is required and price must be >= 0; an
    update needs an existing product. Brand, category, sizes and the colour
    "Default" are got-or-created; images and variants are replaced: one
    variant per distinct size with all the stock on the first size. Deleting
    the old variants cascades to their order and cart lines, as the schema's
    ON DELETE CASCADE does. Several payloads for one product: the last wins.
    """
    p = payloads.withColumn("_name", F.trim(F.coalesce(F.col("name"), F.lit(""))))
    exists = shop.products.select("product_id").withColumn("_exists", F.lit(True))
    p = (p.join(exists, "product_id", "left")
         .withColumn("reason",
                     F.when(F.col("_name") == "", F.lit("name required"))
                      .when(F.col("price").isNull() | (F.col("price") < 0), F.lit("invalid price"))
                      .when(F.col("product_id").isNotNull() & F.col("_exists").isNull(),
                            F.lit("product not found"))))
    ok = p.filter(F.col("reason").isNull())
    creates = next_keys(ok.filter(F.col("product_id").isNull()).drop("product_id"), shop.products,
                        "product_id", [F.col("seq").asc()])
    updates = ok.filter(F.col("product_id").isNotNull())
    last = updates.groupBy("product_id").agg(F.max("seq").alias("seq"))
    updates = updates.join(last, ["product_id", "seq"])
    ensure_checkpoint_dir(shop.spark)  # written once: all tables below read it
    chosen = creates.unionByName(updates.select(*creates.columns)).checkpoint()

    def names(col):
        return chosen.select(F.col(col).alias("name"), "seq")

    brands = w_dimension_get_or_create(names("brand"), shop.brands, "brand_id")["table"]
    cats = w_dimension_get_or_create(names("category"), shop.categories, "category_id")["table"]
    size_names = chosen.select(F.explode(_sizes_array(F.col("sizes"))).alias("name"), "seq")
    sizes = w_dimension_get_or_create(size_names, shop.sizes, "size_id")["table"]
    colour = chosen.select(F.lit(DEFAULT_COLOR).alias("name"), "seq")
    added = w_dimension_get_or_create(colour, shop.colors, "color_id")
    colors = added["table"]

    rows = _resolve_names(chosen.withColumn("name", F.col("brand")), brands, "brand_id", "brand_id")
    rows = _resolve_names(rows.withColumn("name", F.col("category")), cats, "category_id", "category_id")
    new_products = rows.select(
        "product_id", F.col("_name").alias("name"),
        # A missing or empty description is NULL; blanks trim to ''.
        F.when(F.coalesce(F.col("description"), F.lit("")) != "",
               F.trim(F.col("description"))).alias("description"),
        F.col("brand_id").cast("int"), F.col("category_id").cast("int"),
        F.lit(None).cast(shop.products.schema["created_at"].dataType).alias("created_at"))
    touched = chosen.select("product_id")
    products = shop.products.join(touched, "product_id", "left_anti").unionByName(new_products)

    images_new = next_keys(chosen.filter(F.trim(F.coalesce(F.col("image"), F.lit(""))) != "")
                           .select("product_id", F.trim(F.col("image")).alias("image_url")),
                           shop.product_images, "image_id", [F.col("product_id").asc()])
    images = (shop.product_images.join(touched, "product_id", "left_anti")
              .unionByName(images_new.select("image_id", "product_id", "image_url")))

    default_color = colors.filter(_name_key(F.col("name")) == DEFAULT_COLOR.lower()) \
        .select(F.min("color_id")).scalar()
    per_size = chosen.select("product_id", "price", "stock",
                             F.posexplode(_sizes_array(F.col("sizes"))).alias("pos", "name"))
    per_size = _resolve_names(per_size, sizes, "size_id", "size_id")
    variants_new = next_keys(per_size, shop.product_variants, "variant_id",
                             [F.col("product_id").asc(), F.col("pos").asc()]).select(
        "variant_id", "product_id", F.col("size_id").cast("int"),
        default_color.cast("int").alias("color_id"), F.col("price").cast("decimal(10,2)").alias("price"),
        F.when(F.col("pos") == 0, F.coalesce(F.col("stock"), F.lit(0))).otherwise(F.lit(0))
        .cast("int").alias("stock"),
        F.lit(None).cast(shop.product_variants.schema["created_at"].dataType).alias("created_at"))
    dropped = shop.product_variants.join(touched, "product_id", "left_semi").select("variant_id")
    variants = (shop.product_variants.join(touched, "product_id", "left_anti")
                .unionByName(variants_new))
    outcome = p.select("seq", "product_id", F.col("reason").isNull().alias("accepted"), "reason") \
        .join(creates.select("seq", F.col("product_id").alias("_new_id")), "seq", "left") \
        .select("seq", F.coalesce("product_id", "_new_id").alias("product_id"), "accepted", "reason")
    return {"outcome": outcome, "products": products, "product_images": images,
            "product_variants": variants, "brands": brands, "categories": cats, "sizes": sizes,
            "colors": shop.colors.unionByName(added["new"], allowMissingColumns=True),
            "order_details": shop.order_details.join(dropped, "variant_id", "left_anti"),
            "cart_items": shop.cart_items.join(dropped, "variant_id", "left_anti")}


# ---- admin updates -------------------------------------------------------------
def w_user_update(shop: Shop, updates: DataFrame) -> dict[str, DataFrame]:
    """Admin user edits (seq, user_id, name, email, phone, address, role), decided in
    order of ``seq``.

    Rejected: blank name or e-mail, a role outside admin/user, an unknown
    user, or an e-mail that another user has at that moment: addresses given up by an
    earlier edit are free, those taken by one are not (``plans.claims``). Per user the last
    accepted edit wins; blank phone and address become NULL.
    """
    u = updates.select("seq", "user_id", F.trim(F.coalesce("name", F.lit(""))).alias("name"),
                       F.trim(F.coalesce("email", F.lit(""))).alias("email"),
                       F.trim(F.coalesce("phone", F.lit(""))).alias("phone"),
                       F.trim(F.coalesce("address", F.lit(""))).alias("address"),
                       F.coalesce("role", F.lit("user")).alias("role"))
    exists = shop.users.select("user_id").withColumn("_exists", F.lit(True))
    u = (u.join(exists, "user_id", "left")
         .withColumn("reason", F.when(F.col("name") == "", F.lit("name required"))
                     .when(F.col("email") == "", F.lit("email required"))
                     .when(~F.col("role").isin(ROLES), F.lit("invalid role"))
                     .when(F.col("_exists").isNull(), F.lit("user not found"))))
    claims = u.filter(F.col("reason").isNull()).select(
        F.col("seq").cast("long").alias("seq"), F.col("user_id").cast("long").alias("holder"),
        _name_key(F.col("email")).alias("name"))
    held = shop.users.select(F.col("user_id").cast("long").alias("holder"),
                             _name_key(F.col("email")).alias("name"))
    u = (u.join(decide_claims(claims, held), "seq", "left")
         .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                     .when(~F.col("ok"), F.lit("email exists"))))
    good = u.filter(F.col("reason").isNull())
    last = good.groupBy("user_id").agg(F.max("seq").alias("seq"))
    final = good.join(last, ["user_id", "seq"]).select(
        "user_id", "name", "email", F.when(F.col("phone") != "", F.col("phone")).alias("phone"),
        F.when(F.col("address") != "", F.col("address")).alias("address"), "role")
    users = (shop.users.join(final.select("user_id"), "user_id", "left_anti")
             .unionByName(final.join(shop.users.select("user_id", "created_at"), "user_id")))
    outcome = u.select("seq", "user_id", F.col("reason").isNull().alias("accepted"), "reason")
    return {"outcome": outcome, "users": users}


def w_order_status_update(shop: Shop, updates: DataFrame) -> dict[str, DataFrame]:
    """Admin order edits (seq, order_id, order_status, payment_status,
    payment_method): statuses are normalised and mapped to stored values; the
    order's status is set; the latest payment's status is set, or a payment
    is added when the order has none. A NULL status leaves that part alone
    (the order-only and payment-only edits). Unknown orders are rejected; of
    several edits of an order the last one that sets a part wins for that part."""
    exists = shop.orders.select("order_id").withColumn("_exists", F.lit(True))
    u = (updates.join(exists, "order_id", "left")
         .withColumn("reason", F.when(F.col("_exists").isNull(), F.lit("order not found"))))
    good = u.filter(F.col("reason").isNull())
    def latest_set(col: str):
        """The row with the largest seq among those that set ``col``."""
        return F.max_by(F.struct("order_status", "payment_status", "payment_method"),
                        F.when(F.col(col).isNotNull(), F.col("seq")))

    final = good.groupBy("order_id").agg(
        latest_set("order_status").alias("_o"), latest_set("payment_status").alias("_p")).select(
        "order_id",
        F.when(F.col("_o.order_status").isNotNull(),
               labels.db_order_status(F.col("_o.order_status"))).alias("_status"),
        F.when(F.col("_p.payment_status").isNotNull(),
               labels.db_payment_status(F.col("_p.payment_status"))).alias("_pay_status"),
        labels.db_payment_method(F.col("_p.payment_method")).alias("_pay_method"))
    orders = (shop.orders.join(final.select("order_id", "_status"), "order_id", "left")
              .withColumn("status", F.coalesce(F.col("_status"), F.col("status"))).drop("_status")
              .select(*shop.orders.columns))
    latest = shop.payments.groupBy("order_id").agg(F.max("payment_id").alias("payment_id"))
    target = final.filter(F.col("_pay_status").isNotNull()).join(latest, "order_id", "left")
    set_rows = target.filter(F.col("payment_id").isNotNull()).select("payment_id", "_pay_status")
    payments = (shop.payments.join(set_rows, "payment_id", "left")
                .withColumn("status", F.coalesce(F.col("_pay_status"), F.col("status")))
                .select(*shop.payments.columns))
    added = next_keys(target.filter(F.col("payment_id").isNull()).drop("payment_id"), shop.payments,
                      "payment_id", [F.col("order_id").asc()]).select(
        "payment_id", "order_id", F.col("_pay_method").alias("method"),
        F.col("_pay_status").alias("status"))
    outcome = u.select("seq", "order_id", F.col("reason").isNull().alias("accepted"), "reason")
    return {"outcome": outcome, "orders": orders, "payments": payments.unionByName(added),
            "added_payments": added}
