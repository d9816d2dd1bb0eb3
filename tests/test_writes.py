"""Write path: order intake against a sequential replay, upserts on fixtures,
payload JSON round trip."""

import datetime as dt
import json
from decimal import Decimal as D

from pyspark.sql import functions as F

from vitrine.operators import writes as W
from vitrine.plans.allocate import allocate_in_order
from vitrine.sources import payloads as P
from vitrine.sources.tables import load_seed
from vitrine.streaming.feeds import scratch

from .test_edges import base_rows


def shop(spark, **extra):
    rows = base_rows()
    rows.update(extra)
    return load_seed(spark, rows, as_of=dt.datetime(2026, 4, 15))


def payload(pid, items, email="a@x", name="An", phone="", address=" Hue ", total=1.0, method="banking"):
    return {"payload_id": pid,
            "customer": {"name": name, "email": email, "phone": phone, "address": address},
            "items": [{"productId": p, "size": s, "color": c, "quantity": q, "price": pr}
                      for p, s, c, q, pr in items],
            "totalAmount": total, "paymentMethod": method, "orderDate": None}


def write_payloads(spark, docs):
    path = scratch(spark, "payload-test")
    spark.sparkContext.parallelize([json.dumps(d) for d in docs], 1).saveAsTextFile(path)
    return P.read_order_payloads(spark, path)


def replay(docs, stock, resolve):
    """The shop's per-payload transaction, in payload order."""
    out = {}
    left = dict(stock)
    for d in sorted(docs, key=lambda d: d["payload_id"]):
        if not d["customer"] or not d["items"]:
            out[d["payload_id"]] = False
            continue
        take, ok = {}, True
        for p, s, c, q, pr in [(i["productId"], i["size"], i["color"], i["quantity"], i["price"])
                               for i in d["items"]]:
            v = resolve(p, s, c)
            if not str(p).strip().isdigit() or int(p) == 0 or (q or 0) <= 0 or (pr or 0) <= 0 or v is None:
                ok = False
                break
            if left.get(v, 0) - take.get(v, 0) < q:
                ok = False
                break
            take[v] = take.get(v, 0) + q
        if ok:
            for v, q in take.items():
                left[v] -= q
        out[d["payload_id"]] = ok
    return out, left


def test_order_intake_matches_sequential_replay(spark):
    s = shop(spark)
    docs = [payload(1, [("1", "S", "Red", 1, 10.0)]),                 # variant 11 has no stock
            payload(2, [("1", "", "", 3, 10.0), ("3", "42", "Red", 2, 5.0)]),  # lowest id of 1 = 11
            payload(3, [("1", "M", "Red", 3, 10.0), ("2", "S", "Red", 4, 1.0)]),
            payload(4, [("1", "M", "Red", 3, 10.0)]),                 # 12: 5 left after payload 3 -> 2
            payload(5, [("2", "S", "Red", 2, 1.0), ("2", "S", "Red", 1, 1.0)]),
            payload(6, [("x", "S", "Red", 1, 1.0)]),
            payload(7, [("2", "S", "Red", 0, 1.0)]),
            payload(8, [], email=""),
            payload(9, [("3", "", "", 2, 1.0)], email="", name="")]
    variants = {(1, "S", "Red"): 11, (1, "M", "Red"): 12, (2, "S", "Red"): 21, (3, "42", "Red"): 31}
    first = {1: 11, 2: 21, 3: 31}

    def resolve(p, sz, c):
        if not str(p).strip().isdigit():
            return None
        p = int(p)
        return variants.get((p, sz, c)) if sz and c else first.get(p)

    stock = {11: 0, 12: 5, 21: 6, 31: 2}
    want, left = replay(docs, stock, resolve)
    headers, items = P.explode_order_payloads(write_payloads(spark, docs))
    res = W.w_order_intake(s, headers, items)
    got = {r.payload_id: r.accepted for r in res["outcome"].collect()}
    assert got == want
    after = {r.variant_id: r.stock for r in res["product_variants"].collect()}
    assert after == left
    users = {r.email: r for r in res["users"].collect()}
    assert users["a@x"].address == "Hue"          # non-blank value overwrites
    assert users["a@x"].phone is None             # blank keeps the old value
    guests = [e for e in users if e.startswith("guest_")]
    assert guests == ["guest_9@guest.local"] and users[guests[0]].name == "Khách hàng"
    assert {r.method for r in res["payments"].filter(F.col("order_id") > 0).collect()} == {"Bank"}


def test_order_intake_numbers_lines_only_when_wanted(spark):
    s = shop(spark)
    docs = [payload(1, [("1", "M", "Red", 3, 10.0), ("2", "S", "Red", 4, 1.0)]),
            payload(2, [("2", "S", "Red", 2, 1.0), ("2", "S", "Red", 1, 1.0)]),
            payload(3, [("2", "S", "Red", 3, 1.0)]), payload(4, [("2", "S", "Red", 2, 1.0)]),
            payload(5, [])]
    headers, items = P.explode_order_payloads(write_payloads(spark, docs))
    whole = W.w_order_intake(s, headers, items)
    assert {r.payload_id: r.reason for r in whole["outcome"].collect()} == {
        1: None, 2: "duplicate variant", 3: "insufficient stock", 4: None, 5: "invalid payload"}
    part = W.w_order_intake(s, headers, items, want=("product_variants",))
    assert "order_details" not in part
    for table, rows in part.items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, whole[table].collect()))


def test_allocation_takes_the_capacity_beside_the_lines(spark):
    rows = [(q, q, f"v{(q * k) % 7}", 1 + (q * k) % 4, 9) for q in range(1, 60) for k in (1, 2)]
    lines = spark.createDataFrame(rows, "req_id long, seq long, res string, qty int, cap int") \
        .dropDuplicates(["req_id", "res"])
    cap = lines.select("res", "cap").distinct()
    beside = allocate_in_order(lines, None, ["res"]).collect()
    apart = allocate_in_order(lines.drop("cap"), cap, ["res"]).collect()
    assert sorted(beside) == sorted(apart) and len({r.accepted for r in beside}) == 2


def test_customer_upsert_last_nonblank_wins(spark):
    s = shop(spark)
    h = spark.createDataFrame(
        [(1, "New", "n@x", "1", "", True), (2, "", "n@x", "", "Addr", True), (3, "Late", "N@x ", "", "", True)],
        "payload_id long, name string, email string, phone string, address string, has_customer boolean")
    res = W.w_customer_upsert(s, h)
    created = res["created"].collect()
    assert len(created) == 1
    r = created[0]
    assert (r.user_id, r.name, r.phone, r.address) == (4, "Late", "1", "Addr")
    assert {x.payload_id: x.user_id for x in res["payload_user"].collect()} == {1: 4, 2: 4, 3: 4}


def test_product_upsert_replaces_variants_and_cascades(spark):
    s = shop(spark, order_details=[(1, 1, 12, 1, D("1"))], cart_items=[(1, 1, 21, 1)], cart=[(1, 1)])
    p = spark.createDataFrame(
        [(1, 1, " Shoe A2 ", "d", D("10"), "Giày", "Adidas", "img/a", 7, "M, , 44,M"),
         (2, None, "New", None, D("5"), "", "", "", 3, ""),
         (3, None, "  ", None, D("5"), "", "", "", 3, ""),
         (4, 99, "Ghost", None, D("5"), "", "", "", 3, "")],
        "seq long, product_id long, name string, description string, price decimal(10,2), "
        "category string, brand string, image string, stock int, sizes string")
    res = W.w_product_upsert(s, p)
    out = {r.seq: (r.product_id, r.reason) for r in res["outcome"].collect()}
    assert out == {1: (1, None), 2: (5, None), 3: (None, "name required"), 4: (99, "product not found")}
    v = sorted((r.product_id, r.size_id, r.stock) for r in res["product_variants"].collect()
               if r.product_id in (1, 5))
    sizes = {r.size_id: r.name for r in res["sizes"].collect()}
    assert [(p_, sizes[sz], st) for p_, sz, st in v] == [(1, "M", 7), (1, "44", 0), (5, "Default", 3)]
    assert res["order_details"].count() == 0          # line of the replaced variant 12 cascades
    assert {r.name for r in res["brands"].collect()} == {"Nike", "Adidas"}
    assert res["product_images"].filter("product_id = 1").first().image_url == "img/a"


def test_user_update_rules(spark):
    s = shop(spark)
    u = spark.createDataFrame(
        [(1, 1, "A", "b@x", "", "", "user"), (2, 2, "B", "new@x", " 9 ", "", "admin"),
         (3, 3, "C", "c@x", "", "", "boss"), (4, 3, "C", "new@x", "", "", "user"),
         (5, 9, "Z", "z@x", "", "", "user"), (6, 1, "", "a@x", "", "", "user")],
        "seq long, user_id long, name string, email string, phone string, address string, role string")
    res = W.w_user_update(s, u)
    got = {r.seq: r.reason for r in res["outcome"].collect()}
    assert got == {1: "email exists", 2: None, 3: "invalid role", 4: "email exists",
                   5: "user not found", 6: "name required"}
    b = [r for r in res["users"].collect() if r.user_id == 2][0]
    assert (b.email, b.phone, b.address, b.role) == ("new@x", "9", None, "admin")


def test_order_status_update_sets_latest_payment_or_adds_one(spark):
    s = shop(spark, orders=[(1, 1, None, "Pending", D("1")), (2, 1, None, "Pending", D("1"))],
             payments=[(10, 1, "COD", "Pending"), (11, 1, "Bank", "Failed")])
    u = spark.createDataFrame([(1, 1, "completed", "PAID", "cod"), (2, 2, "weird", "x", "bank"),
                               (3, 7, "completed", "paid", "cod")],
                              "seq long, order_id long, order_status string, payment_status string, "
                              "payment_method string")
    res = W.w_order_status_update(s, u)
    assert {r.order_id: r.status for r in res["orders"].collect()} == {1: "Completed", 2: "Pending"}
    pays = {r.payment_id: (r.order_id, r.method, r.status) for r in res["payments"].collect()}
    assert pays == {10: (1, "COD", "Pending"), 11: (1, "Bank", "Paid"), 12: (2, "Bank", "Pending")}
    assert {r.seq: r.accepted for r in res["outcome"].collect()} == {1: True, 2: True, 3: False}


def test_order_only_and_payment_only_edits(spark):
    s = shop(spark, orders=[(1, 1, None, "Pending", D("1")), (2, 1, None, "Pending", D("1"))],
             payments=[(10, 1, "COD", "Pending")])
    u = spark.createDataFrame([(1, 1, "cancelled", None, None), (2, 2, None, "paid", "bank")],
                              "seq long, order_id long, order_status string, payment_status string, "
                              "payment_method string")
    res = W.w_order_status_update(s, u)
    assert {r.order_id: r.status for r in res["orders"].collect()} == {1: "Cancelled", 2: "Pending"}
    pays = {r.payment_id: (r.order_id, r.method, r.status) for r in res["payments"].collect()}
    assert pays == {10: (1, "COD", "Pending"), 11: (2, "Bank", "Paid")}


def test_payload_without_customer_or_items_is_rejected(spark):
    s = shop(spark)
    no_customer = payload(1, [("2", "S", "Red", 1, 1.0)])
    no_customer["customer"] = None
    no_items = payload(2, [])
    no_items["items"] = None
    ok = payload(3, [("2", "S", "Red", 1, 1.0)])
    headers, items = P.explode_order_payloads(write_payloads(spark, [no_customer, no_items, ok]))
    out = {r.payload_id: (r.accepted, r.reason) for r in W.w_order_intake(s, headers, items)["outcome"].collect()}
    assert out == {1: (False, "invalid payload"), 2: (False, "invalid payload"), 3: (True, None)}


def test_edits_of_one_order_merge_per_part(spark):
    s = shop(spark, orders=[(1, 1, None, "Pending", D("1"))], payments=[(10, 1, "COD", "Pending")])
    u = spark.createDataFrame([(1, 1, "completed", None, None), (2, 1, None, "paid", None)],
                              "seq long, order_id long, order_status string, payment_status string, "
                              "payment_method string")
    res = W.w_order_status_update(s, u)
    assert res["orders"].first().status == "Completed"
    assert res["payments"].first().status == "Paid"


def test_payload_with_a_variant_twice_or_part_of_a_piece_is_rejected(spark):
    s = shop(spark)
    twice = payload(1, [("2", "S", "Red", 1, 1.0), ("2", "S", "Red", 1, 1.0)])
    half = payload(2, [("2", "S", "Red", 0.5, 1.0)])
    headers, items = P.explode_order_payloads(write_payloads(spark, [twice, half]))
    out = {r.payload_id: r.reason for r in W.w_order_intake(s, headers, items)["outcome"].collect()}
    assert out == {1: "duplicate variant", 2: "invalid item"}
