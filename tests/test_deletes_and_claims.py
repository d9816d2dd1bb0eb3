"""Product deletes against the declared cascade, name claims against a sequential replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitrine.model import TABLES
from vitrine.operators import audits as A
from vitrine.operators import deletes as DL
from vitrine.operators import writes as W
from vitrine.plans.claims import decide_claims
from vitrine.sources.tables import load_seed

from .seed_fixture import seed_rows


@pytest.fixture(scope="module")
def seed(spark):
    return load_seed(spark, seed_rows(), as_of=dt.datetime(2026, 4, 15))


def _brute_delete(tables: dict, keys: dict, table: str, gone: list) -> None:
    """Row-by-row delete over plain dicts."""
    for row in gone:
        if row not in tables[table]:
            continue
        tables[table].remove(row)
        for child, col, parent, pcol, action in A.FOREIGN_KEYS:
            if parent != table:
                continue
            hits = [r for r in tables[child] if r[col] == row[pcol]]
            if action == "cascade":
                _brute_delete(tables, keys, child, hits)
            elif action == "set null":
                for r in hits:
                    r[col] = None


def _dicts(df):
    return [r.asDict() for r in df.collect()]


def _sorted(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


@pytest.mark.parametrize("table,ids", [("brands", [1, 3, 99]), ("products", [2, 7]), ("users", [1, 2]),
                                       ("orders", [4]), ("sales", [1]), ("categories", [])])
def test_cascade_equals_row_by_row_deletes(spark, seed, table, ids):
    key = A.PRIMARY_KEYS[table][0]
    after = DL.apply_delete(seed, {table: spark.createDataFrame([(i,) for i in ids], f"{key} long")})
    tables = {t: _dicts(getattr(seed, t)) for t in TABLES}
    _brute_delete(tables, A.PRIMARY_KEYS, table, [r for r in tables[table] if r[key] in ids])
    for t in TABLES:
        assert _sorted(_dicts(after.get(t, getattr(seed, t)))) == _sorted(tables[t]), t
    assert set(after) >= {table}


def test_settling_order_refuses_cycles():
    edges = [("a", "x", "b", "y", "cascade"), ("b", "x", "a", "y", "cascade")]
    with pytest.raises(ValueError):
        DL.settling_order(edges)
    order = DL.settling_order(A.FOREIGN_KEYS)
    assert all(order.index(parent) < order.index(child) for child, _, parent, _, _ in A.FOREIGN_KEYS)


def test_product_delete_rules(spark, seed):
    requests = spark.createDataFrame(
        [(1, 1), (2, 18), (3, 18), (4, 999), (5, None), (6, 0), (7, 17), (8, 1)], "seq long, product_id long")
    res = DL.w_product_delete(seed, requests)
    got = {r.seq: (r.accepted, r.reason) for r in res["outcome"].collect()}
    sold = {r.product_id for r in seed.order_details.join(seed.product_variants, "variant_id").collect()}
    assert 1 in sold and not {17, 18} & sold
    assert got == {1: (False, "product was sold"), 2: (True, None), 3: (False, "product not found"),
                   4: (False, "product not found"), 5: (False, "invalid id"), 6: (False, "invalid id"),
                   7: (True, None), 8: (False, "product was sold")}
    for t in ("products", "product_variants", "product_images", "product_sales", "reviews"):
        left = {r.product_id for r in res[t].collect()}
        assert left == {r.product_id for r in getattr(seed, t).collect()} - {17, 18}
    assert res["order_details"].count() == seed.order_details.count()


def test_deleting_nothing_changes_nothing(spark, seed):
    res = DL.w_product_delete(seed, spark.createDataFrame([], "seq long, product_id long"))
    assert res["outcome"].count() == 0
    assert _sorted(_dicts(res["products"])) == _sorted(_dicts(seed.products))


# ------------------------------------------------------------------------ claims

def _one_by_one(claims, held):
    has = dict(held)
    out = {}
    for seq, holder, name in sorted(claims):
        out[seq] = all(n != name or h == holder for h, n in has.items())
        if out[seq]:
            has[holder] = name
    return out


@pytest.mark.parametrize("seed_no,slice_claims", [(1, 200_000), (2, 7), (3, 1)])
def test_claims_equal_a_sequential_replay(spark, seed_no, slice_claims):
    rng = random.Random(seed_no)
    users = list(range(40))
    held = [(u, f"m{u}") for u in users] + [(100 + u, f"s{u}") for u in range(5)]
    held += [(200, "twice"), (201, "twice")]
    count = 120 if slice_claims > 1 else 14
    names = [f"m{k}" for k in range(45)] + ["hot"] * 15 + ["s1", "s2", "twice", "new1", "new2"]
    claims = [(s, rng.choice([*users, 200, 201, 300]), rng.choice(names))
              for s in rng.sample(range(10_000), count)]
    got = decide_claims(spark.createDataFrame(claims, "seq long, holder long, name string").repartition(5),
                        spark.createDataFrame(held, "holder long, name string"), slice_claims)
    assert {r.seq: r.ok for r in got.collect()} == _one_by_one(claims, held)


def test_no_claims(spark):
    got = decide_claims(spark.createDataFrame([], "seq long, holder long, name string"),
                        spark.createDataFrame([(1, "a")], "holder long, name string"))
    assert got.count() == 0


def test_user_edits_free_and_take_addresses_in_order(spark):
    users = [(k, f"u{k}", f"{c}@x", None, None, "user", None) for k, c in ((1, "a"), (2, "b"), (3, "c"))]
    shop = load_seed(spark, {"users": users})
    cols = "seq long, user_id long, name string, email string, phone string, address string, role string"

    def edits(*rows):
        return spark.createDataFrame([(s, u, "N", e, "", "", "user") for s, u, e in rows], cols)

    res = W.w_user_update(shop, edits((1, 1, "b@x"), (2, 2, "new@x"), (3, 1, "B@x "), (4, 3, "a@x"),
                                      (5, 2, "a@x"), (6, 2, "c@x")))
    assert {r.seq: r.accepted for r in res["outcome"].collect()} == {
        1: False, 2: True, 3: True, 4: True, 5: False, 6: True}
    assert {r.user_id: r.email for r in res["users"].collect()} == {1: "B@x", 2: "c@x", 3: "a@x"}
    assert res["users"].filter(F.col("name") == "N").count() == 3


def test_small_components_of_claims_share_tasks(spark, monkeypatch):
    from vitrine.plans import claims as C
    calls = spark.sparkContext.accumulator(0)
    inner = C._replay_group

    def counted(key: tuple, claims, held):
        calls.add(1)
        return inner(key, claims, held)

    monkeypatch.setattr(C, "_replay_group", counted)
    claims = spark.range(300).selectExpr("id as seq", "id as holder", "concat('n', id) as name")
    held = spark.range(300).selectExpr("id as holder", "concat('h', id) as name")
    assert [r.ok for r in decide_claims(claims, held).collect()] == [True] * 300
    assert 1 <= calls.value <= 16
