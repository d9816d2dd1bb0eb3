"""Cross-checks between operators."""

from pyspark.sql import functions as F

from vitrine.operators import changes as C
from vitrine.operators import reports as R
from vitrine.operators import views as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_order_tracking_is_the_summary_without_contacts(shop_mid):
    summary = V.v_order_summary(shop_mid).drop("email", "phone")
    tracking = V.v_customer_order_tracking(shop_mid)
    assert rows(tracking.select(*summary.columns)) == rows(summary)


def test_units_per_product_add_up_to_known_lines(shop_mid):
    total = R.q17_units_per_product(shop_mid).agg(F.sum("total_sold")).first()[0]
    known = (shop_mid.order_details.join(shop_mid.product_variants.select("variant_id"), "variant_id")
             .agg(F.sum("quantity")).first()[0])
    assert total == known


def test_recomputed_totals_equal_line_totals(shop_mid):
    lines = shop_mid.order_details
    totals = C.t_order_total_recompute(lines, lines, lines.limit(0))
    item = (V.v_order_item_detail(shop_mid).groupBy("order_id")
            .agg(F.sum("line_total").cast("decimal(38,2)").alias("total_amount")))
    # Orders whose every line names a known variant appear in full in the item view.
    orphan = lines.join(shop_mid.product_variants.select("variant_id"), "variant_id", "left_anti") \
        .select("order_id").distinct()
    full = totals.join(orphan, "order_id", "left_anti")
    assert rows(full) == rows(item.join(orphan, "order_id", "left_anti"))
