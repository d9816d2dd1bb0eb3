"""Oracle SQL (DuckDB) for sources and sinks."""

from __future__ import annotations

from ..model import TABLES
from . import with_shop
from .documents import oracle as documents_oracle
from .writes import HEADERS


def oracle() -> dict[str, str]:
    q = {}
    body = "\nUNION ALL\n".join(f"SELECT '{t}' AS tbl, count(*) AS n_rows FROM shop_{t}" for t in TABLES)
    q["src_tables"] = with_shop(list(TABLES), body)
    q["snk_documents"] = documents_oracle()["api_product_document"]
    q["src_order_payloads"] = f"""WITH headers AS ({HEADERS}),
n AS (SELECT l_orderkey AS payload_id, count(*) AS n_items FROM lineitem GROUP BY l_orderkey)
SELECT h.payload_id, h.name, h.email, h.phone, h.address, coalesce(n.n_items, 0) AS n_items
FROM headers h LEFT JOIN n ON n.payload_id = h.payload_id"""
    return q
