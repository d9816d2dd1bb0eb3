"""The shop's seed data (FIXTURES F1) as literal rows.

Fixed values, transcribed in their original order (identity keys = row
position). Two deliberate differences: the admin account's e-mail is a neutral
placeholder, and image URLs are generated by a rule (two per product) because
no golden depends on them.
"""

import datetime as dt
from decimal import Decimal as D

# ---- fixed values -----------------------------------------------------------
BRANDS = ["Nike", "Adidas", "Puma", "Reebok", "Under Armour"]
CATEGORIES = ["Áo bóng đá", "Áo gym", "Quần short", "Quần dài thể thao", "Giày chạy bộ",
              "Áo khoác thể thao"]
COLORS = [("Đen", "#000000"), ("Trắng", "#FFFFFF"), ("Đỏ", "#FF0000"), ("Xanh dương", "#0000FF"),
          ("Xanh lá", "#00FF00"), ("Xám", "#808080")]
SIZES = ["S", "M", "L", "XL", "XXL", "40", "41", "42", "43", "44", "45"]
USERS = [
    ("Nguyễn Văn A", "a@gmail.com", "0901111111", "Hà Nội"),
    ("Trần Thị B", "b@gmail.com", "0901111112", "Hà Nội"),
    ("Lê Văn C", "c@gmail.com", "0901111113", "Hồ Chí Minh"),
    ("Phạm Văn D", "d@gmail.com", "0901111114", "Đà Nẵng"),
    ("Hoàng Văn E", "e@gmail.com", "0901111115", "Hải Phòng"),
    ("Nguyễn Văn F", "f@gmail.com", "0901111116", "Hà Nội"),
    ("Trần Văn G", "g@gmail.com", "0901111117", "Hồ Chí Minh"),
    ("Lê Thị H", "h@gmail.com", "0901111118", "Cần Thơ"),
    ("Phạm Thị I", "i@gmail.com", "0901111119", "Huế"),
    ("Võ Văn K", "k@gmail.com", "0901111120", "Hà Nội"),
    ("Đặng Văn L", "l@gmail.com", "0901111121", "Hải Dương"),
    ("Bùi Văn M", "m@gmail.com", "0901111122", "Nghệ An"),
    ("Đỗ Văn N", "n@gmail.com", "0901111123", "Hà Nội"),
    ("Ngô Văn O", "o@gmail.com", "0901111124", "Hồ Chí Minh"),
    ("Huỳnh Văn P", "p@gmail.com", "0901111125", "Bình Dương"),
    ("Admin", "admin@example.com", "0900000000", "Hà Nội"),
]
ADMIN_EMAIL = "admin@example.com"
PRODUCTS = [  # name, description, brand_id, category_id
    ("Áo đá banh Nike 2024", "Áo bóng đá thoáng khí", 1, 1),
    ("Áo gym Adidas Pro", "Áo tập gym co giãn tốt", 2, 2),
    ("Quần short Puma Run", "Quần chạy bộ nhẹ", 3, 3),
    ("Giày chạy Adidas Ultraboost", "Giày chạy cao cấp", 2, 5),
    ("Áo khoác Nike Windrunner", "Áo khoác chống gió", 1, 6),
    ("Quần dài Reebok Training", "Quần tập luyện", 4, 4),
    ("Áo gym Under Armour HeatGear", "Áo thể thao ôm sát", 5, 2),
    ("Giày chạy Puma Velocity", "Giày chạy nhẹ", 3, 5),
    ("Áo bóng đá Adidas Real Madrid", "Áo CLB Real Madrid", 2, 1),
    ("Quần short Nike Flex", "Quần short linh hoạt", 1, 3),
    ("Áo khoác Puma Sport", "Áo khoác thể thao", 3, 6),
    ("Giày Reebok Nano", "Giày training gym", 4, 5),
    ("Áo bóng đá Puma Future 2026", "Áo bóng đá thoáng khí, thiết kế trẻ trung", 3, 1),
    ("Áo gym Nike Dri-FIT Elite", "Áo gym thấm hút mồ hôi, co giãn tốt", 1, 2),
    ("Quần short Adidas Runner", "Quần short chạy bộ nhẹ, thoải mái khi vận động", 2, 3),
    ("Giày chạy Nike Air Zoom", "Giày chạy bộ đệm êm, hỗ trợ bám đường tốt", 1, 5),
    ("Áo khoác Under Armour Storm", "Áo khoác thể thao chống gió, chống nước nhẹ", 5, 6),
    ("Quần dài Puma Training Pro", "Quần dài thể thao mềm mại, phù hợp tập luyện", 3, 4),
]
VARIANTS = [  # product_id, size_id, color_id, price, stock
    (1, 1, 1, 450000, 20), (1, 2, 2, 450000, 25), (1, 3, 3, 450000, 15),
    (2, 1, 1, 350000, 30), (2, 2, 4, 350000, 35), (2, 3, 2, 350000, 40),
    (3, 2, 1, 280000, 50), (3, 3, 2, 280000, 45), (3, 4, 6, 280000, 20),
    (4, 7, 1, 2500000, 10), (4, 8, 1, 2500000, 8), (4, 9, 3, 2500000, 5),
    (5, 1, 1, 900000, 12), (5, 2, 1, 900000, 18),
    (6, 2, 6, 400000, 25), (6, 3, 2, 400000, 20),
    (7, 1, 2, 320000, 30), (7, 2, 3, 320000, 28),
    (8, 9, 1, 1500000, 15), (8, 10, 2, 1500000, 10),
    (9, 2, 3, 500000, 22), (9, 3, 1, 500000, 18),
    (10, 1, 5, 300000, 40), (10, 2, 6, 300000, 35),
    (11, 3, 1, 600000, 20), (11, 4, 1, 600000, 15),
    (12, 7, 2, 1200000, 12), (12, 9, 3, 1200000, 10),
    (13, 1, 3, 480000, 20), (13, 2, 2, 480000, 25), (13, 3, 4, 480000, 18),
    (14, 1, 1, 390000, 30), (14, 2, 3, 390000, 28), (14, 3, 2, 390000, 22),
    (15, 2, 1, 310000, 35), (15, 3, 6, 310000, 30), (15, 4, 2, 310000, 20),
    (16, 6, 1, 2200000, 12), (16, 8, 1, 2200000, 10), (16, 10, 4, 2200000, 8),
    (17, 2, 1, 950000, 15), (17, 3, 6, 950000, 12), (17, 4, 2, 950000, 10),
    (18, 2, 1, 420000, 25), (18, 3, 5, 420000, 20), (18, 4, 6, 420000, 18),
]
SALES = [("Black Friday", 30, "2026-04-01", "2026-04-30"), ("Summer Sale", 20, "2026-05-01", "2026-05-31"),
         ("Flash Sale", 10, "2026-04-10", "2026-04-20")]
PRODUCT_SALES = [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 3), (8, 3), (9, 3)]
CARTS = [1, 2, 3, 4, 5]
CART_ITEMS = [(1, 1, 2), (1, 3, 1), (2, 5, 1), (3, 10, 2), (4, 15, 1), (5, 20, 3)]
ORDERS = [(1, "Pending", 900000), (2, "Completed", 700000), (3, "Shipping", 2500000),
          (4, "Confirmed", 600000), (5, "Cancelled", 300000)]
ORDER_DETAILS = [(1, 1, 2, 450000), (2, 2, 2, 350000), (3, 4, 1, 2500000), (4, 6, 1, 600000),
                 (5, 10, 1, 300000)]
PAYMENTS = [(1, "COD", "Paid"), (2, "COD", "Paid"), (3, "Bank", "Pending"), (4, "COD", "Paid"),
            (5, "Bank", "Failed")]
SHIPPING = [(1, "Hà Nội", "Preparing"), (2, "Hồ Chí Minh", "Delivered"), (3, "Đà Nẵng", "Shipping"),
            (4, "Hải Phòng", "Pending"), (5, "Huế", "Cancelled")]
REVIEWS = [(1, 1, 5, "Áo đẹp, chất lượng tốt"), (2, 2, 4, "Ok, mặc thoải mái"),
           (3, 3, 5, "Rất đáng tiền"), (4, 4, 5, "Giày chạy rất êm"), (5, 5, 3, "Bình thường")]
# -----------------------------------------------------------------------------

LOADED = dt.datetime(2026, 4, 1, 9, 0, 0)


def _day(s):
    return dt.datetime.strptime(s, "%Y-%m-%d")


def seed_rows() -> dict:
    ids = lambda rows: enumerate(rows, start=1)  # noqa: E731 - identity keys
    return {
        "users": [(i, n, e, p, a, "admin" if e == ADMIN_EMAIL else "user", LOADED)
                  for i, (n, e, p, a) in ids(USERS)],
        "brands": [(i, n) for i, n in ids(BRANDS)],
        "categories": [(i, n) for i, n in ids(CATEGORIES)],
        "colors": [(i, n, h) for i, (n, h) in ids(COLORS)],
        "sizes": [(i, n) for i, n in ids(SIZES)],
        "products": [(i, n, d, b, c, LOADED) for i, (n, d, b, c) in ids(PRODUCTS)],
        "product_variants": [(i, p, s, c, D(pr), st, LOADED) for i, (p, s, c, pr, st) in ids(VARIANTS)],
        "sales": [(i, n, d, _day(a), _day(b)) for i, (n, d, a, b) in ids(SALES)],
        "product_sales": list(PRODUCT_SALES),
        "product_images": [((p - 1) * 2 + k, p, f"img/p{p}-{k}.jpg")
                           for p in range(1, len(PRODUCTS) + 1) for k in (1, 2)],
        "cart": [(i, u) for i, u in ids(CARTS)],
        "cart_items": [(i, c, v, q) for i, (c, v, q) in ids(CART_ITEMS)],
        "orders": [(i, u, LOADED, s, D(t)) for i, (u, s, t) in ids(ORDERS)],
        "order_details": [(i, o, v, q, D(p)) for i, (o, v, q, p) in ids(ORDER_DETAILS)],
        "payments": [(i, o, m, s) for i, (o, m, s) in ids(PAYMENTS)],
        "shipping": [(i, o, a, s) for i, (o, a, s) in ids(SHIPPING)],
        "reviews": [(i, u, p, r, c, LOADED) for i, (u, p, r, c) in ids(REVIEWS)],
    }
