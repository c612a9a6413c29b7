"""The ladder against a naive loop that searches one request at a time."""

from larder import schemas
from larder.catalog import empty_catalog
from larder.operators.lineage import cut
from larder.plans.recommend import recommend

PLACES = [
    # id, name, district, price, rating, categories, dishes (name, attribute)
    ("p1", "pho ha noi", "Quận 1", 1, 4.5, ["noodle"], [("pho bo", "hot")]),
    ("p2", "com tam", "Quận 1", None, 4.8, ["rice"], [("com suon", "sweet")]),
    ("p3", "bun cha", "Quận 3", 2, None, ["bun"], [("bun cha", None)]),
    ("p4", "kem mat", "Quận 12", 2, 3.9, ["dessert"], [("kem", "cool")]),
    ("p5", "lau bo", "Quận 5", 3, 4.1, [], [("lau bo", "hot"), ("bo", "spicy")]),
]
ATTRIBUTES = {"hot": "nong", "sweet": "ngot", "cool": "mat", "spicy": "cay"}


def catalog(spark):
    base = empty_catalog(spark)

    def table(name, columns, rows):
        schema = base.tables()[name].schema
        frame = spark.createDataFrame(rows, ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in columns))
        return base.tables()[name].unionByName(frame, allowMissingColumns=True)

    from datetime import datetime
    from decimal import Decimal

    at = datetime(2024, 1, 1)
    slugs = ["noodle", "rice", "bun", "dessert"]
    dishes = [(f"{p[0]}-{i}", p[0], name, name, "available", attribute) for p in PLACES for i, (name, attribute) in enumerate(p[6])]
    return base.with_tables(
        place=cut(table("place", ["id", "name", "normalized_name", "location_id", "price_level", "rating", "status", "updated_at"],
                        [(p[0], p[1], p[1], p[0], p[3], Decimal(str(p[4])) if p[4] else None, "active", at) for p in PLACES])),
        location=cut(table("location", ["id", "district", "city"], [(p[0], p[2], "HCM") for p in PLACES])),
        category=cut(table("category", ["id", "name", "slug", "is_active"], [(s, s.title(), s, True) for s in slugs])),
        place_category=cut(table("place_category", ["place_id", "category_id"], [(p[0], c) for p in PLACES for c in p[5]])),
        dish=cut(table("dish", ["id", "place_id", "name", "normalized_name", "status"], [d[:5] for d in dishes])),
        food_attribute=cut(table("food_attribute", ["id", "code", "name", "normalized", "is_active"], [(k, k, k, v, True) for k, v in ATTRIBUTES.items()])),
        dish_attribute=cut(table("dish_attribute", ["dish_id", "attribute_id"], [(d[0], d[5]) for d in dishes if d[5]])),
    )


REQUESTS = [
    # id, query, explicit filters, what the rules make of it: text, category, district, tastes
    ("direct", "phở", {}, ("pho", "noodle", None, [])),
    ("no_text", "unknown dish", {}, ("unknown dish", None, None, [])),
    ("district", "bún quận 12", {}, ("bun", "bun", "Quận 12", [])),
    ("keep", "kem", {"area": "Quận 1"}, ("kem", "dessert", "Quận 1", [])),
    ("taste", "nóng", {}, (None, None, None, ["nong"])),
    ("rating", "phở", {"min_rating": 4.9}, ("pho", "noodle", None, [])),
    ("weather", "trời đang nóng", {}, (None, None, None, ["mat"])),
]


def listed(text, category, district, tastes, price, rating, limit, by_rating=False):
    def matches(p):
        texts = [p[1]] + [d[0] for d in p[6]]
        terms = [t for t in (text or "").split() if len(t) >= 2]
        text_ok = text is None or any(n in t for t in texts for n in [text, *terms])
        taste_ok = all(any(ATTRIBUTES.get(a) == t or t in n for n, a in p[6]) for t in tastes)
        return (text_ok and taste_ok and (category is None or category in p[5]) and (district is None or district in p[2])
                and (price is None or p[3] == price) and (rating is None or (p[4] is not None and p[4] >= rating)))

    return {p[0] for p in PLACES if matches(p)}


def naive(request):
    _, _, explicit, (text, category, district, tastes) = request
    state = dict(text=text, category=category, district=district, tastes=tastes, price=explicit.get("price_level"), rating=explicit.get("min_rating"), limit=10)
    page, rung = listed(**state), 0
    if not page and state["district"] and "area" not in explicit:
        state["district"] = None
        page, rung = listed(**state), 1
    if not page and state["text"] and state["category"]:
        state["category"] = None
        page, rung = listed(**state), 5
    if not page and state["text"]:
        state["text"] = None
        page, rung = listed(**state), 6
    if not page:
        state["text"] = None
        page, rung = listed(**state), 8
    return rung, page


def test_ladder_equals_the_naive_loop(spark):
    rows = [(i, q, e.get("area"), e.get("min_rating")) for i, q, e, _ in REQUESTS]
    requests = spark.createDataFrame(rows, "request_id string, query string, area string, min_rating double")
    got = {}
    explanations = {}
    for r in recommend(requests, catalog(spark)).collect():
        got.setdefault(r.request_id, (r.rung, set()))[1].add(r.place_id)
        explanations[r.request_id] = r.explanation
    want = {r[0]: naive(r) for r in REQUESTS}
    assert got == {k: v for k, v in want.items() if v[1]}
    assert explanations["direct"] == "Phù hợp với nhóm noodle."
    assert explanations["taste"] == "Phù hợp với khẩu vị nóng."
