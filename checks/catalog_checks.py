"""Conditions, lookups, aggregates, listings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import duck, views
from checks.harness import check
from larder.functions import geo
from larder.functions import text as tx
from larder.operators import lookups
from larder.operators.dealt_join import dealt_join
from larder.operators.topk import top_rows
from larder.plans import audit, detail, documents, listings, refresh, reports


def cat(spark, sf, *names):
    return views.catalog(spark, sf, *names)


def epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def names(column: str, separator: str = ","):
    return F.array_join(F.col(column), separator)


# --- row conditions ----------------------------------------------------------------


@check("F1_active_places", views.duck("place") + "SELECT id, name, rating FROM place WHERE status = 'active'")
def active_places(spark, sf):
    return lookups.active_places(views.frame(spark, sf, "place")).select("id", "name", "rating")


@check("F8_min_rating", views.duck("place") + "SELECT id, rating FROM place WHERE rating >= 3.5")
def min_rating(spark, sf):
    return views.frame(spark, sf, "place").filter(F.col("rating") >= 3.5).select("id", "rating")


@check("F9_price_level", views.duck("place") + "SELECT id, price_level FROM place WHERE price_level = 2")
def price_level(spark, sf):
    return views.frame(spark, sf, "place").filter(F.col("price_level") == 2).select("id", "price_level")


@check(
    "F11_open_now",
    views.duck("hours")
    + """SELECT DISTINCT place_id FROM hours WHERE day_of_week = 3 AND NOT is_closed
  AND CASE WHEN spans_next_day THEN 810 >= opens_min OR 810 <= closes_min ELSE 810 BETWEEN opens_min AND closes_min END""",
)
def open_now(spark, sf):
    moment = spark.range(1).select(F.lit(3).alias("day_of_week"), F.lit(810.0).alias("minute"))
    return lookups.open_at(views.frame(spark, sf, "hours"), moment).select("place_id")


@check(
    "F12_keyset",
    views.duck("place")
    + f"""SELECT id, {duck.epoch('updated_at')} AS updated FROM place, (SELECT updated_at AS t, id AS i FROM place WHERE id = 77) k
  WHERE status = 'active' AND (updated_at, id) < (t, i)""",
)
def keyset(spark, sf):
    place = lookups.active_places(views.frame(spark, sf, "place"))
    key = views.frame(spark, sf, "place").filter("id = 77").select(F.col("updated_at").alias("t"), F.col("id").alias("i"))
    below = F.struct(F.col("updated_at").alias("t"), F.col("id").alias("i")) < F.struct("t", "i")
    return place.join(F.broadcast(key)).filter(below).select("id", epoch("updated_at").alias("updated"))


@check(
    "F19_visible_reviews",
    views.duck("review") + "SELECT id, place_id FROM review WHERE is_visible AND content IS NOT NULL AND length(trim(content)) > 0",
)
def visible_reviews(spark, sf):
    return lookups.visible_reviews(views.frame(spark, sf, "review")).select("id", "place_id")


@check(
    "F20_available_children",
    views.duck("dish", "image")
    + """SELECT 'dish' AS kind, id FROM dish WHERE status = 'available' UNION ALL SELECT 'image', id FROM image WHERE status = 'active'""",
)
def available_children(spark, sf):
    c = cat(spark, sf, "dish", "image")
    dishes = lookups.available_dishes(c.dish).select(F.lit("dish").alias("kind"), "id")
    return dishes.unionByName(lookups.active_images(c.image).select(F.lit("image").alias("kind"), "id"))


@check(
    "F21_map_window",
    views.duck("location") + "SELECT id, round(lat, 4) AS lat, round(lon, 4) AS lon FROM location WHERE lat BETWEEN 10.55 AND 11.25 AND lon BETWEEN 106.25 AND 107.05",
)
def map_window(spark, sf):
    inside = listings.in_map_window(views.frame(spark, sf, "location"))
    return inside.select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@check(
    "F23_summary",
    views.duck("place", "location", "request")
    + f"""SELECT request_id, place.id AS place_id, formatted_address, round({duck.distance('lat', 'lon', 'latitude', 'longitude')} / 100) / 10 AS distance_km
  FROM request JOIN place ON place.id % 50 = request_id % 50 JOIN location ON location.id = location_id WHERE latitude IS NOT NULL AND lat IS NOT NULL""",
)
def summary(spark, sf):
    c = cat(spark, sf, "place", "location")
    asked = views.frame(spark, sf, "request").filter("latitude is not null").select(
        "request_id", "latitude", "longitude", (F.col("request_id") % 50).alias("k")
    )
    rows = c.place.select(F.col("id").alias("place_id"), "location_id").join(
        c.location.select(F.col("id").alias("location_id"), "formatted_address", "lat", "lon").filter("lat is not null"), "location_id"
    )
    away = geo.distance(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    return dealt_join(rows.withColumn("k", F.col("place_id") % 50), asked, ["k"]).select(
        "request_id", "place_id", "formatted_address", (F.round(away / 100) / 10).alias("distance_km")
    )


@check(
    "F24_retry_targets",
    views.duck("processing_record", "crawl_run", "data_source")
    + """SELECT p.id AS processing_record_id, p.external_id, p.attempt_count, c.target, code AS provider_code
  FROM processing_record p JOIN crawl_run c ON c.id = p.crawl_run_id JOIN data_source d ON d.id = c.data_source_id
  WHERE p.status IN ('failed', 'skipped') AND p.attempt_count < 5 AND c.job_type = 'discovery' AND d.is_active""",
)
def retry_targets(spark, sf):
    rows = reports.retry_targets(cat(spark, sf, "processing_record", "crawl_run", "data_source"))
    return rows.select("processing_record_id", "external_id", "attempt_count", "target", "provider_code")


# --- joins and lookups ---------------------------------------------------------------


@check(
    "J1_place_location",
    views.duck("place", "location")
    + "SELECT place.id, name, district, city FROM place JOIN location ON location.id = location_id WHERE status = 'active'",
)
def place_location(spark, sf):
    facts = lookups.place_facts(cat(spark, sf, "place", "location", "category", "place_category"))
    return facts.select(F.col("place_id").alias("id"), "name", "district", "city")


@check(
    "A1_category_sets",
    views.duck("place_category", "category") + f", {duck.CATEGORY_SETS} SELECT place_id, categories FROM category_set",
)
def category_sets(spark, sf):
    sets = lookups.category_sets(cat(spark, sf, "place_category", "category"))
    joined = F.array_join(F.transform("categories", lambda c: F.concat_ws(":", c["name"], c["slug"])), ",")
    return sets.select("place_id", joined.alias("categories"))


@check("J3_cover_images", views.duck("image") + f", {duck.COVER} SELECT * FROM cover")
def cover_images(spark, sf):
    return lookups.cover_images(views.frame(spark, sf, "image"))


@check("J4_source_urls", views.duck("place_source", "data_source") + f", {duck.SOURCE_URL} SELECT * FROM source_link")
def source_urls(spark, sf):
    return lookups.source_urls(cat(spark, sf, "place_source", "data_source"))


@check(
    "J6_gap_places",
    views.duck("place", "place_category", "dish")
    + """SELECT id, NOT EXISTS (SELECT 1 FROM place_category c WHERE c.place_id = place.id) AS no_category,
      NOT EXISTS (SELECT 1 FROM dish d WHERE d.place_id = place.id) AS no_dish FROM place WHERE status = 'active'""",
)
def gap_places(spark, sf):
    c = cat(spark, sf, "place", "place_category", "dish")
    place = lookups.active_places(c.place).select("id")
    for child, flag in ((c.place_category, "no_category"), (c.dish, "no_dish")):
        present = child.select(F.col("place_id").alias("id")).distinct().withColumn("_p", F.lit(True))
        place = place.join(present, "id", "left").withColumn(flag, F.col("_p").isNull()).drop("_p")
    return place


@check(
    "J10_category_parents",
    views.duck("category") + "SELECT c.slug, p.slug AS parent_slug FROM category c LEFT JOIN category p ON p.id = c.parent_id",
)
def category_parents(spark, sf):
    category = views.frame(spark, sf, "category")
    parent = category.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return category.join(parent, "parent_id", "left").select("slug", "parent_slug")


@check(
    "J12_latest_vectors",
    views.duck("vector")
    + """SELECT place_id, model, content_hash, round(embedding[1], 5) AS head FROM (
  SELECT *, row_number() OVER (PARTITION BY place_id, model ORDER BY created_at DESC, id DESC) AS rn FROM vector) WHERE rn = 1""",
)
def latest_vectors(spark, sf):
    rows = lookups.latest_vectors(views.frame(spark, sf, "vector"))
    return rows.select("place_id", "model", "content_hash", F.round(F.get("embedding", F.lit(0)), 5).alias("head"))


# --- aggregates, windows, orders ---------------------------------------------------------


@check(
    "A4_saved_counts",
    views.duck("saved", "place")
    + """SELECT user_id, count(*) AS total_count, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages
  FROM saved JOIN place ON place.id = place_id WHERE status = 'active' GROUP BY user_id""",
)
def saved_counts(spark, sf):
    return listings.saved_counts(views.frame(spark, sf, "saved"), cat(spark, sf, "place"))


@check(
    "A7_active_model",
    views.duck("vector")
    + f"SELECT model, {duck.epoch('max(created_at)')} AS newest FROM vector GROUP BY model ORDER BY max(created_at) DESC, min(CAST(id AS STRING)) DESC LIMIT 1",
)
def active_model(spark, sf):
    return documents.active_model(views.frame(spark, sf, "vector")).select("model", epoch("newest").alias("newest"))


@check(
    "A10_visible_review_counts",
    views.duck("review")
    + "SELECT place_source_id, count(*) FILTER (WHERE is_visible IS NOT FALSE) AS visible_reviews FROM review GROUP BY place_source_id",
)
def visible_review_counts(spark, sf):
    return refresh.visible_review_counts(views.frame(spark, sf, "review"))


@check(
    "A13_run_counters",
    views.duck("processing_record")
    + """SELECT crawl_run_id, count(*) AS records_found, count(*) FILTER (WHERE status = 'completed') AS records_processed,
  count(*) FILTER (WHERE status = 'failed') AS records_failed FROM processing_record GROUP BY crawl_run_id""",
)
def run_counters(spark, sf):
    return reports.run_counters(views.frame(spark, sf, "processing_record"))


@check(
    "A14_vector_sizes",
    views.duck("vector")
    + """SELECT model, dimension, count(*) AS vectors, CAST(sum(CASE WHEN len(embedding) <> dimension THEN 1 ELSE 0 END) AS BIGINT) AS odd
  FROM vector JOIN (SELECT model, max(len(embedding)) AS dimension FROM vector GROUP BY model) USING (model) GROUP BY model, dimension""",
)
def vector_sizes(spark, sf):
    return audit.vector_sizes(views.frame(spark, sf, "vector"))


@check(
    "W2_newest_reviews",
    views.duck("review")
    + """SELECT place_id, string_agg(t, ' # ' ORDER BY rn) AS reviews FROM (
  SELECT place_id, CASE WHEN len(content) > 110 THEN left(content, 110) || '…' ELSE content END AS t,
    row_number() OVER (PARTITION BY place_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn
  FROM review WHERE content IS NOT NULL AND is_visible IS NOT FALSE) WHERE rn <= 4 GROUP BY place_id""",
)
def newest_reviews(spark, sf):
    rows = documents.review_excerpts(views.frame(spark, sf, "review"))
    return rows.select("place_id", names("reviews", " # ").alias("reviews"))


@check(
    "W3_first_dishes",
    views.duck("dish")
    + """SELECT place_id, id, name, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS rn
  FROM dish WHERE status = 'available' AND length(trim(name)) > 0) WHERE rn <= 6""",
)
def first_dishes(spark, sf):
    return documents.first_dishes(views.frame(spark, sf, "dish")).select("place_id", "id", "name", "rank")


@check(
    "W4_detail_reviews",
    views.duck("review")
    + """SELECT place_id, id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn
  FROM review WHERE is_visible AND content IS NOT NULL AND length(trim(content)) > 0) WHERE rn <= 20""",
)
def detail_reviews(spark, sf):
    return detail.newest_reviews(views.frame(spark, sf, "review")).select("place_id", "id", "rank")


_RANK = "SELECT district, place_id, rank FROM (SELECT district, place.id AS place_id, row_number() OVER (PARTITION BY district ORDER BY {order}) AS rank FROM place JOIN location ON location.id = location_id WHERE status = 'active') WHERE rank <= 30"


@check("T2_T14_trending", views.duck("place", "location") + _RANK.format(order="rating DESC NULLS LAST, review_count DESC NULLS LAST, place.id DESC"))
def trending(spark, sf):
    rows = listings.trending(cat(spark, sf, "place", "location", "category", "place_category"))
    return rows.select("district", "place_id", "rank")


@check("T3_newest", views.duck("place", "location") + _RANK.format(order="updated_at DESC, place.id DESC"))
def newest(spark, sf):
    facts = lookups.place_facts(cat(spark, sf, "place", "location", "category", "place_category"))
    return top_rows(facts, ["district"], [F.desc("updated_at"), F.desc("place_id")], 30, "place_id").select("district", "place_id", "rank")


@check(
    "T13_adaptive_radius",
    views.duck("place", "location", "request")
    + f"""SELECT request_id, CAST(radius_m AS DOUBLE) AS radius_m, rank, place_id, round(distance_m, 0) AS distance_m FROM (
  SELECT *, CASE WHEN count(*) FILTER (WHERE distance_m <= 10000) OVER w >= 8 THEN 10000.0 WHEN count(*) FILTER (WHERE distance_m <= 12000) OVER w >= 8 THEN 12000.0 ELSE 15000.0 END AS radius_m,
    row_number() OVER (PARTITION BY request_id ORDER BY distance_m, updated_at DESC, place_id DESC) AS rank
  FROM (SELECT request_id, place.id AS place_id, updated_at, {duck.distance('lat', 'lon', 'latitude', 'longitude')} AS distance_m
    FROM request, place JOIN location ON location.id = location_id WHERE status = 'active' AND lat IS NOT NULL AND latitude IS NOT NULL)
  WHERE distance_m <= 15000 WINDOW w AS (PARTITION BY request_id)) WHERE distance_m <= radius_m AND rank <= 30""",
)
def adaptive_radius(spark, sf):
    points = views.frame(spark, sf, "request").filter("latitude is not null")
    rows = listings.nearby(points, cat(spark, sf, "place", "location"))
    return rows.withColumn("distance_m", F.round("distance_m", 0))


# --- listings and reports ----------------------------------------------------------------


_DISH_SQL = f"""SELECT d.id, d.name, price_amount, is_popular, p.id AS place_id, p.name AS place_name, cover_image_url AS image_url,
  (SELECT min(category.name) FROM place_category JOIN category ON category.id = category_id WHERE place_id = p.id AND is_active) AS category
  FROM dish d JOIN place p ON p.id = d.place_id AND p.status = 'active' LEFT JOIN cover ON cover.place_id = p.id WHERE d.status = 'available'"""


@check(
    "O17_dish_listing",
    views.duck("dish", "place", "image", "category", "place_category", "hours")
    + f", {duck.COVER} {_DISH_SQL}"
    + f""" AND (d.name ILIKE '%pho%' OR d.normalized_name ILIKE '%pho%' OR {duck.fold('d.name')} LIKE '%pho%' OR {duck.fold('d.normalized_name')} LIKE '%pho%'
    OR coalesce(d.description, '') ILIKE '%pho%' OR p.name ILIKE '%pho%')
  AND EXISTS (SELECT 1 FROM place_category WHERE place_id = p.id AND category_id = 'economy') AND p.price_level = 3
  AND EXISTS (SELECT 1 FROM hours WHERE place_id = p.id AND day_of_week = 3 AND NOT is_closed
    AND CASE WHEN spans_next_day THEN 810 >= opens_min OR 810 <= closes_min ELSE 810 BETWEEN opens_min AND closes_min END)
  ORDER BY is_popular DESC, rating DESC NULLS LAST, d.name, d.id LIMIT 50""",
)
def dish_listing(spark, sf):
    c = cat(spark, sf, "dish", "place", "image", "category", "place_category", "hours")
    now = F.timestamp_seconds(F.lit(views.NOW_SECONDS))
    rows = listings.dish_listing(c, 99, " pho ", "economy", 3, now)
    return rows.select("id", "name", "price_amount", "is_popular", "place_id", "place_name", "image_url", "category")


@check(
    "O17_dish_detail",
    views.duck("dish", "place", "image", "category", "place_category") + f", {duck.COVER} {_DISH_SQL}",
)
def dish_detail(spark, sf):
    c = cat(spark, sf, "dish", "place", "image", "category", "place_category")
    rows = listings.dish_detail(c.dish.select("id"), c)
    return rows.select("id", "name", "price_amount", "is_popular", "place_id", "place_name", "image_url", "category")


@check(
    "O18_category_listing",
    views.duck("category", "place_category", "place")
    + """SELECT c.slug, c.name, p.slug AS parent_slug, count(DISTINCT r.id) AS place_count FROM category c LEFT JOIN category p ON p.id = c.parent_id
  LEFT JOIN place_category rc ON rc.category_id = c.id LEFT JOIN place r ON r.id = rc.place_id AND r.status = 'active'
  WHERE c.is_active GROUP BY c.slug, c.name, p.slug""",
)
def category_listing(spark, sf):
    return listings.category_listing(cat(spark, sf, "category", "place_category", "place")).drop("description")


_SAVED = ["saved", "place", "location", "category", "place_category", "image", "place_source", "data_source"]


@check(
    "O15_saved_lists",
    views.duck(*_SAVED)
    + f""", {duck.COVER}, {duck.SOURCE_URL}, {duck.CATEGORY_SETS}, {duck.FACTS}
  SELECT user_id, rank, n > 12 AS has_next, s.place_id, name, categories, cover_image_url, source_url FROM (
    SELECT saved.*, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, saved.place_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS n
    FROM saved JOIN facts ON facts.place_id = saved.place_id) s
  JOIN facts ON facts.place_id = s.place_id LEFT JOIN cover ON cover.place_id = s.place_id LEFT JOIN source_link ON source_link.place_id = s.place_id
  WHERE rank <= 12""",
)
def saved_lists(spark, sf):
    rows = listings.saved_lists(views.frame(spark, sf, "saved"), cat(spark, sf, *_SAVED[1:]))
    joined = F.array_join(F.transform("categories", lambda c: F.concat_ws(":", c["name"], c["slug"])), ",")
    return rows.select("user_id", "rank", "has_next", "place_id", "name", joined.alias("categories"), "cover_image_url", "source_url")


@check(
    "O16_apply_saves",
    views.duck("saved", "place")
    + f""", log AS (SELECT user_id, event_id % n AS place_id, CASE WHEN event_type = 'click' THEN 'save' ELSE 'remove' END AS op, event_id AS moment
    FROM events CROSS JOIN (SELECT count(*) AS n FROM customer) WHERE event_type IN ('click', 'error')),
  gone AS (SELECT user_id, place_id, max(moment) AS removed FROM log WHERE op = 'remove' GROUP BY user_id, place_id),
  kept AS (SELECT user_id, place_id, CAST(epoch(created_at) AS BIGINT) AS created FROM saved ANTI JOIN gone USING (user_id, place_id)),
  added AS (SELECT user_id, place_id, min(moment) AS created FROM log LEFT JOIN gone USING (user_id, place_id) JOIN place ON place.id = place_id
    WHERE op = 'save' AND status = 'active' AND (removed IS NULL OR moment >= removed) GROUP BY user_id, place_id)
  SELECT user_id, place_id, created FROM kept UNION ALL SELECT user_id, place_id, created FROM added ANTI JOIN kept USING (user_id, place_id)""",
)
def apply_saves(spark, sf):
    n = views.raw(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    log = (
        views.raw(spark, sf, "events").filter("event_type in ('click', 'error')").join(F.broadcast(n))
        .select(
            "user_id", (F.col("event_id") % F.col("n")).alias("place_id"),
            F.when(F.col("event_type") == "click", "save").otherwise("remove").alias("op"), F.timestamp_seconds("event_id").alias("at"),
        )
    )
    rows = listings.apply_saves(views.frame(spark, sf, "saved"), log, cat(spark, sf, "place"))
    return rows.select("user_id", "place_id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created"))


@check(
    "A3_O19_source_overview",
    views.duck("data_source", "place_source", "crawl_run")
    + f"""SELECT d.code, d.name, d.is_active, count(DISTINCT s.id) AS source_count, {duck.epoch('max(r.finished_at)')} AS last_finished
  FROM data_source d LEFT JOIN place_source s ON s.data_source_id = d.id
  LEFT JOIN (SELECT data_source_id, max(finished_at) AS finished_at FROM crawl_run WHERE status = 'completed' GROUP BY 1) r ON r.data_source_id = d.id
  GROUP BY d.code, d.name, d.is_active""",
)
def source_overview(spark, sf):
    rows = reports.source_overview(cat(spark, sf, "data_source", "place_source", "crawl_run"))
    return rows.select("code", "name", "is_active", "source_count", epoch("last_finished_at").alias("last_finished"))


@check(
    "T10_O19_runs",
    views.duck("crawl_run", "data_source")
    + f"""SELECT c.id, code AS provider_code, target, {duck.epoch('started_at')} AS started FROM crawl_run c JOIN data_source d ON d.id = data_source_id
  WHERE status = 'completed' ORDER BY started_at DESC NULLS LAST, c.id DESC LIMIT 50""",
)
def runs(spark, sf):
    rows = reports.runs(cat(spark, sf, "crawl_run", "data_source"), 50, "completed")
    return rows.select("id", "provider_code", "target", epoch("started_at").alias("started"))


@check(
    "T10_O19_processing_records",
    views.duck("processing_record")
    + f"SELECT id, stage, attempt_count, {duck.epoch('processed_at')} AS processed FROM processing_record WHERE status = 'failed' ORDER BY processed_at DESC NULLS LAST, id DESC LIMIT 40",
)
def processing_records(spark, sf):
    rows = reports.processing_records(cat(spark, sf, "processing_record"), 40, "failed")
    return rows.select("id", "stage", "attempt_count", epoch("processed_at").alias("processed"))


@check(
    "T10_O19_unresolved",
    views.duck("processing_record")
    + "SELECT id, external_id, status FROM processing_record WHERE stage = 'matching' AND status IN ('failed', 'pending', 'processing') ORDER BY id DESC LIMIT 30",
)
def unresolved(spark, sf):
    return reports.unresolved_matches(cat(spark, sf, "processing_record"), 30).select("id", "external_id", "status")


_DETAIL = ["place", "location", "category", "place_category", "image", "place_source", "data_source", "hours", "review", "dish"]


@check(
    "O4_detail_headers",
    views.duck(*_DETAIL)
    + f""", {duck.COVER}, {duck.SOURCE_URL}, {duck.CATEGORY_SETS}, {duck.FACTS},
  day AS (SELECT place_id, string_agg(day_of_week || ' ' || lpad(CAST(opens_min // 60 AS STRING), 2, '0') || ':' || lpad(CAST(opens_min % 60 AS STRING), 2, '0') || ' ' || is_closed, ',' ORDER BY day_of_week, opens_min) AS opening FROM hours GROUP BY place_id),
  shown AS (SELECT place_id, string_agg(CAST(id AS STRING), ',' ORDER BY rn) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn
    FROM review WHERE is_visible AND content IS NOT NULL AND length(trim(content)) > 0) WHERE rn <= 20 GROUP BY place_id)
  SELECT f.place_id, f.name, phone, website_url, f.formatted_address, categories, cover_image_url, source_url, opening, reviews
  FROM facts f JOIN place ON place.id = f.place_id LEFT JOIN day ON day.place_id = f.place_id LEFT JOIN shown ON shown.place_id = f.place_id
  LEFT JOIN cover ON cover.place_id = f.place_id LEFT JOIN source_link ON source_link.place_id = f.place_id""",
)
def detail_headers(spark, sf):
    c = cat(spark, sf, *_DETAIL)
    rows = detail.detail_headers(c.place.select(F.col("id").alias("place_id")), c)
    joined = F.array_join(F.transform("categories", lambda x: F.concat_ws(":", x["name"], x["slug"])), ",")
    opening = F.array_join(
        F.transform("opening_hours", lambda h: F.concat_ws(" ", h["day_of_week"].cast("string"), h["opens_at"], h["is_closed"].cast("string"))), ","
    )
    reviews = F.array_join(F.transform("reviews", lambda r: r["id"].cast("string")), ",")
    return rows.select(
        "place_id", "name", "phone", "website_url", "formatted_address", joined.alias("categories"), "cover_image_url", "source_url",
        opening.alias("opening"), reviews.alias("reviews"),
    )


@check("O4_detail_dishes", views.duck("dish") + "SELECT place_id, id, name, description, price_amount, is_popular FROM dish WHERE status = 'available'")
def detail_dishes(spark, sf):
    c = cat(spark, sf, "dish")
    return detail.detail_dishes(c.dish.select("place_id"), c).drop("currency_code")


@check("O4_detail_images", views.duck("image") + "SELECT place_id, id, url, alt_text, is_cover, sort_order FROM image WHERE status = 'active'")
def detail_images(spark, sf):
    c = cat(spark, sf, "image")
    return detail.detail_images(c.image.select("place_id"), c)


@check(
    "S6_coverage_gaps",
    views.duck("crawl_run", "data_source")
    + """, plan AS (SELECT q AS query, d || ', City' AS location FROM
    (SELECT DISTINCT 'q' || (l_partkey % 25) AS q FROM lineitem), (SELECT DISTINCT 'd' || (s_suppkey % 9) AS d FROM supplier))
  SELECT query, location FROM plan WHERE NOT EXISTS (SELECT 1 FROM crawl_run JOIN data_source ON data_source.id = data_source_id
    WHERE code = 'google_maps_playwright' AND status = 'completed' AND target ->> 'query' = query AND target ->> 'location' = location)""",
)
def coverage_gaps(spark, sf):
    terms = views.raw(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("position"), F.concat(F.lit(" q"), (F.col("l_partkey") % 25).cast("string")).alias("value")
    )
    areas = views.raw(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("position"), F.concat(F.lit("d"), (F.col("s_suppkey") % 9).cast("string")).alias("value")
    )
    gaps = reports.coverage_gaps(reports.query_plan(areas, terms, "City ", 99), cat(spark, sf, "crawl_run", "data_source"))
    return gaps.select("query", "location")


@check(
    "S8_refresh_targets",
    views.duck("place_source", "data_source", "place", "review")
    + """SELECT s.id AS place_source_id, p.name, coalesce(n, 0) AS visible_reviews FROM place_source s JOIN data_source d ON d.id = data_source_id
  JOIN place p ON p.id = s.place_id LEFT JOIN (SELECT place_source_id % (SELECT count(*) FROM customer) + 1000000 AS sid, count(*) FILTER (WHERE is_visible IS NOT FALSE) AS n FROM review GROUP BY 1) r ON r.sid = s.id
  WHERE d.code = 'google_maps_playwright' AND s.status = 'active' AND source_url IS NOT NULL AND p.status = 'active' AND coalesce(n, 0) < 1""",
)
def refresh_targets(spark, sf):
    c = cat(spark, sf, "place_source", "data_source", "place", "review")
    n = views.raw(spark, sf, "customer").count()
    linked = c.review.withColumn("place_source_id", F.col("place_source_id") % n + 1000000)
    return refresh.refresh_targets(c.with_tables(review=linked), 1).select("place_source_id", "name", "visible_reviews")
