"""Scans, source records, merges and run logs on data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, views
from checks.harness import check
from larder import schemas, taxonomy as tax
from larder.catalog import empty_catalog
from larder.operators import upsert
from larder.operators.leaders import assign_leaders
from larder.operators.lineage import cut, shared_folder
from larder.plans import ingest, refresh
from larder.sources import scans, sinks
from larder.streaming import landing


def cat(spark, sf, *names):
    return views.catalog(spark, sf, *names)


def now():
    return F.timestamp_seconds(F.lit(views.NOW_SECONDS))


# --- raw scans ---------------------------------------------------------------------------

LABELS = ["Quán cà phê", "Bánh mì", "Nhà hàng chay", "Phở", "Bún chả Hà Nội", "Cơm tấm", "Trà sữa", "Restaurant", "Karaoke", "Bệnh viện"]
_NAME = f"concat({views._pick('l_partkey', views.KINDS)}, ' ', {views._pick('l_suppkey', views.OWNERS)}, ' ', CAST(l_partkey % 50 AS STRING))"
_RAW = f"""SELECT CAST(l_suppkey % 5 AS STRING) AS scan_id, CAST(l_orderkey * 8 + l_linenumber AS INT) AS position,
  CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN 'Quận 1' WHEN l_linenumber = 6 AND l_quantity < 5 THEN 'Google' ELSE {_NAME} END AS name,
  concat(CAST(CAST(l_quantity AS INT) % 7 AS STRING), ',', CAST(l_linenumber AS STRING)) AS rating_text,
  CASE l_linenumber % 3 WHEN 0 THEN concat('4,5 (', CAST(l_partkey AS STRING), ')') WHEN 1 THEN concat(CAST(l_partkey AS STRING), ' đánh giá') ELSE '4.8' END AS review_text,
  concat(CAST(l_suppkey AS STRING), ' Lê Lợi') AS address, {views._pick('l_partkey * 3 + l_suppkey', LABELS)} AS category,
  concat('https://maps.example/place/P', CAST(l_partkey AS STRING), '/@', CAST(10 + l_suppkey % 3 AS STRING), '.5,106.25,17z?cid=', CAST(l_partkey * 100 + l_suppkey AS STRING)) AS url,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Quận 3, Ho Chi Minh City' ELSE 'Gò Vấp, HCM' END AS scan_location FROM """


def raw_scans(spark, sf):
    rows = spark.sql(_RAW + "{lineitem}", lineitem=views.raw(spark, sf, "lineitem"))
    images = F.array(
        F.struct(F.concat(F.lit("https://lh3.googleusercontent.com/p/"), F.col("scan_id"), F.lit("=w80-h80-k")).alias("url"), F.lit("").alias("alt_text")),
        F.struct(F.lit("https://maps.gstatic.com/x.png").alias("url"), F.lit("map").alias("alt_text")),
        F.struct(F.concat(F.lit("https://lh3.googleusercontent.com/p/"), F.col("scan_id"), F.lit("=w99-h99")).alias("url"), F.lit("front").alias("alt_text")),
    )
    return (
        rows.withColumn("images", images).withColumn("query", F.lit("quán ăn")).withColumn("city", F.lit(None).cast("string"))
        .withColumn("district", F.lit(None).cast("string")).withColumn("collected_at", F.lit("2024-06-01T00:00:00Z"))
    )


_LIST = (
    f"WITH raw_scan AS MATERIALIZED ({_RAW} lineitem)"
    + f""", keyed AS (SELECT *, replace({duck.fold('name')}, 'đ', 'd') AS k, replace({duck.fold('category')}, 'đ', 'd') AS c FROM raw_scan),
  kept AS (SELECT *, row_number() OVER (PARTITION BY scan_id, url ORDER BY position) AS rn FROM keyed
    WHERE name <> 'Google' AND name <> 'Quận 1' AND NOT starts_with(k, 'karaoke') AND NOT starts_with(k, 'quan ') AND c NOT IN ('karaoke', 'benh vien')),
  place_row AS (SELECT *, CASE WHEN CAST(replace(rating_text, ',', '.') AS DOUBLE) <= 5 THEN CAST(replace(rating_text, ',', '.') AS DOUBLE) END AS rating,
    CASE WHEN contains(review_text, '(') THEN CAST(regexp_extract(review_text, '\\(([0-9]+)\\)', 1) AS INT) WHEN contains(review_text, 'đánh') THEN CAST(regexp_extract(review_text, '^[0-9]+') AS INT) END AS review_count,
    CAST(regexp_extract(url, '@([0-9.]+),', 1) AS DOUBLE) AS lat FROM kept WHERE rn = 1)"""
)


@check("S2_F13_F14_X7_X8_X10_parse_list", _LIST + " SELECT scan_id, position, url, rating, review_count, lat, 1 AS images, 'front' AS alt FROM place_row")
def parse_list(spark, sf):
    rows = scans.parse_list(raw_scans(spark, sf))
    return rows.select(
        "scan_id", "position", "url", "rating", "review_count", F.col("coordinates.latitude").alias("lat"), F.size("images").alias("images"),
        F.get("images", F.lit(0))["alt_text"].alias("alt"),
    )


_SLUG = "CASE c WHEN 'quan ca phe' THEN 'coffee-shop' WHEN 'banh mi' THEN 'snack' WHEN 'nha hang chay' THEN 'vegetarian' WHEN 'pho' THEN 'noodle' WHEN 'bun cha ha noi' THEN 'bun' WHEN 'com tam' THEN 'rice' WHEN 'tra sua' THEN 'beverage' WHEN 'restaurant' THEN 'restaurant' END"


@check(
    "S3_X11_X13_X15_source_records",
    _LIST
    + f""" SELECT scan_id || '|' || url AS k, regexp_extract(url, 'cid=([0-9]+)', 1) AS external_id, {_SLUG} AS slug, CASE WHEN starts_with(scan_location, 'Quận 3') THEN 'Quận 3' ELSE 'Gò Vấp' END AS district,
  CASE WHEN starts_with(scan_location, 'Quận 3') THEN 'Ho Chi Minh City' ELSE 'HCM' END AS city, true AS first_is_cover, rating IS NOT NULL AS saw_rating FROM place_row""",
)
def source_records(spark, sf):
    places = scans.parse_list(raw_scans(spark, sf))
    rows = scans.to_source_records(places.withColumn("query", F.concat_ws("|", "scan_id", "url")))
    return rows.select(
        F.get_json_object("source_metadata", "$.query").alias("k"), "external_id", F.get("categories", F.lit(0)).alias("slug"), "district", "city",
        F.get("images", F.lit(0))["is_cover"].alias("first_is_cover"), (F.get_json_object("source_metadata", "$.extracted.rating") == "true").alias("saw_rating"),
    )


@check(
    "S4_X28_X29_merge_details",
    _LIST
    + """, detail AS (SELECT scan_id, url, name, position % 2 = 0 AS fits FROM place_row WHERE position % 3 <> 0)
  SELECT p.scan_id, p.url, CASE WHEN d.fits THEN 77 ELSE review_count END AS review_count, CASE WHEN d.fits THEN '+84 28 123' END AS phone, CASE WHEN d.fits THEN 3 END AS price_level, address
  FROM place_row p LEFT JOIN detail d ON d.scan_id = p.scan_id AND d.url = p.url""",
)
def merge_details(spark, sf):
    places = cut(scans.parse_list(raw_scans(spark, sf)))  # list and panels are made from them
    panels = places.filter("position % 3 <> 0").select(
        "scan_id", "url", F.when(F.col("position") % 2 == 0, F.upper("name")).otherwise(F.lit("Zzz")).alias("name"), F.lit("(77)").alias("review_text"),
        F.lit("tel:+84 28 123").alias("phone_href"), F.lit("x").alias("phone_text"), F.lit(None).cast("string").alias("website"),
        F.lit("elsewhere").alias("address"), F.array(F.lit("$"), F.lit("$$$"), F.lit("a $$$$")).alias("price_texts"),
        F.array().cast("array<struct<url:string,alt_text:string>>").alias("images"),
        F.array().cast("array<struct<id:string,author:string,rating_text:string,content:string,date:string>>").alias("reviews"),
    )
    rows = scans.merge_details(places, scans.parse_details(panels))
    return rows.select("scan_id", "url", "review_count", "phone", "price_level", "address")


@check(
    "I11_X9_shape_reviews",
    """WITH r AS (SELECT user_id % 40 AS place, event_id, user_id, value, event_type, row_number() OVER (PARTITION BY user_id % 40, event_id % 50 ORDER BY event_id) AS again FROM events),
  first_seen AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY event_id) AS n FROM r WHERE again = 1)
  SELECT place, 'P' || place || ':' || (event_id % 50) AS external_review_id, CASE WHEN floor(value) <= 5 THEN floor(value) END AS rating, CASE WHEN event_type <> 'error' THEN event_type END AS content,
    CASE WHEN event_id % 2 = 0 THEN '2024-05-30 00:00:00' ELSE '2024-03-05 00:00:00' END AS reviewed_at
  FROM first_seen WHERE n <= 20 AND (event_type <> 'error' OR floor(value) <= 5)""",
)
def shape_reviews(spark, sf):
    events = views.raw(spark, sf, "events")
    review = F.struct(
        "event_id",
        F.struct(
            (F.col("event_id") % 50).cast("string").alias("id"), F.lit("a").alias("author"), F.floor("value").cast("string").alias("rating_text"),
            F.when(F.col("event_type") != "error", F.col("event_type")).alias("content"),
            F.when(F.col("event_id") % 2 == 0, F.lit("2 ngày trước")).otherwise(F.lit("March 5, 2024")).alias("date"),
        ).alias("r"),
    )
    places = events.groupBy((F.col("user_id") % 40).alias("place")).agg(F.array_sort(F.collect_list(review)).alias("all")).select(
        "place", F.concat(F.lit("P"), F.col("place").cast("string")).alias("name"), F.lit("2024-06-01T00:00:00Z").alias("collected_at"),
        F.transform("all", lambda x: x["r"]).alias("reviews"),
    )
    rows = scans.shape_reviews(places, 20).select("place", F.explode("reviews").alias("r"))
    return rows.select("place", "r.external_review_id", "r.rating", "r.content", "r.reviewed_at")


# --- records derived from events -------------------------------------------------------------


def records(spark, sf):
    """One source record per event: provider from the type, id from user and day part."""
    e = views.raw(spark, sf, "events")
    k = F.col("user_id") * 7 + F.col("event_id") % 7
    rows = e.select(
        F.when(F.col("event_type").isin("view", "click"), tax.SCAN_PROVIDER).when(F.col("event_type") == "error", "nobody").otherwise("import").alias("provider_code"),
        F.when(F.col("event_id") % 101 == 0, F.lit(" ")).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("external_id"),
        F.concat(F.lit("https://s/"), F.col("event_id").cast("string")).alias("source_url"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"),
        F.concat(F.lit(" Quán  Số "), (k % 200).cast("string")).alias("name"),
        F.lit("1 Lê Lợi").alias("address"), F.lit(None).cast("string").alias("district"), F.concat(F.lit("City "), (k % 10).cast("string")).alias("city"),
        F.lit("VN").alias("country_code"),
        F.when(k % 3 != 0, F.struct((10 + k % 200 * 0.01 + k % 5 * 0.0004).alias("latitude"), F.lit(106.0).alias("longitude"))).alias("coordinates"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("website_url"),
        F.array(
            F.struct(((F.col("event_id") % 7) + 1).cast("int").alias("day_of_week"), F.lit("08:00").alias("opens_at"), F.lit("22:00").alias("closes_at"), F.lit(False).alias("is_closed"), F.lit(None).cast("boolean").alias("spans_next_day"))
        ).alias("opening_hours"),
        F.array(F.concat(F.lit(" C"), (F.col("event_id") % 4).cast("string"))).alias("categories"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 6).cast("double")).alias("price_level"),
        F.when(F.col("event_id") % 2 == 0, F.round("value", 1)).alias("rating"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 900).cast("double")).alias("review_count"),
        F.array(F.struct(F.concat(F.lit("https://i/"), (F.col("event_id") % 9).cast("string")).alias("url"), F.lit(None).cast("string").alias("alt_text"), F.lit(True).alias("is_cover"), F.lit(0).alias("sort_order"))).alias("images"),
        F.array(F.struct(F.concat(F.lit(" Dish "), (F.col("event_id") % 8).cast("string")).alias("name"), F.lit(None).cast("string").alias("description"), F.lit(1.5).alias("price_amount"), F.lit("VND").alias("currency_code"), F.lit(None).cast("boolean").alias("is_popular"))).alias("dishes"),
        F.array(F.struct((F.col("event_id") % 6).cast("string").alias("external_review_id"), F.lit(4.0).alias("rating"), F.col("props").alias("content"), F.lit(None).cast("string").alias("reviewed_at"), F.lit("en").alias("language_code"))).alias("reviews"),
        F.col("props").alias("source_metadata"),
    )
    return rows


def start(spark):
    catalog = empty_catalog(spark)
    sources = [("1", tax.SCAN_PROVIDER, "scan", None, True), ("2", "import", "import", None, True)]
    categories = [(f"c{i}", f"C{i}", f"c{i}", None, None, i != 3) for i in range(4)]
    return catalog.with_tables(
        data_source=spark.createDataFrame(sources, schemas.TABLES["data_source"]),
        category=spark.createDataFrame(categories, schemas.TABLES["category"]),
    )


_ERROR = """WITH r AS (SELECT *, user_id * 7 + event_id % 7 AS k, CASE WHEN event_type IN ('view', 'click') THEN 'google_maps_playwright' WHEN event_type = 'error' THEN 'nobody' ELSE 'import' END AS provider,
    CASE WHEN event_id % 101 = 0 THEN ' ' ELSE 'x' || (user_id * 7 + event_id % 7) END AS external_id FROM events),
  checked AS (SELECT *, CASE WHEN trim(external_id) = '' THEN 'externalId is required.' WHEN event_id % 2 = 0 AND round(value, 1) NOT BETWEEN 0 AND 5 THEN 'rating must be between 0 and 5.'
    WHEN event_id % 5 = 0 AND event_id % 6 NOT BETWEEN 1 AND 4 THEN 'priceLevel must be between 1 and 4.' END AS error FROM r),
  valid AS (SELECT *, date_trunc('second', ts) AS seen FROM checked WHERE error IS NULL AND provider <> 'nobody')"""


@check("F17_validation", _ERROR + " SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM checked GROUP BY 1")
def validation(spark, sf):
    rows = ingest.with_error(records(spark, sf))
    return rows.groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "U5_normalised_records",
    """SELECT event_id, 'Quán Số ' || ((user_id * 7 + event_id % 7) % 200) AS name, 'quan so ' || ((user_id * 7 + event_id % 7) % 200) AS normalized_name,
  '1 Lê Lợi, City ' || ((user_id * 7 + event_id % 7) % 10) AS formatted_address, 'c' || (event_id % 4) AS categories FROM events""",
)
def normalised(spark, sf):
    rows = ingest.normalise(records(spark, sf))
    return rows.select(
        F.substring("source_url", 11, 20).cast("bigint").alias("event_id"), "name", "normalized_name", "formatted_address", F.array_join("categories", ",").alias("categories")
    )


def ingested(spark, sf):
    return ingest.ingest(records(spark, sf), start(spark), "run", now())


@check(
    "I1_A13_counters",
    _ERROR + " SELECT (SELECT count(*) FROM checked) AS records_found, (SELECT count(*) FROM valid) AS records_processed, (SELECT count(*) FROM checked) - (SELECT count(*) FROM valid) AS records_failed",
)
def counters(spark, sf):
    return ingested(spark, sf).counters.drop("crawl_run_id")


@check(
    "I4_source_upsert",
    _ERROR
    + f""" SELECT provider, external_id, 'Quán Số ' || (k % 200) AS source_name, {duck.epoch('max(seen)')} AS last_seen, 'active' AS status FROM valid GROUP BY provider, external_id, k""",
)
def source_upsert(spark, sf):
    result = ingested(spark, sf).catalog
    codes = result.data_source.select(F.col("id").alias("data_source_id"), F.col("code").alias("provider"))
    return result.place_source.join(codes, "data_source_id").select(
        "provider", "external_id", "source_name", F.unix_seconds("last_seen_at").alias("last_seen"), "status"
    )


@check(
    "I2_I3_resolution",
    _ERROR
    + """ SELECT 'sources' AS measure, count(DISTINCT (provider, external_id)) AS n FROM valid
  UNION ALL SELECT 'bare places', count(DISTINCT (k % 200, k % 10)) FROM valid v WHERE k % 3 = 0 AND NOT EXISTS (SELECT 1 FROM valid w WHERE w.k % 3 <> 0 AND w.k % 200 = v.k % 200 AND w.k % 10 = v.k % 10)""",
)
def resolution(spark, sf):
    resolved = cut(ingested(spark, sf).resolved)
    sources = resolved.agg(F.count_distinct("provider_code", "external_id").alias("n")).select(F.lit("sources").alias("measure"), "n")
    located = resolved.filter("lat is not null").select("normalized_name", "city").distinct()
    bare = resolved.filter("lat is null").join(located, ["normalized_name", "city"], "left_anti").agg(F.count_distinct("place_id").alias("n"))
    return sources.unionByName(bare.select(F.lit("bare places").alias("measure"), "n"))


@check("I5_J13_category_links", _ERROR + " SELECT count(DISTINCT (provider, external_id)) AS sources, count(DISTINCT 'c' || (event_id % 4)) FILTER (WHERE event_id % 4 <> 3) AS slugs FROM valid")
def category_links(spark, sf):
    result = ingested(spark, sf)
    slugs = result.catalog.place_category.agg(F.count_distinct("category_id").alias("slugs"))
    return result.resolved.agg(F.count_distinct("provider_code", "external_id").alias("sources")).join(slugs)


@check("I6_images", _ERROR + " SELECT provider, external_id, count(DISTINCT event_id % 9) AS images FROM valid GROUP BY provider, external_id")
def images(spark, sf):
    result = ingested(spark, sf).catalog
    codes = result.data_source.select(F.col("id").alias("data_source_id"), F.col("code").alias("provider"))
    sources = result.place_source.join(codes, "data_source_id").select(F.col("id").alias("place_source_id"), "provider", "external_id")
    return result.image.join(sources, "place_source_id").groupBy("provider", "external_id").agg(F.count(F.lit(1)).alias("images"))


@check("I9_reviews", _ERROR + " SELECT provider, external_id, event_id % 6 AS review, arg_max(props, (seen, 0)) IS NOT NULL AS has_text FROM valid GROUP BY provider, external_id, event_id % 6")
def reviews(spark, sf):
    result = ingested(spark, sf).catalog
    codes = result.data_source.select(F.col("id").alias("data_source_id"), F.col("code").alias("provider"))
    sources = result.place_source.join(codes, "data_source_id").select(F.col("id").alias("place_source_id"), "provider", "external_id")
    return result.review.join(sources, "place_source_id").select(
        "provider", "external_id", F.col("external_review_id").cast("bigint").alias("review"), F.col("content").isNotNull().alias("has_text")
    )


@check("I7_I8_dishes_and_hours")
def dishes_and_hours(spark, sf):
    result = ingested(spark, sf).catalog
    dishes = result.dish.groupBy("normalized_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dish").alias("kind"), F.col("normalized_name").alias("value"), "n")
    hours = result.hours.groupBy(F.col("day_of_week").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("hours").alias("kind"), "value", "n")
    return dishes.unionByName(hours)


@check(
    "S11_I10_outcome_log",
    """WITH o AS (SELECT user_id % 20 AS run, 'x' || (event_id % 500) AS external_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events),
  first_half AS (SELECT run, external_id, count(*) AS tries FROM o WHERE event_id % 2 = 0 GROUP BY ALL), second_half AS (SELECT run, external_id, count(*) AS tries, arg_max(status, event_id) AS status FROM o WHERE event_id % 2 = 1 GROUP BY ALL),
  f2 AS (SELECT run, external_id, arg_max(status, event_id) AS status FROM o WHERE event_id % 2 = 0 GROUP BY ALL)
  SELECT run, external_id, coalesce(s.status, f2.status) AS status, coalesce(f.tries, 0) + coalesce(s.tries, 0) AS attempt_count FROM first_half f FULL JOIN second_half s USING (run, external_id) LEFT JOIN f2 USING (run, external_id)""",
)
def outcome_log(spark, sf):
    e = views.raw(spark, sf, "events").select(
        (F.col("user_id") % 20).cast("string").alias("crawl_run_id"), F.lit(None).cast("string").alias("place_source_id"),
        F.concat(F.lit("x"), (F.col("event_id") % 500).cast("string")).alias("external_id"), F.lit("validation").alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("props").alias("error_details"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sequence"), "event_id",
    )
    empty = spark.createDataFrame([], schemas.TABLES["processing_record"])
    first = cut(ingest.outcome_log(e.filter("event_id % 2 = 0").drop("event_id"), empty, now()))
    log = ingest.outcome_log(e.filter("event_id % 2 = 1").drop("event_id"), first, now())
    return log.select(F.col("crawl_run_id").cast("bigint").alias("run"), "external_id", "status", F.col("attempt_count").cast("bigint").alias("attempt_count"))


@check(
    "J11_J15_null_safe_upsert",
    """WITH old AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE max(o_totalprice) END AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
  new AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(o_totalprice) END AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
  SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.k = new.k""",
)
def null_safe_upsert(spark, sf):
    orders = views.raw(spark, sf, "orders")

    def side(parity: int, hole: int):
        top = orders.filter(F.col("o_orderkey") % 2 == parity).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
        return top.withColumn("v", F.when(F.col("k") % hole != 0, F.col("v")))

    return upsert.fill(side(0, 4), side(1, 3), ["k"])


@check("I2_leader_clusters")
def leader_clusters(spark, sf):
    c = cat(spark, sf, "place", "location")
    points = c.place.select("id", F.col("normalized_name").alias("group"), "location_id").join(
        c.location.select(F.col("id").alias("location_id"), "lat", "lon").filter("lat is not null"), "location_id"
    ).select("id", "group", "lat", "lon", F.col("id").alias("position"))
    return assign_leaders(points, 5000.0).select("id", "leader_id", F.round("leader_distance_m", 0).alias("metres"))


# --- loads, logs, refresh, streaming ------------------------------------------------------------


@check(
    "S5_load_taxonomy",
    views.duck("category")
    + f"""SELECT slug, CASE WHEN slug IN ({', '.join(repr(s) for _, s, _ in tax.CATEGORY_SEEDS)}) THEN 'seed' ELSE name END AS origin FROM category
  UNION SELECT slug, 'seed' FROM {views.DUCK.rows('s', ['slug'], [(s,) for _, s, _ in tax.CATEGORY_SEEDS])}""",
)
def load_taxonomy(spark, sf):
    seeds = sinks.category_seeds(spark).withColumn("name", F.lit("seed"))
    rows = sinks.load_taxonomy(views.frame(spark, sf, "category"), seeds, "slug", ["name", "description"])
    return rows.select("slug", F.col("name").alias("origin"))


@check(
    "S9_pin_records",
    views.duck("place_source", "data_source", "place", "review")
    + """SELECT s.id AS target, s.external_id, s.source_url, CASE WHEN s.id % 2 = 0 THEN p.name ELSE 'New name' END AS name FROM place_source s JOIN data_source d ON d.id = data_source_id JOIN place p ON p.id = s.place_id
  WHERE d.code = 'google_maps_playwright' AND s.status = 'active' AND source_url IS NOT NULL AND p.status = 'active'""",
)
def pin_records(spark, sf):
    c = cat(spark, sf, "place_source", "data_source", "place", "review")
    targets = refresh.refresh_targets(c, 10_000)
    scanned = targets.select(
        F.col("place_source_id").alias("target_id"), F.col("place_source_id").alias("target"), F.lit("other").alias("external_id"), F.lit("u").alias("source_url"),
        F.when(F.col("place_source_id") % 2 == 0, F.lit("")).otherwise(F.lit("New name")).alias("name"),
    )
    return refresh.pin(scanned, targets).select("target", "external_id", "source_url", "name")


@check(
    "S10_run_log",
    "SELECT 'test' AS run_type, 'completed' AS status, count(*) AS places_scanned, count(*) FILTER (WHERE c_acctbal > 0) AS categories_applied, 0 AS dishes_applied FROM customer",
)
def run_log(spark, sf):
    counts = views.raw(spark, sf, "customer").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("c_acctbal") > 0).alias("categories_applied"))
    row = sinks.run_row(counts, "test", "m", "{}", now(), now())
    return row.select("run_type", "status", "places_scanned", "categories_applied", "dishes_applied")


@check("S1_discover", "SELECT event_id FROM events WHERE (user_id * 7 + event_id % 7) % 10 = 3")
def discover(spark, sf):
    rows = scans.discover(records(spark, sf), city="CITY 3")
    return rows.select(F.substring("source_url", 11, 20).cast("bigint").alias("event_id"))


@check("S13_table_sink", views.duck("location") + "SELECT city, count(*) AS n FROM location GROUP BY city")
def table_sink(spark, sf):
    path = shared_folder(spark, "sink")
    sinks.write_table(views.frame(spark, sf, "location"), path, ["city"])
    return spark.read.parquet(path).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@check("Z1_Z2_stream_once", _ERROR + " SELECT provider AS provider_code, external_id, count(DISTINCT ts) > 0 AS seen FROM r GROUP BY provider, external_id")
def stream_once(spark, sf):
    """Every record landed twice, in any order of time; the stream lets each through once."""
    root = shared_folder(spark, "stream")
    rows = records(spark, sf)
    for copy in ("a", "b"):
        rows.write.mode("append").json(f"{root}/in")
    landing.deliver_once(landing.read_landing(spark, f"{root}/in", files_per_batch=4), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    once = out.groupBy("provider_code", "external_id", "collected_at").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("provider_code", "external_id").agg((F.max("n") == 1).alias("seen"))
