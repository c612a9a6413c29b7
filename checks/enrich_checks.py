"""Text columns, enrichment, documents, vectors, repairs and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, views
from checks.harness import check
from larder import taxonomy as tax
from larder.functions import geo
from larder.functions import scan
from larder.functions import text as tx
from larder.functions import vector as vec
from larder.operators import lookups
from larder.operators.contains import contains_pairs
from larder.operators.geo_join import within_radius
from larder.operators.trigram_join import similar_pairs
from larder.plans import audit, documents, enrich, listings, repair


def cat(spark, sf, *names):
    return views.catalog(spark, sf, *names)


def now():
    return F.timestamp_seconds(F.lit(views.NOW_SECONDS))


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- text ------------------------------------------------------------------------------


@check("X1_fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold(spark, sf):
    return views.raw(spark, sf, "documents").select("doc_id", F.md5(tx.fold("text")).alias("folded"))


@check(
    "X3_whole_words",
    "SELECT doc_id, regexp_matches(strip_accents(lower(text)), '(^|[^a-z0-9_])(the|la|der|que)($|[^a-z0-9_])') AS hit FROM documents",
)
def whole_words(spark, sf):
    return views.raw(spark, sf, "documents").select("doc_id", tx.fold("text").rlike(tx.ascii_phrase(["the", "la", "der", "que"])).alias("hit"))


@check(
    "X5_clean",
    r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS cleaned FROM documents",
)
def clean(spark, sf):
    return views.raw(spark, sf, "documents").select("doc_id", F.md5(tx.clean("text")).alias("cleaned"))


@check(
    "X6_trigram_similarity",
    views.duck("place")
    + f"""SELECT id, round({duck.sim('a', 'b')}, 6) AS to_folded, round({duck.sim('a', 'c')}, 6) AS to_profile
  FROM (SELECT id, {duck.trigrams('name')} AS a, {duck.trigrams('normalized_name')} AS b, {duck.trigrams("coalesce(semantic_profile, '')")} AS c FROM place)""",
)
def trigram_similarity(spark, sf):
    rows = views.frame(spark, sf, "place").select(
        "id", tx.trigrams("name").alias("a"), tx.trigrams("normalized_name").alias("b"),
        tx.trigrams(F.coalesce("semantic_profile", F.lit(""))).alias("c"),
    )
    return rows.select(
        "id", F.round(tx.gram_similarity(F.col("a"), F.col("b")), 6).alias("to_folded"),
        F.round(tx.gram_similarity(F.col("a"), F.col("c")), 6).alias("to_profile"),
    )


@check(
    "X17_language",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '[ăâđêôơưĂÂĐÊÔƠƯ]') THEN 'vi' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'en' END AS code FROM documents",
)
def language(spark, sf):
    return views.raw(spark, sf, "documents").select("doc_id", scan.language(F.col("text")).alias("code"))


@check("X19_truncate", "SELECT doc_id, CASE WHEN len(text) > 200 THEN left(text, 200) || '…' ELSE text END AS t FROM documents")
def truncate(spark, sf):
    return views.raw(spark, sf, "documents").select("doc_id", tx.truncate("text", 200).alias("t"))


# A match takes the separator after it along in RE2, so neighbours need a second pass there.
_REMOVED = "regexp_replace({}, '(?i)(^|[^\\pL\\pN])(?:de|der)($|[^\\pL\\pN])', ' \\2', 'g')"


@check("X4_phrase_removal", f"SELECT doc_id, {_REMOVED.format(_REMOVED.format(_REMOVED.format('text')))} AS t FROM documents")
def phrase_removal(spark, sf):
    text = F.col("text")
    for phrase in ("der", "de"):
        text = tx.drop_phrase(text, phrase)
    return views.raw(spark, sf, "documents").select("doc_id", text.alias("t"))


@check("X21_json_fields", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return views.raw(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@check(
    "X22_clock",
    views.duck("hours") + "SELECT id, lpad(CAST(opens_min // 60 AS STRING), 2, '0') || ':' || lpad(CAST(opens_min % 60 AS STRING), 2, '0') AS opens FROM hours",
)
def clock(spark, sf):
    return views.frame(spark, sf, "hours").select("id", tx.clock("opens_min").alias("opens"))


@check(
    "X24_cosine",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine(spark, sf):
    rows = views.raw(spark, sf, "embeddings")
    right = rows.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("e2"))
    left = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("e1"))
    return left.join(right, "a").select("a", "b", F.round(vec.cosine(F.col("e1"), F.col("e2")), 4).alias("similarity"))


@check(
    "X25_distance",
    views.duck("location") + f"SELECT id, round({duck.distance('lat', 'lon', '10.7769', '106.7009')}, 1) AS metres FROM location WHERE lat IS NOT NULL",
)
def distance(spark, sf):
    rows = views.frame(spark, sf, "location").filter("lat is not null")
    return rows.select("id", F.round(geo.distance(F.col("lat"), F.col("lon"), F.lit(10.7769), F.lit(106.7009)), 1).alias("metres"))


@check("X26_letters_key", r"SELECT page_id, lower(regexp_replace(url, '[^\p{L}\p{N}]+', '', 'g')) AS k, contains(html, chr(65533)) AS broken FROM pages")
def letters_key(spark, sf):
    return views.raw(spark, sf, "pages").select("page_id", tx.letters_key("url").alias("k"), repair.is_corrupted(F.col("html")).alias("broken"))


# --- joins -----------------------------------------------------------------------------


@check(
    "J7_radius_join",
    views.duck("location", "request")
    + f"""SELECT request_id, id AS location_id, round({duck.distance('lat', 'lon', 'latitude', 'longitude')}, 0) AS metres
  FROM request JOIN location ON lat IS NOT NULL WHERE radius_m IS NOT NULL AND {duck.distance('lat', 'lon', 'latitude', 'longitude')} <= radius_m""",
)
def radius_join(spark, sf):
    circles = views.frame(spark, sf, "request").filter("radius_m is not null").select("request_id", "latitude", "longitude", "radius_m")
    points = views.frame(spark, sf, "location").select(F.col("id").alias("location_id"), "lat", "lon")
    rows = within_radius(circles, points, "latitude", "longitude", "radius_m")
    return rows.select("request_id", "location_id", F.round("distance_m", 0).alias("metres"))


@check(
    "J7_same_name_150m",
    views.duck("place", "location")
    + f"""SELECT a.id AS a, b.id AS b FROM place a JOIN location la ON la.id = a.location_id JOIN place b ON b.normalized_name = a.normalized_name AND b.id <> a.id
  JOIN location lb ON lb.id = b.location_id WHERE la.lat IS NOT NULL AND lb.lat IS NOT NULL AND {duck.distance('la.lat', 'la.lon', 'lb.lat', 'lb.lon')} <= 5000""",
)
def same_name_near(spark, sf):
    c = cat(spark, sf, "place", "location")
    rows = c.place.select("id", "normalized_name", "location_id").join(
        c.location.select(F.col("id").alias("location_id"), "lat", "lon"), "location_id"
    )
    circles = rows.filter("lat is not null").select(
        F.col("id").alias("a"), "normalized_name", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"), F.lit(5000.0).alias("r")
    )
    points = rows.select(F.col("id").alias("b"), "normalized_name", "lat", "lon")
    return within_radius(circles, points, "at_lat", "at_lon", "r", on=["normalized_name"]).filter("a <> b").select("a", "b")


@check(
    "J8_similar_dish_names",
    views.duck("dish")
    + f""", n AS (SELECT name, {duck.trigrams('name')} AS g FROM (SELECT DISTINCT normalized_name AS name FROM dish))
  SELECT a.name AS left_text, b.name AS right_text, round({duck.sim('a.g', 'b.g')}, 6) AS similarity FROM n a, n b WHERE {duck.sim('a.g', 'b.g')} >= 0.62""",
)
def similar_dish_names(spark, sf):
    names = views.frame(spark, sf, "dish").select(F.col("normalized_name").alias("text"))
    return similar_pairs(names, names, 0.62).withColumn("similarity", F.round("similarity", 6))


@check(
    "J8_similar_place_names",
    views.duck("place")
    + f""", n AS (SELECT name, {duck.trigrams('name')} AS g FROM (SELECT DISTINCT normalized_name AS name FROM place))
  SELECT a.name AS left_text, b.name AS right_text, round({duck.sim('a.g', 'b.g')}, 6) AS similarity FROM n a, n b WHERE {duck.sim('a.g', 'b.g')} >= 0.45""",
)
def similar_place_names(spark, sf):
    names = views.frame(spark, sf, "place").select(F.col("normalized_name").alias("text"))
    return similar_pairs(names, names, 0.45).withColumn("similarity", F.round("similarity", 6))


@check(
    "F7_contains",
    views.duck("place")
    + """, needle AS (SELECT DISTINCT lower(substr(p_name, 1, 3)) AS needle FROM part UNION SELECT DISTINCT substr(n_name, 7) FROM nation UNION SELECT 'phở%1')
  SELECT DISTINCT needle, name AS text FROM needle JOIN place ON lower(name) LIKE '%' || needle || '%'""",
)
def contains(spark, sf):
    needles = (
        views.raw(spark, sf, "part").select(F.lower(F.left("p_name", F.lit(3))).alias("needle"))
        .unionByName(views.raw(spark, sf, "nation").select(F.expr("substring(n_name, 7)").alias("needle")))
        .unionByName(views.raw(spark, sf, "region").limit(1).select(F.lit("phở%1").alias("needle")))
    )
    return contains_pairs(needles, views.frame(spark, sf, "place").select(F.col("name").alias("text")))


_WORDS = [("the", "THE"), ("of the", "OF THE"), ("de la", "DE LA"), ("la", "LA"), ("and", "AND"), ("que", "QUE"), ("les", "LES"), ("in the", "IN THE")]
_LEX = views.DUCK.rows("lexicon", ["phrase", "display"], _WORDS)
_FOLDED = "trim(regexp_replace(strip_accents(lower(content)), '\\s+', ' ', 'g'))"


@check(
    "J14_A8_phrase_mentions",
    views.duck("review")
    + f"""SELECT place_id, phrase, count(*) AS reviews FROM (SELECT place_id, id, {_FOLDED} AS t FROM review WHERE content IS NOT NULL) r
  JOIN {_LEX} ON regexp_matches(t, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])') GROUP BY place_id, phrase""",
)
def phrase_mentions(spark, sf):
    c = cat(spark, sf, "review", "place")
    words = spark.createDataFrame(_WORDS, "phrase string, display string")
    nobody = c.place.limit(0).select(F.col("id").alias("place_id"), "name")
    return enrich.dish_mentions(nobody, c.review.filter("content is not null"), words).select("place_id", "phrase", "reviews")


# --- enrichment ------------------------------------------------------------------------


def _rule_sql() -> str:
    """The rule list as SQL rows: one CASE per rule over the folded name."""
    arms = []
    for slug, confidence, words in tax.NAME_RULES:
        tests = []
        for word in words:
            if word.startswith("^"):
                tests.append(f"regexp_matches(key, '^{word[1:]}($|[^a-z0-9_])')")
            elif word.startswith("(?<!banh )"):
                tests.append("(regexp_matches(key, '(^|[^a-z0-9_])mi($|[^a-z0-9_])') AND NOT regexp_matches(key, 'banh mi($|[^a-z0-9_])'))")
            else:
                tests.append(f"regexp_matches(key, '(^|[^a-z0-9_]){word}($|[^a-z0-9_])')")
        arms.append(f"SELECT id, '{slug}' AS slug, {confidence} AS confidence FROM keyed WHERE {' OR '.join(tests)}")
    return " UNION ALL ".join(arms)


_SUGGEST = f""", keyed AS (SELECT id, regexp_replace(normalized_name, '\\s+', ' ', 'g') AS key FROM place
    WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM place_category c WHERE c.place_id = place.id)),
  hit AS ({_rule_sql()}),
  best AS (SELECT id, max(confidence) AS confidence FROM hit GROUP BY id),
  suggestion AS (SELECT id AS place_id, min(slug) AS slug, CAST(confidence AS DOUBLE) AS confidence FROM hit JOIN best USING (id, confidence)
    GROUP BY id, confidence HAVING count(DISTINCT slug) = 1 AND confidence >= 0.75)"""


@check("E1_E2_category_suggestions", views.duck("place", "place_category") + _SUGGEST + " SELECT * FROM suggestion")
def category_suggestions(spark, sf):
    return enrich.category_suggestions(cat(spark, sf, "place", "place_category"))


_SLUGS = quoted(slug for _, slug, _ in tax.CATEGORY_SEEDS if slug != "snack")


@check(
    "E2_apply_categories",
    views.duck("place", "place_category")
    + _SUGGEST
    + f""" SELECT place_id, category_id, source FROM place_category UNION ALL
  SELECT place_id, slug, 'enrichment:category:rules:v1' FROM suggestion WHERE slug IN ({_SLUGS})""",
)
def apply_categories(spark, sf):
    c = cat(spark, sf, "place", "place_category")
    seeds = [(slug, slug, slug != "snack") for _, slug, _ in tax.CATEGORY_SEEDS]
    category = spark.createDataFrame(seeds, "id string, slug string, is_active boolean")
    rows = enrich.apply_categories(enrich.category_suggestions(c), c.with_tables(category=category))
    return rows.select("place_id", "category_id", "source")


_LEXICON = views.DUCK.rows("lexicon", ["phrase", "display"], [(p, d) for p, d, _ in tax.DISH_LEXICON])


@check(
    "E3_E4_dish_suggestions",
    views.duck("place", "review")
    + f""", named AS (SELECT id AS place_id, id % 7 = 0 AS gap, trim(regexp_replace({duck.fold('name')}, '\\s+', ' ', 'g')) AS t FROM place WHERE status = 'active'),
  said AS (SELECT place_id, id, trim(regexp_replace({duck.fold('content')}, '\\s+', ' ', 'g')) AS t FROM (
    SELECT r.place_id, r.id, p.name || '! ' || r.content AS content FROM review r JOIN place p ON p.id = (r.place_id * 31) % (SELECT count(*) FROM customer) + 1
    WHERE r.content IS NOT NULL AND r.is_visible IS NOT FALSE)),
  in_name AS (SELECT DISTINCT place_id, phrase FROM named JOIN {_LEXICON} ON regexp_matches(t, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])') WHERE gap),
  in_review AS (SELECT place_id, phrase, count(*) AS n FROM said JOIN {_LEXICON} ON regexp_matches(t, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')
    WHERE place_id IN (SELECT place_id FROM named WHERE gap) GROUP BY place_id, phrase)
  SELECT place_id, phrase AS normalized_name, CASE WHEN a.phrase IS NOT NULL THEN 0.95 WHEN n >= 2 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence
  FROM in_name a FULL JOIN in_review b USING (place_id, phrase)""",
)
def dish_suggestions(spark, sf):
    c = cat(spark, sf, "place", "review")
    # Every seventh place has no dish yet; reviews also name another place.
    dish = c.place.filter("id % 7 <> 0").select(F.col("id").alias("place_id"))
    other = c.place.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    n = views.raw(spark, sf, "customer").count()
    review = c.review.withColumn("other", F.col("place_id") * 31 % n + 1).join(other, "other").withColumn(
        "content", F.concat("other_name", F.lit("! "), "content")
    )
    rows = enrich.dish_suggestions(c.with_tables(dish=dish, review=review))
    return rows.select("place_id", "normalized_name", "confidence")


_MAP = views.DUCK.rows("mapping", ["phrase", "code"], [(p, c) for p, _, codes in tax.DISH_LEXICON for c in codes])


@check(
    "E5_attribute_links",
    views.duck("dish", "food_attribute")
    + f"SELECT dish.id AS dish_id, a.id AS attribute_id FROM dish JOIN {_MAP} ON phrase = normalized_name JOIN food_attribute a ON a.code = mapping.code AND a.is_active WHERE status = 'available'",
)
def attribute_links(spark, sf):
    return enrich.attribute_links(cat(spark, sf, "dish", "food_attribute")).select("dish_id", "attribute_id")


@check(
    "E13_enrichment_summary",
    views.duck("place", "place_category", "dish", "food_attribute")
    + _SUGGEST
    + f""" SELECT (SELECT count(*) FROM keyed) + (SELECT count(*) FROM place WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM dish WHERE place_id = place.id)) AS scanned,
  (SELECT count(*) FROM suggestion) AS categories_applied,
  (SELECT count(*) FROM dish JOIN {_MAP} ON phrase = normalized_name JOIN food_attribute a ON a.code = mapping.code AND a.is_active WHERE status = 'available') AS attributes_applied""",
)
def enrichment_summary(spark, sf):
    c = cat(spark, sf, "place", "place_category", "dish", "food_attribute", "review", "category", "dish_attribute")
    c = c.with_tables(review=c.review.filter("false"), dish=c.dish.withColumn("id", F.col("id").cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double")).drop("p_partkey"),
                      dish_attribute=c.dish_attribute.withColumn("dish_id", F.col("dish_id").cast("string")))
    # Without reviews and with dishes everywhere the dish step only counts gap places.
    no_names = c.with_tables(place=c.place)
    _, summary = enrich.enrich(no_names)
    extra = enrich.attribute_links(c).agg(F.count(F.lit(1)).alias("attributes_applied"))
    return summary.drop("dishes_applied", "attributes_applied").join(extra)


# --- documents and vectors -------------------------------------------------------------

_DOC_TABLES = ["place", "location", "category", "place_category", "dish", "food_attribute", "dish_attribute", "review"]
_DOC_SQL = """, cats AS (SELECT place_id, string_agg(name, ', ' ORDER BY name) AS v FROM (SELECT DISTINCT place_id, name FROM place_category JOIN category ON category.id = category_id) GROUP BY place_id),
  dishes AS (SELECT place_id, string_agg(name, ', ' ORDER BY name) AS v FROM (SELECT DISTINCT place_id, name FROM dish WHERE status = 'available') GROUP BY place_id),
  attrs AS (SELECT place_id, string_agg(name, ', ' ORDER BY name) AS v FROM (SELECT DISTINCT place_id, a.name FROM dish JOIN dish_attribute ON dish_id = dish.id JOIN food_attribute a ON a.id = attribute_id AND a.is_active WHERE status = 'available') GROUP BY place_id),
  revs AS (SELECT place_id, string_agg(t, '; ' ORDER BY rn) AS v FROM (SELECT place_id, CASE WHEN len(content) > 110 THEN left(content, 110) || '…' ELSE content END AS t,
    row_number() OVER (PARTITION BY place_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn FROM review WHERE content IS NOT NULL AND is_visible IS NOT FALSE) WHERE rn <= 4 GROUP BY place_id),
  parts AS (SELECT place.id AS place_id, list_filter([trim(name), 'profile: ' || semantic_profile, 'categories: ' || cats.v, 'dishes: ' || dishes.v, 'attributes: ' || attrs.v,
    'reviews: ' || revs.v, 'location: ' || district || ', ' || city, 'price level: ' || price_level || '/4', 'normalized name: ' || trim(normalized_name)], lambda p: p IS NOT NULL) AS parts
  FROM place JOIN location ON location.id = location_id LEFT JOIN cats ON cats.place_id = place.id LEFT JOIN dishes ON dishes.place_id = place.id
  LEFT JOIN attrs ON attrs.place_id = place.id LEFT JOIN revs ON revs.place_id = place.id WHERE status IN ('active', 'temporarily_closed')),
  doc AS (SELECT place_id, left(rtrim(list_reduce(parts, lambda a, p: CASE WHEN ends_with(a, chr(1)) THEN a WHEN len(a || ' | ' || p) > 8000 THEN a || chr(1) ELSE a || ' | ' || p END), chr(1)), 8000) AS document FROM parts)"""


@check("E7_E9_documents", views.duck(*_DOC_TABLES) + _DOC_SQL + " SELECT place_id, document FROM doc")
def search_documents(spark, sf):
    return documents.documents(cat(spark, sf, *_DOC_TABLES)).select("place_id", "document")


_HASH = """, hashed AS (SELECT place_id, sha256('{"template":"search-document:v3","document":' || to_json(document) || '}') AS content_hash FROM doc)"""


@check(
    "E8_E11_vector_targets",
    views.duck("vector", *_DOC_TABLES)
    + _DOC_SQL
    + _HASH
    + """, stored AS (SELECT place_id, content_hash AS h FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY created_at DESC, id DESC) AS rn FROM vector WHERE model = 'm@doc:v3') WHERE rn = 1)
  SELECT place_id, content_hash, h IS NOT NULL AS has_existing FROM hashed LEFT JOIN stored USING (place_id) WHERE h IS NULL OR h <> content_hash""",
)
def vector_targets(spark, sf):
    c = cat(spark, sf, "vector", *_DOC_TABLES)
    rows = documents.vector_targets(documents.documents(c), c.vector, documents.model_id("m"), refresh=True)
    return rows.select("place_id", "content_hash", "has_existing")


@check(
    "E12_write_vectors",
    views.duck("vector")
    + """, delivered AS (SELECT place_id, model FROM vector WHERE id % 3 = 0)
  SELECT place_id, model, id, 'old' AS kind FROM vector WHERE (place_id, model) NOT IN (SELECT (place_id, model) FROM delivered)
  UNION ALL SELECT place_id, model, id, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY place_id, model ORDER BY created_at DESC, id DESC) AS rn FROM vector WHERE id % 3 = 0) WHERE rn = 1""",
)
def write_vectors(spark, sf):
    stored = views.frame(spark, sf, "vector").withColumn("content_hash", F.lit("old"))
    incoming = views.frame(spark, sf, "vector").filter("id % 3 = 0").withColumn("content_hash", F.lit("new"))
    return documents.write_vectors(stored, incoming).select("place_id", "model", "id", F.col("content_hash").alias("kind"))


@check(
    "E10_profile_inputs",
    views.duck(*_DOC_TABLES)
    + """, d AS (SELECT place_id, string_agg(name, '|' ORDER BY rn) AS v FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS rn FROM dish WHERE status = 'available' AND length(trim(name)) > 0) WHERE rn <= 6 GROUP BY place_id),
  c AS (SELECT place_id, string_agg(name, '|' ORDER BY name) AS v FROM (SELECT DISTINCT place_id, name FROM place_category JOIN category ON category.id = category_id WHERE is_active) GROUP BY place_id)
  SELECT place.id AS place_id, district, c.v AS categories, d.v AS dishes, CASE price_level WHEN 1 THEN 'bình dân' WHEN 2 THEN 'trung bình' WHEN 3 THEN 'khá cao' WHEN 4 THEN 'cao cấp' END AS price_phrase
  FROM place JOIN location ON location.id = location_id LEFT JOIN d ON d.place_id = place.id LEFT JOIN c ON c.place_id = place.id
  WHERE status = 'active' AND (semantic_profile IS NULL OR trim(semantic_profile) = '')""",
)
def profile_inputs(spark, sf):
    rows = documents.profile_inputs(cat(spark, sf, *_DOC_TABLES))
    return rows.select("place_id", "district", F.array_join("categories", "|").alias("categories"), F.array_join("dishes", "|").alias("dishes"), "price_phrase")


@check(
    "E10_apply_profiles",
    views.duck("place", "category")
    + """, given AS (SELECT l_suppkey % (SELECT count(*) FROM customer) + 1 AS place_id, arg_min(l_comment, k) AS profile FROM (
    SELECT l_suppkey * 13 + l_linenumber AS l_suppkey, l_orderkey * 10 + l_linenumber AS k, 'profile ' || l_orderkey AS l_comment FROM lineitem) GROUP BY 1)
  SELECT id, CASE WHEN semantic_profile IS NULL AND profile IS NOT NULL THEN profile ELSE semantic_profile END AS semantic_profile FROM place LEFT JOIN given ON place_id = id""",
)
def apply_profiles(spark, sf):
    c = cat(spark, sf, "place", "category", "place_category")
    n = views.raw(spark, sf, "customer").count()
    results = views.raw(spark, sf, "lineitem").select(
        ((F.col("l_suppkey") * 13 + F.col("l_linenumber")) % n + 1).alias("place_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.concat(F.lit("profile "), F.col("l_orderkey").cast("string")).alias("profile"), F.lit("economy").alias("category"),
    )
    place, _ = documents.apply_profiles(results, c, now())
    return place.select("id", "semantic_profile")


# --- repairs and audit -------------------------------------------------------------------


@check(
    "R1_fill_coordinates",
    views.duck("place", "location", "place_source", "data_source")
    + """, pin AS (SELECT location_id, arg_min(regexp_extract(source_url, '!3d(-?[0-9]+[.]?[0-9]*)', 1), s.id)::DOUBLE AS plat, arg_min(regexp_extract(source_url, '!4d(-?[0-9]+[.]?[0-9]*)', 1), s.id)::DOUBLE AS plon
    FROM place_source s JOIN data_source d ON d.id = data_source_id JOIN place ON place.id = s.place_id WHERE code = 'google_maps_playwright' AND source_url LIKE '%!3d%!4d%' GROUP BY location_id)
  SELECT id, round(coalesce(lat, plat), 4) AS lat, round(CASE WHEN lat IS NULL THEN plon ELSE lon END, 4) AS lon FROM location LEFT JOIN pin ON location_id = id""",
)
def fill_coordinates(spark, sf):
    rows = repair.fill_coordinates(cat(spark, sf, "place", "location", "place_source", "data_source"), now())
    return rows.select("id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


def _broken(name: str) -> str:
    return f"CASE WHEN p_partkey % 5 = 1 THEN concat(substr({name}, 1, 2), chr(65533), substr({name}, 3)) WHEN p_partkey % 5 = 2 THEN concat(chr(65533), 'zz') ELSE {name} END"


@check(
    "R2_drop_corrupted_dishes",
    views.duck("dish")
    + f""", broken AS (SELECT id, place_id, {_broken('name')} AS name FROM dish)
  SELECT id, place_id FROM broken b WHERE NOT (contains(name, chr(65533)) AND EXISTS (SELECT 1 FROM broken c WHERE c.place_id = b.place_id AND NOT contains(c.name, chr(65533))))""",
)
def drop_corrupted_dishes(spark, sf):
    rows = views.frame(spark, sf, "dish").withColumn("name", F.expr(_broken("name").replace("chr(65533)", "decode(X'EFBFBD', 'UTF-8')")))
    return repair.drop_corrupted_dishes(rows).select("id", "place_id")


_JUNK = " OR ".join(
    [f"starts_with(k, '{p}')" for p in tax.JUNK_NAME_PREFIXES]
    + [f"regexp_matches(k, '(^|[^a-z0-9]){w}($|[^a-z0-9])')" for w in tax.JUNK_NAME_WORDS]
)


@check(
    "R3_F15_reject_places",
    views.duck("place", "place_source", "data_source")
    + f""", flagged AS (SELECT id FROM (SELECT id, replace({duck.fold('name')}, 'đ', 'd') AS k FROM place) WHERE {_JUNK}),
  source AS (SELECT s.id, place_id, CASE WHEN place_id IN (SELECT id FROM flagged) AND code = 'google_maps_playwright' AND status = 'active' THEN 'invalid' ELSE status END AS status FROM place_source s JOIN data_source d ON d.id = data_source_id)
  SELECT 'place' AS kind, id, CASE WHEN id IN (SELECT id FROM flagged) AND NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = place.id AND s.status = 'active') THEN 'unknown' ELSE status END AS status FROM place
  UNION ALL SELECT 'source', id, status FROM source""",
)
def reject_places(spark, sf):
    c = cat(spark, sf, "place", "place_source", "data_source")
    sources, place = repair.reject_places(c, repair.is_junk(F.col("name")), now())
    return place.select(F.lit("place").alias("kind"), "id", "status").unionByName(sources.select(F.lit("source").alias("kind"), "id", "status"))


_URLS = "CASE WHEN id % 2 = 0 THEN concat('https://lh3.googleusercontent.com/p/', CAST(id % 7 AS STRING), '=w', CAST(80 + id AS STRING), '-h114-k-no') ELSE url END"


@check(
    "R4_W1_X14_collapse_images",
    views.duck("image")
    + f"""SELECT place_id, place_source_id, id, base AS url FROM (SELECT *, row_number() OVER (PARTITION BY place_id, place_source_id, base ORDER BY is_cover DESC, sort_order, id) AS rn
  FROM (SELECT * EXCLUDE url, regexp_replace(u, CASE WHEN u LIKE '%googleusercontent.com%' THEN '=w[0-9]+(-h[0-9]+)?(-[a-z0-9]+)*$' ELSE '^$' END, '') AS base FROM (SELECT *, {_URLS} AS u FROM image))) WHERE rn = 1""",
)
def collapse_images(spark, sf):
    rows = views.frame(spark, sf, "image").withColumn("url", F.expr(_URLS))
    return repair.collapse_images(rows).select("place_id", "place_source_id", "id", "url")


@check(
    "R5_clear_invented_counts",
    views.duck("place", "place_source")
    + """SELECT id, CASE WHEN rc = 0 AND NOT EXISTS (SELECT 1 FROM place_source s WHERE s.place_id = p.id AND s.status = 'active' AND source_review_count IS NOT NULL) THEN NULL ELSE rc END AS review_count
  FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 0 ELSE review_count END AS rc FROM place) p""",
)
def clear_invented_counts(spark, sf):
    c = cat(spark, sf, "place", "place_source")
    zeroed = c.place.withColumn("review_count", F.when(F.col("id") % 4 == 0, F.lit(0)).otherwise(F.col("review_count")))
    return repair.clear_invented_counts(c.with_tables(place=zeroed), now()).select("id", "review_count")


@check(
    "R6_J16_remove_retired_sources",
    views.duck("data_source", "place_source", "crawl_run", "processing_record", "review", "image")
    + """, gone AS (SELECT id FROM data_source WHERE code IN ('fixture', 'google_maps') AND NOT is_active),
  gone_source AS (SELECT id FROM place_source WHERE data_source_id IN (SELECT id FROM gone)),
  gone_run AS (SELECT id FROM crawl_run WHERE data_source_id IN (SELECT id FROM gone)),
  r AS (SELECT id, 2000000 + place_source_id AS sid FROM review)
  SELECT 'data_source' AS kind, count(*) AS n FROM data_source WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'place_source', count(*) FROM place_source WHERE id NOT IN (SELECT id FROM gone_source)
  UNION ALL SELECT 'crawl_run', count(*) FROM crawl_run WHERE id NOT IN (SELECT id FROM gone_run)
  UNION ALL SELECT 'processing_record', count(*) FROM processing_record WHERE crawl_run_id NOT IN (SELECT id FROM gone_run)
  UNION ALL SELECT 'review', count(*) FROM r WHERE sid NOT IN (SELECT id FROM gone_source)
  UNION ALL SELECT 'image', count(*) FROM image""",
)
def remove_retired_sources(spark, sf):
    c = cat(spark, sf, "data_source", "place_source", "crawl_run", "processing_record", "review", "image")
    c = c.with_tables(review=c.review.withColumn("place_source_id", F.col("place_source_id") + 2000000))
    kept = repair.remove_retired_sources(c).tables()
    rows = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in kept.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@check("R8_deactivate_sources", views.duck("data_source") + "SELECT code, is_active AND code NOT IN ('import') AS is_active FROM data_source")
def deactivate_sources(spark, sf):
    return repair.deactivate_sources(views.frame(spark, sf, "data_source"), ("import",)).select("code", "is_active")


@check(
    "R7_audit",
    views.duck("place", "dish", "hours", "review", "image", "place_category", "category")
    + """SELECT 'place' AS table_name, 'rating' AS rule, count(*) FILTER (WHERE NOT rating BETWEEN 0 AND 5) AS violations FROM place
  UNION ALL SELECT 'place', 'price level', count(*) FILTER (WHERE NOT price_level BETWEEN 1 AND 4) FROM place
  UNION ALL SELECT 'place', 'review count', count(*) FILTER (WHERE NOT review_count >= 0) FROM place
  UNION ALL SELECT 'hours', 'day', count(*) FILTER (WHERE NOT day_of_week BETWEEN 1 AND 7) FROM hours
  UNION ALL SELECT 'review', 'rating', count(*) FILTER (WHERE NOT rating BETWEEN 0 AND 5) FROM review
  UNION ALL SELECT 'dish', 'unique place_id, normalized_name', count(*) FROM (SELECT 1 FROM dish GROUP BY place_id, normalized_name HAVING count(*) > 1)
  UNION ALL SELECT 'category', 'unique slug', count(*) FROM (SELECT 1 FROM category GROUP BY slug HAVING count(*) > 1)
  UNION ALL SELECT 'place_category', 'category_id in category', count(*) FROM place_category WHERE category_id NOT IN (SELECT id FROM category)
  UNION ALL SELECT 'review', 'repeated content', count(*) FROM (SELECT 1 FROM review WHERE is_visible AND content IS NOT NULL GROUP BY place_id, content HAVING count(*) > 1)""",
)
def run_audit(spark, sf):
    rows = audit.audit(cat(spark, sf, "place", "dish", "hours", "review", "image", "place_category", "category"))
    shown = ["rating", "price level", "review count", "day", "unique place_id, normalized_name", "unique slug", "category_id in category", "repeated content"]
    return rows.filter(F.col("rule").isin(shown) & F.col("table_name").isin("place", "hours", "review", "dish", "category", "place_category"))


@check(
    "A12_field_coverage",
    """SELECT event_type, count(*) AS sources, round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 6) AS rating, round(avg(CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0.0 END), 6) AS images
  FROM events GROUP BY event_type""",
)
def field_coverage(spark, sf):
    flags = F.to_json(F.struct(F.struct((F.col("value") > 5).alias("rating"), (F.col("event_id") % 4).alias("images")).alias("extracted")))
    rows = audit.field_coverage(views.raw(spark, sf, "events").withColumn("raw_data", flags), ["event_type"], ["rating", "images"])
    return rows.select("event_type", "sources", F.round("rating", 6).alias("rating"), F.round("images", 6).alias("images"))


# --- remaining columns -----------------------------------------------------------------


@check(
    "X2_X23_match_key",
    "SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\\s+', ' ', 'g'))) AS k, CASE doc_id % 5 WHEN 1 THEN 'bình dân' WHEN 2 THEN 'trung bình' WHEN 3 THEN 'khá cao' WHEN 4 THEN 'cao cấp' END AS price FROM documents",
)
def match_key(spark, sf):
    rows = views.raw(spark, sf, "documents")
    price = documents.price_phrase((F.col("doc_id") % 5).cast("int"))
    return rows.select("doc_id", F.md5(tx.match_key("text")).alias("k"), price.alias("price"))


@check(
    "X12_stable_external_id",
    views.duck("place", "location")
    + """SELECT place.id, 'gmaps_' || left(sha256(lower(concat_ws('|', name, address_line, CAST(lat AS STRING), CAST(lon AS STRING)))), 32) AS external_id
  FROM place JOIN location ON location.id = location_id""",
)
def stable_external_id(spark, sf):
    c = cat(spark, sf, "place", "location")
    rows = c.place.select("id", "name", "location_id").join(
        c.location.select(F.col("id").alias("location_id"), "address_line", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("at")), "location_id"
    )
    return rows.select("id", scan.stable_external_id(F.col("name"), F.col("address_line"), F.col("at")).alias("external_id"))


@check(
    "U6_F16_photos",
    """WITH i AS (SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'https://lh3.googleusercontent.com/p/' || (event_id % 30) || '=w80-h60-k' WHEN 1 THEN 'https://x.example/' || (event_id % 9)
    WHEN 2 THEN 'https://maps.gstatic.com/' || event_id WHEN 3 THEN 'https://lh3.googleusercontent.com/p/' || (event_id % 30) || '=s99' ELSE 'https://u.example/a/B' || event_id END AS url,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS alt FROM events),
  base AS (SELECT user_id, event_id, alt, CASE WHEN contains(url, 'googleusercontent.com') THEN regexp_replace(url, '=[^/?]+$', '') ELSE url END AS url FROM i WHERE event_id % 5 IN (0, 1, 3)),
  one AS (SELECT user_id, url, min(event_id) AS at_event, arg_min(alt, event_id) FILTER (WHERE alt <> '') AS alt FROM base GROUP BY user_id, url)
  SELECT user_id, string_agg(url || '~' || coalesce(alt, ''), ' ' ORDER BY at_event) AS photos FROM one GROUP BY user_id""",
)
def photos(spark, sf):
    e = views.raw(spark, sf, "events")
    host, k = F.lit("https://lh3.googleusercontent.com/p/"), F.col("event_id") % 5
    thirty = (F.col("event_id") % 30).cast("string")
    url = (
        F.when(k == 0, F.concat(host, thirty, F.lit("=w80-h60-k"))).when(k == 1, F.concat(F.lit("https://x.example/"), (F.col("event_id") % 9).cast("string")))
        .when(k == 2, F.concat(F.lit("https://maps.gstatic.com/"), F.col("event_id").cast("string"))).when(k == 3, F.concat(host, thirty, F.lit("=s99")))
        .otherwise(F.concat(F.lit("https://u.example/a/B"), F.col("event_id").cast("string")))
    )
    alt = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type"))
    image = F.struct("event_id", F.struct(url.alias("url"), alt.alias("alt_text")).alias("i"))
    rows = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(image)), lambda x: x["i"]).alias("images"))
    shown = F.transform(scan.photos(F.col("images")), lambda i: F.concat(i["url"], F.lit("~"), F.coalesce(i["alt_text"], F.lit(""))))
    return rows.select("user_id", F.array_join(shown, " ").alias("photos")).filter("photos <> ''")


@check(
    "W5_first_category",
    views.duck("place_category", "category")
    + "SELECT place_id, min(name) AS category FROM place_category JOIN category ON category.id = category_id WHERE is_active GROUP BY place_id",
)
def first_category(spark, sf):
    return listings.first_category(cat(spark, sf, "place_category", "category"))


@check(
    "F25_X27_dish_text",
    views.duck("dish", "place")
    + f"""SELECT dish.id FROM dish JOIN place ON place.id = place_id WHERE dish.name ILIKE '%BO%' OR dish.normalized_name ILIKE '%BO%' OR replace({duck.fold('dish.name')}, 'đ', 'd') LIKE '%bo%'
  OR dish.description ILIKE '%BO%' OR place.name ILIKE '%BO%'""",
)
def dish_text(spark, sf):
    c = cat(spark, sf, "dish", "place")
    named = c.place.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"))
    return c.dish.join(named, "place_id").filter(listings.dish_matches("BO")).select("id")
