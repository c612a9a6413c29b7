"""SQL fragments for the DuckDB side of the checks."""

from __future__ import annotations


def trigrams(x: str) -> str:
    return (
        "list_distinct(flatten([[substr('  ' || w || ' ', CAST(i AS BIGINT), 3) for i in range(1, len(w) + 2)] "
        f"for w in regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')]))"
    )


def sim(a: str, b: str) -> str:
    """Similarity of two trigram lists."""
    return f"(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(len(list_distinct(list_concat({a}, {b}))), 1))"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def epoch(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


COVER = """cover AS (
  SELECT place_id, url AS cover_image_url FROM (
    SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY sort_order, id) AS rn
    FROM image WHERE is_cover AND status = 'active') WHERE rn = 1)"""
SOURCE_URL = """source_link AS (
  SELECT place_id, source_url FROM (
    SELECT place_source.*, row_number() OVER (PARTITION BY place_id ORDER BY last_seen_at DESC, place_source.id) AS rn
    FROM place_source JOIN data_source ON data_source.id = data_source_id
    WHERE code = 'google_maps_playwright' AND status = 'active' AND source_url IS NOT NULL) WHERE rn = 1)"""
CATEGORY_SETS = """category_set AS (
  SELECT place_id, string_agg(name || ':' || slug, ',' ORDER BY name, slug) AS categories,
         list(slug) AS slugs
  FROM (SELECT DISTINCT place_id, name, slug FROM place_category JOIN category ON category.id = category_id WHERE is_active)
  GROUP BY place_id)"""
FACTS = """facts AS (
  SELECT place.id AS place_id, place.name, normalized_name, price_level, rating, review_count, semantic_profile,
         place.updated_at, formatted_address, district, city, lat, lon, coalesce(categories, '') AS categories,
         coalesce(slugs, []) AS slugs
  FROM place JOIN location ON location.id = location_id LEFT JOIN category_set ON category_set.place_id = place.id
  WHERE status = 'active')"""
STOP = "['" + "','".join(
    "an cho co di gi gan minh muon nay nhe nhung quan tim va voi o mon theo dang bua buoi".split()
) + "']"
