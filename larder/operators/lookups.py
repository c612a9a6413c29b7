"""Per-place lookups: cover image, source link, categories, latest vector, open hours.

Each is one aggregate keyed by place, so it combines before its shuffle and a place
with millions of children costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import taxonomy
from larder.catalog import Catalog
from larder.operators.lineage import cut
from larder.operators.topk import first_by


def active_places(place: DataFrame) -> DataFrame:
    return place.filter("status = 'active'")


def available_dishes(dish: DataFrame) -> DataFrame:
    return dish.filter("status = 'available'")


def active_images(image: DataFrame) -> DataFrame:
    return image.filter("status = 'active'")


def visible_reviews(review: DataFrame) -> DataFrame:
    """Reviews shown on a detail page: visible and with text."""
    return review.filter(
        F.col("is_visible") & F.col("content").isNotNull() & (F.length(F.trim("content")) > 0)
    )


def cover_images(image: DataFrame) -> DataFrame:
    """(place_id, cover_image_url): first active cover by sort order."""
    covers = active_images(image).filter("is_cover")
    return first_by(
        covers.select("place_id", "sort_order", "id", F.col("url").alias("cover_image_url")),
        ["place_id"],
        [F.col("sort_order"), F.col("id")],
        ["cover_image_url"],
    )


def source_urls(catalog: Catalog, provider: str = taxonomy.SCAN_PROVIDER) -> DataFrame:
    """(place_id, source_url): newest active source URL of one provider."""
    sources = catalog.place_source.filter("status = 'active' and source_url is not null")
    providers = catalog.data_source.filter(F.col("code") == provider).select(
        F.col("id").alias("data_source_id")
    )
    return first_by(
        sources.join(providers, "data_source_id", "left_semi"),
        ["place_id"],
        [-F.unix_micros("last_seen_at"), F.col("id")],
        ["source_url"],
    )


def active_category_links(catalog: Catalog) -> DataFrame:
    """(place_id, category_id, slug, category_name) of active categories."""
    category = catalog.category.filter("is_active").select(
        F.col("id").alias("category_id"), "slug", F.col("name").alias("category_name")
    )
    return catalog.place_category.select("place_id", "category_id").join(category, "category_id")


def category_sets(catalog: Catalog) -> DataFrame:
    """(place_id, categories, slugs): distinct active categories, sorted.

    A set can never outgrow the category taxonomy.
    """
    links = active_category_links(catalog)
    return (
        links.groupBy("place_id")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("category_name").alias("name"), "slug"))).alias("categories"))
        .withColumn("slugs", F.array_distinct(F.col("categories.slug")))
    )


def latest_vectors(vector: DataFrame) -> DataFrame:
    """(place_id, model, embedding, content_hash): newest vector per place and model."""
    newest = F.max(F.struct("created_at", "id", "embedding", "content_hash")).alias("v")
    return vector.groupBy("place_id", "model").agg(newest).select(
        "place_id", "model", "v.embedding", "v.content_hash"
    )


def open_at(hours: DataFrame, moments: DataFrame) -> DataFrame:
    """(day_of_week, minute, place_id) of places open at each moment.

    `moments` has `day_of_week` (1 = Monday) and `minute`.  A session that runs past
    midnight counts for the day it is listed under, before and after midnight.
    """
    session = F.when(
        F.col("spans_next_day"),
        (F.col("minute") >= F.col("opens_min")) | (F.col("minute") <= F.col("closes_min")),
    ).otherwise(F.col("minute").between(F.col("opens_min"), F.col("closes_min")))
    return (
        hours.filter("not is_closed")
        .join(moments.select("day_of_week", "minute").distinct(), "day_of_week")
        .filter(session)
        .select("day_of_week", "minute", "place_id")
        .distinct()
    )


def place_facts(catalog: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Active places with location and category set: one row per place, of those in `ids.place_id` if given."""
    place = active_places(catalog.place)
    if ids is not None:
        place = place.join(ids.select(F.col("place_id").alias("id")), "id", "left_semi")
        catalog = catalog.with_tables(place_category=catalog.place_category.join(ids, "place_id", "left_semi"))
    location = catalog.location.select(
        F.col("id").alias("location_id"), "formatted_address", "district", "city", "lat", "lon"
    )
    empty = F.array().cast("array<struct<name:string,slug:string>>")
    return (
        place.select(
            F.col("id").alias("place_id"), "name", "normalized_name", "location_id",
            "price_level", F.col("rating").cast("double").alias("rating"), "review_count",
            "semantic_profile", "updated_at",
        )
        .join(location, "location_id")
        .join(category_sets(catalog), "place_id", "left")
        .withColumn("categories", F.coalesce("categories", empty))
        .withColumn("slugs", F.coalesce("slugs", F.array().cast("array<string>")))
        .drop("location_id")
    )


def with_links(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds cover image and source URL to rows that have `place_id`.

    `rows` are a page: written once, their places alone are looked up.
    """
    rows = cut(rows)
    ids = rows.select("place_id").distinct()
    catalog = catalog.with_tables(
        image=catalog.image.join(ids, "place_id", "left_semi"), place_source=catalog.place_source.join(ids, "place_id", "left_semi")
    )
    return rows.join(cover_images(catalog.image), "place_id", "left").join(
        source_urls(catalog), "place_id", "left"
    )
