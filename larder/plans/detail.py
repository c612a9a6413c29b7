"""Detail pages for a table of places.

The header carries the lists that cannot grow without bound: one week of sessions and
the newest 20 reviews.  Dishes and images have no bound, so they are separate tables in
page order, sorted across the cluster by range; a place with a million dishes is then
many sort tasks and never one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.catalog import Catalog
from larder.functions import text as tx
from larder.operators import lookups
from larder.operators.topk import top_rows

REVIEWS_SHOWN = 20


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted, "place_id", "left_semi")


def newest_reviews(review: DataFrame, most: int = REVIEWS_SHOWN) -> DataFrame:
    """Newest visible reviews of every place, numbered from 1."""
    order = [F.desc_nulls_last("reviewed_at"), F.desc("id")]
    return top_rows(lookups.visible_reviews(review), ["place_id"], order, most, "id")


def detail_headers(wanted: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per active wanted place: summary, sessions by day, newest reviews."""
    wanted = wanted.select("place_id").distinct()
    facts = _only(lookups.place_facts(catalog), wanted)
    extra = catalog.place.select(F.col("id").alias("place_id"), "description", "phone", "website_url")
    session = F.struct("day_of_week", "opens_min", "id", "closes_min", "is_closed", "spans_next_day")
    hours = _only(catalog.hours, wanted).groupBy("place_id").agg(
        F.transform(
            # One row per day and pair of times can exist, whatever the source repeats.
            F.array_sort(F.collect_set(session)),
            lambda h: F.struct(
                h["day_of_week"].alias("day_of_week"), tx.clock(h["opens_min"]).alias("opens_at"),
                tx.clock(h["closes_min"]).alias("closes_at"), h["is_closed"].alias("is_closed"), h["spans_next_day"].alias("spans_next_day"),
            ),
        ).alias("opening_hours")
    )
    shown = newest_reviews(_only(catalog.review, wanted))
    reviews = shown.groupBy("place_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "rating", "content", "reviewed_at", "language_code"))).alias("reviews")
    )
    rows = lookups.with_links(facts, catalog).join(extra, "place_id").join(hours, "place_id", "left").join(reviews, "place_id", "left")
    return rows.drop("normalized_name", "semantic_profile", "slugs", "district", "city")


def detail_dishes(wanted: DataFrame, catalog: Catalog) -> DataFrame:
    """Available dishes of wanted places: popular first, then by name."""
    dish = _only(lookups.available_dishes(catalog.dish), wanted.select("place_id").distinct())
    order = [F.col("place_id"), F.desc("is_popular"), F.col("name"), F.col("id")]
    return dish.select("place_id", "id", "name", "description", "price_amount", "currency_code", "is_popular").orderBy(*order)


def detail_images(wanted: DataFrame, catalog: Catalog) -> DataFrame:
    """Active images of wanted places by sort order."""
    image = _only(lookups.active_images(catalog.image), wanted.select("place_id").distinct())
    return image.select("place_id", "id", "url", "alt_text", "is_cover", "sort_order").orderBy("place_id", "sort_order", "id")
