"""Dish, category and saved-place listings, trending lists, adaptive radius."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.functions import geo
from larder.functions import text as tx
from larder.operators import lookups
from larder.operators.geo_join import holding_radius, within_radius
from larder.operators.lineage import cut
from larder.operators.topk import top_rows
from larder.plans.search import search


def clamp_limit(limit: int | float | None, default: int, most: int = 50) -> int:
    return default if limit is None else int(min(max(int(limit), 1), most))


# --- dishes ----------------------------------------------------------------------


def first_category(catalog: Catalog) -> DataFrame:
    """(place_id, category): alphabetically first active category name."""
    return lookups.active_category_links(catalog).groupBy("place_id").agg(F.min("category_name").alias("category"))


def _unaccent(text: Column) -> Column:
    return F.translate(tx.strip_marks(text), "đĐ", "dD")


def dish_matches(query: str) -> Column:
    """Text condition of the dish listing over dish and place columns."""
    pattern = tx.like_pattern(F.lit(query))
    plain = tx.like_pattern(_unaccent(F.lit(query)))
    tests = [
        tx.contains_like("name", pattern), tx.contains_like("normalized_name", pattern),
        tx.contains_like(_unaccent(F.col("name")), plain), tx.contains_like(_unaccent(F.col("normalized_name")), plain),
        tx.contains_like("description", pattern), tx.contains_like("place_name", pattern),
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def dish_listing(
    catalog: Catalog,
    limit: int | None = None,
    query: str | None = None,
    category: str | None = None,
    price_level: int | None = None,
    open_at: Column | None = None,
) -> DataFrame:
    """Available dishes of active places: popular, then best rated, then by name."""
    place = lookups.active_places(catalog.place).select(
        F.col("id").alias("place_id"), F.col("name").alias("place_name"), "rating", F.col("price_level").alias("place_price")
    )
    if price_level is not None and 1 <= price_level <= 4:
        place = place.filter(F.col("place_price") == price_level)
    if category and category.strip():
        linked = lookups.active_category_links(catalog).filter(F.col("slug") == category.strip())
        place = place.join(linked.select("place_id"), "place_id", "left_semi")
    if open_at is not None:
        spark = place.sparkSession
        moment = spark.range(1).select(
            (F.weekday(open_at) + 1).alias("day_of_week"), (F.hour(open_at) * 60.0 + F.minute(open_at) + F.second(open_at) / 60.0).alias("minute")
        )
        place = place.join(lookups.open_at(catalog.hours, moment).select("place_id"), "place_id", "left_semi")
    rows = lookups.available_dishes(catalog.dish).join(place, "place_id")
    if query and query.strip():
        rows = rows.filter(dish_matches(query.strip()))
    order = [F.desc("is_popular"), F.desc_nulls_last("rating"), F.col("name"), F.col("id")]
    top = rows.orderBy(*order).limit(clamp_limit(limit, 20))
    return _dish_columns(top, catalog)


def dish_detail(wanted: DataFrame, catalog: Catalog) -> DataFrame:
    """Available dishes of active places named in `wanted.id`."""
    place = lookups.active_places(catalog.place).select(
        F.col("id").alias("place_id"), F.col("name").alias("place_name"), "rating"
    )
    rows = lookups.available_dishes(catalog.dish).join(wanted.select("id"), "id", "left_semi").join(place, "place_id")
    return _dish_columns(rows, catalog)


def _dish_columns(rows: DataFrame, catalog: Catalog) -> DataFrame:
    return (
        rows.join(lookups.cover_images(catalog.image), "place_id", "left")
        .join(first_category(catalog), "place_id", "left")
        .select(
            "id", "name", "description", "price_amount", "currency_code", "is_popular", "place_id", "place_name", "rating",
            F.col("cover_image_url").alias("image_url"), "category",
        )
    )


def dishes_of_results(results: DataFrame, dishes: DataFrame) -> DataFrame:
    """Listed dishes matched back to the result places, one row per pair."""
    return results.select("request_id", "place_id").join(
        dishes.select("place_id", F.col("id").alias("dish_id"), F.col("name").alias("dish_name")), "place_id"
    )


# --- categories --------------------------------------------------------------------


def category_listing(catalog: Catalog) -> DataFrame:
    """Active categories with parent slug and number of active places, by name."""
    category = catalog.category
    parent = category.select(F.col("id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    active = lookups.active_places(catalog.place).select(F.col("id").alias("place_id"))
    counts = (
        catalog.place_category.select("place_id", "category_id").join(active, "place_id", "left_semi")
        .groupBy("category_id").agg(F.count_distinct("place_id").alias("place_count"))
    )
    return (
        category.filter("is_active")
        .join(parent, "parent_id", "left")
        .join(counts, F.col("id") == F.col("category_id"), "left")
        .select("slug", "name", "description", "parent_slug", F.coalesce("place_count", F.lit(0)).alias("place_count"))
        .orderBy("name", "slug")
    )


# --- saved places --------------------------------------------------------------------


def saved_counts(saved: DataFrame, catalog: Catalog, limit: int = 12) -> DataFrame:
    """(user_id, total_count, total_pages) over active places."""
    active = lookups.active_places(catalog.place).select(F.col("id").alias("place_id"))
    return saved.join(active, "place_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_count")).withColumn(
        "total_pages", F.ceil(F.col("total_count") / limit)
    )


def saved_lists(saved: DataFrame, catalog: Catalog, limit: int = 12, after: DataFrame | None = None) -> DataFrame:
    """One page of every user's saved places, newest first, with `has_next`.

    `after` (user_id, after_created_at, after_place_id) continues a user's list.
    """
    limit = clamp_limit(limit, 12)
    facts = lookups.place_facts(catalog)
    rows = saved.join(facts.select("place_id"), "place_id", "left_semi")
    if after is not None:
        position = F.struct(F.col("created_at").alias("t"), F.col("place_id").alias("i")) < F.struct(
            F.col("after_created_at").alias("t"), F.col("after_place_id").alias("i")
        )
        rows = rows.join(after, "user_id").filter(position).drop("after_created_at", "after_place_id")
    order = [F.desc("created_at"), F.desc("place_id")]
    top = top_rows(rows, ["user_id"], order, limit + 1, "place_id")
    more = top.filter(F.col("rank") == limit + 1).select("user_id", F.lit(True).alias("has_next"))
    page = (
        top.filter(F.col("rank") <= limit)
        .join(more, "user_id", "left")
        .withColumn("has_next", F.coalesce("has_next", F.lit(False)))
        .join(facts, "place_id")
    )
    return lookups.with_links(page, catalog)


def apply_saves(saved: DataFrame, changes: DataFrame, catalog: Catalog) -> DataFrame:
    """`saved` after a change log (user_id, place_id, op, at): a removal ends what was saved
    before it; saving twice keeps the first time since then; only active places can be saved."""
    pair = ["user_id", "place_id"]
    removed = changes.filter("op = 'remove'").groupBy(*pair).agg(F.max("at").alias("removed_at"))
    active = lookups.active_places(catalog.place).select(F.col("id").alias("place_id"))
    later = changes.filter("op = 'save'").join(active, "place_id", "left_semi").join(removed, pair, "left")
    added = later.filter("removed_at is null or at >= removed_at").groupBy(*pair).agg(F.min("at").alias("created_at"))
    kept = saved.join(removed, pair, "left_anti")
    fresh = added.join(kept.select(*pair), pair, "left_anti")
    return kept.select("user_id", "place_id", "created_at").unionByName(fresh.select("user_id", "place_id", "created_at"))


def is_saved(pairs: DataFrame, saved: DataFrame) -> DataFrame:
    flags = saved.select("user_id", "place_id").distinct().withColumn("is_saved", F.lit(True))
    return pairs.join(flags, ["user_id", "place_id"], "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


# --- map and discovery ------------------------------------------------------------------


def in_map_window(places: DataFrame, bounds: tuple[float, float, float, float] = tax.MAP_BOUNDS) -> DataFrame:
    return places.filter(geo.in_box(F.col("lat"), F.col("lon"), *bounds))


RADII_M = (10_000.0, 12_000.0, 15_000.0)
ENOUGH = 8
SHOWN = 30


def nearby(points: DataFrame, catalog: Catalog, radii: tuple[float, ...] = RADII_M, enough: int = ENOUGH, shown: int = SHOWN) -> DataFrame:
    """Nearest places within the smallest radius that holds enough, or the largest.

    One join within a radius that holds the rows that can be shown, at most the largest; the counts per
    radius come from the same rows.  Points are (request_id, latitude, longitude).
    """
    spots = lookups.active_places(catalog.place).select(
        F.col("id").alias("place_id"), "location_id", F.col("updated_at").cast("timestamp").alias("updated_at")
    ).join(catalog.location.select(F.col("id").alias("location_id"), "lat", "lon"), "location_id")
    # Only the nearest rows can be shown, and `enough` never needs more than those.
    need = max(shown, enough)
    by_time = [F.desc("updated_at"), F.desc("place_id")]
    # Places at one spot are as far from everywhere, so no more of them than can be shown.
    spots = cut(top_rows(spots.filter("lat is not null and lon is not null"), ["lat", "lon"], by_time, need, "place_id").drop("rank"))
    circles = cut(holding_radius(points.select("request_id", "latitude", "longitude"), spots, "latitude", "longitude", need, max(radii)))
    near = top_rows(within_radius(circles, spots, "latitude", "longitude", "radius"), ["request_id"], [F.col("distance_m"), *by_time], need, "place_id")
    counts = near.groupBy("request_id").agg(*[F.count_if(F.col("distance_m") <= r).alias(f"n{i}") for i, r in enumerate(radii)])
    chosen = F.lit(float(radii[-1]))
    for i in range(len(radii) - 1, -1, -1):
        chosen = F.when(F.col(f"n{i}") >= enough, F.lit(float(radii[i]))).otherwise(chosen)
    return (
        near.join(counts.select("request_id", chosen.alias("radius_m")), "request_id")
        .filter((F.col("distance_m") <= F.col("radius_m")) & (F.col("rank") <= shown))
        .select("request_id", "radius_m", "rank", "place_id", "distance_m")
    )


def trending(catalog: Catalog, most: int = 30) -> DataFrame:
    """Best rated places of every district."""
    order = [F.desc_nulls_last("rating"), F.desc_nulls_last("review_count"), F.desc("place_id")]
    return top_rows(lookups.place_facts(catalog).filter("district is not null"), ["district"], order, most, "place_id")


def trending_without_location(requests: DataFrame, catalog: Catalog, most: int = 12) -> DataFrame:
    """The same requests without a point or radius, best rated first."""
    plain = requests.drop("latitude", "longitude", "radius_m", "sort", "limit")
    return search(plain.withColumn("sort", F.lit("rating")).withColumn("limit", F.lit(most)), catalog)


def load_more(page: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of a later page that were not shown before."""
    return page.join(seen.select("request_id", "place_id"), ["request_id", "place_id"], "left_anti")
