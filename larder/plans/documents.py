"""Search documents, content hashes, profiles and the vectors that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.functions import text as tx
from larder.operators import lookups, upsert
from larder.operators.topk import top_rows
from larder.plans.enrich import apply_categories

PROFILE_DISHES = 6
PROFILE_CATEGORY_SOURCE = "enrichment:category:ai:v1"


def _names(rows: DataFrame, column: str, alias: str, separator: str = ", ") -> DataFrame:
    """(place_id, alias): distinct names in order, joined.

    Names that begin beyond the length of a document cannot show in it and are left out
    before anything is collected, so what is gathered for one place is bounded.
    """
    distinct = rows.select("place_id", F.col(column).alias("n")).filter("n is not null").distinct()
    before = Window.partitionBy("place_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum(F.char_length("n") + len(separator)).over(before), F.lit(0))
    shown = distinct.withColumn("_begins", begins).filter(F.col("_begins") <= tax.DOCUMENT_MAX_CHARS)
    return shown.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_list("n")), separator).alias(alias))


def review_excerpts(review: DataFrame, most: int = tax.DOCUMENT_REVIEWS, chars: int = tax.DOCUMENT_REVIEW_CHARS) -> DataFrame:
    """(place_id, reviews): newest excerpts of every place, at most `most`."""
    usable = review.filter("content is not null and (is_visible is null or is_visible)")
    top = top_rows(usable, ["place_id"], [F.desc_nulls_last("reviewed_at"), F.desc("id")], most, "id")
    return top.groupBy("place_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", tx.truncate("content", chars).alias("text")))), lambda r: r["text"]
        ).alias("reviews")
    )


def document_inputs(catalog: Catalog) -> DataFrame:
    """One row per active or temporarily closed place with the parts of its document."""
    place = catalog.place.filter("status in ('active', 'temporarily_closed')").select(
        F.col("id").alias("place_id"), "name", "normalized_name", "price_level", F.col("semantic_profile").alias("profile"), "location_id"
    )
    location = catalog.location.select(F.col("id").alias("location_id"), "district", "city")
    category = catalog.place_category.select("place_id", "category_id").join(
        catalog.category.select(F.col("id").alias("category_id"), F.col("name").alias("n")), "category_id"
    )
    dish = lookups.available_dishes(catalog.dish)
    attribute = catalog.food_attribute.filter("is_active").select(F.col("id").alias("attribute_id"), F.col("name").alias("n"))
    tagged = (
        dish.select(F.col("id").alias("dish_id"), "place_id")
        .join(catalog.dish_attribute.select("dish_id", "attribute_id"), "dish_id")
        .join(attribute, "attribute_id")
    )
    return (
        place.join(location, "location_id")
        .join(_names(category, "n", "categories"), "place_id", "left")
        .join(_names(dish, "name", "dishes"), "place_id", "left")
        .join(_names(tagged, "n", "attributes"), "place_id", "left")
        .join(review_excerpts(catalog.review), "place_id", "left")
        .drop("location_id")
    )


def _document(c: dict[str, Column], limit: int) -> Column:
    def part(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), tx.valid_text(value)))

    parts = F.array_compact(
        F.array(
            tx.trim(tx.valid_text(c["name"])),
            part("profile", c["profile"]),
            part("categories", c["categories"]),
            part("dishes", c["dishes"]),
            part("attributes", c["attributes"]),
            F.when(F.size(c["reviews"]) > 0, F.concat(F.lit("reviews: "), F.array_join(c["reviews"], "; "))),
            part("location", F.concat_ws(", ", F.nullif(c["district"], F.lit("")), F.nullif(c["city"], F.lit("")))),
            F.when(c["price_level"].isNotNull(), F.concat(F.lit("price level: "), c["price_level"].cast("string"), F.lit("/4"))),
            F.concat(F.lit("normalized name: "), tx.trim(tx.valid_text(c["normalized_name"]))),
        )
    )
    folded = F.aggregate(
        parts,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda state, piece: _append(state, piece, limit),
    )
    return F.left(folded["text"], F.lit(limit))


def _append(state: Column, piece: Column, limit: int) -> Column:
    following = F.when(state["text"] == "", piece).otherwise(F.concat(state["text"], F.lit(" | "), piece))
    full = state["full"] | ((F.char_length(following) > limit) & (state["text"] != ""))
    return F.struct(F.when(full, state["text"]).otherwise(following).alias("text"), full.alias("full"))


def with_documents(inputs: DataFrame, limit: int = tax.DOCUMENT_MAX_CHARS) -> DataFrame:
    """Adds `document`: labelled parts in order, cut off before the first that overflows."""
    names = ["name", "profile", "categories", "dishes", "attributes", "reviews", "district", "city", "price_level", "normalized_name"]
    return inputs.withColumn("document", _document({n: F.col(n) for n in names}, limit))


def content_hash(document: Column, template: str = tax.DOCUMENT_TEMPLATE) -> Column:
    return F.sha2(
        F.to_json(F.struct(F.lit(f"search-document:{template}").alias("template"), document.alias("document"))), 256
    )


def model_id(provider_model: str, template: str = tax.DOCUMENT_TEMPLATE) -> str:
    return f"{provider_model}@doc:{template}"


def documents(catalog: Catalog) -> DataFrame:
    """(place_id, document, content_hash)."""
    return with_documents(document_inputs(catalog)).select(
        "place_id", "document", content_hash(F.col("document")).alias("content_hash")
    )


def vector_targets(docs: DataFrame, vector: DataFrame, model: str, refresh: bool = False) -> DataFrame:
    """Documents that need a vector: none yet or, on refresh, another hash."""
    stored = lookups.latest_vectors(vector.filter(F.col("model") == model)).select(
        "place_id", F.col("content_hash").alias("stored_hash")
    )
    joined = docs.join(stored, "place_id", "left")
    due = F.col("stored_hash").isNull()
    if refresh:
        due = due | (F.col("stored_hash") != F.col("content_hash"))
    return joined.filter(due).select("place_id", "document", "content_hash", F.col("stored_hash").isNotNull().alias("has_existing"))


def vector_run_summary(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(scanned, embedded, refreshed, skipped) of a run, without writing anything."""
    scanned = docs.agg(F.count(F.lit(1)).alias("scanned"))
    due = targets.agg(
        F.count_if(~F.col("has_existing")).alias("embedded"), F.count_if("has_existing").alias("refreshed")
    )
    return scanned.join(due).withColumn("skipped", F.col("scanned") - F.col("embedded") - F.col("refreshed"))


def check_vectors(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) supplied vectors: every model has one dimension, its largest."""
    sizes = incoming.groupBy("model").agg(F.max(F.size("embedding")).alias("dimension"))
    rows = incoming.join(sizes, "model")
    fits = F.coalesce(F.size("embedding") == F.col("dimension"), F.lit(False))
    return rows.filter(fits).drop("dimension"), rows.filter(~fits)


def write_vectors(vector: DataFrame, incoming: DataFrame) -> DataFrame:
    """`vector` with all rows of a delivered (place, model) replaced by the delivered one."""
    accepted, _ = check_vectors(incoming)
    newest = upsert.latest(accepted.select(*vector.columns), ["place_id", "model"], ["created_at", "id"])
    kept = vector.join(newest.select("place_id", "model"), ["place_id", "model"], "left_anti")
    return kept.select(*vector.columns).unionByName(newest.select(*vector.columns))


def active_model(vector: DataFrame) -> DataFrame:
    """The one model to query: newest vector, then the larger smallest id."""
    return (
        vector.groupBy("model")
        .agg(F.max("created_at").alias("newest"), F.min(F.col("id").cast("string")).alias("first_id"))
        .orderBy(F.desc("newest"), F.desc("first_id"))
        .limit(1)
    )


# --- profiles ------------------------------------------------------------------


def price_phrase(price: Column) -> Column:
    pairs = [F.lit(v) for kv in tax.PRICE_PHRASES.items() for v in kv]
    return F.element_at(F.create_map(*pairs), price)


def _gap(place: DataFrame, refresh: bool) -> DataFrame:
    active = lookups.active_places(place)
    return active if refresh else active.filter("semantic_profile is null or trim(semantic_profile) = ''")


def first_dishes(dish: DataFrame, most: int = PROFILE_DISHES) -> DataFrame:
    named = lookups.available_dishes(dish).filter("name is not null and length(trim(name)) > 0")
    return top_rows(named, ["place_id"], [F.col("id")], most, "id")


def profile_inputs(catalog: Catalog, refresh: bool = False) -> DataFrame:
    """One row per place to describe: names, categories, six dishes, four excerpts."""
    place = _gap(catalog.place, refresh).select(F.col("id").alias("place_id"), "name", "price_level", "location_id")
    location = catalog.location.select(F.col("id").alias("location_id"), "district")
    dishes = first_dishes(catalog.dish).groupBy("place_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda d: d["name"]).alias("dishes")
    )
    categories = lookups.category_sets(catalog).select(
        "place_id", F.array_distinct(F.transform("categories", lambda c: c["name"])).alias("categories")
    )
    return (
        place.join(location, "location_id")
        .join(categories, "place_id", "left")
        .join(dishes, "place_id", "left")
        .join(review_excerpts(catalog.review), "place_id", "left")
        .withColumn("price_phrase", price_phrase(F.col("price_level")))
        .drop("location_id")
    )


def check_profiles(results: DataFrame, catalog: Catalog) -> DataFrame:
    """Supplied (place_id, position, profile, category) checked item by item: the first
    item of a place counts, profiles are trimmed and cut, unknown slugs become NULL."""
    first = results.groupBy("place_id").agg(F.min(F.struct("position", "profile", "category")).alias("r")).select("place_id", "r.*")
    slugs = catalog.category.filter("is_active").select("slug", F.lit(True).alias("known")).distinct()
    return (
        first.join(slugs, F.col("category") == F.col("slug"), "left")
        .select(
            "place_id",
            tx.truncate(F.nullif(tx.trim("profile"), F.lit("")), tax.PROFILE_MAX_CHARS).alias("profile"),
            F.when(F.col("known"), F.col("category")).alias("category"),
        )
    )


def apply_profiles(results: DataFrame, catalog: Catalog, now: Column, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(`place`, `place_category`) after a profile run; only gaps unless `refresh`."""
    checked = check_profiles(results, catalog)
    given = checked.filter("profile is not null").select(F.col("place_id").alias("id"), "profile")
    blank = F.col("semantic_profile").isNull() | (tx.trim("semantic_profile") == "")
    write = F.col("profile").isNotNull() & (F.lit(refresh) | blank)
    columns = {
        "semantic_profile": F.when(write, F.col("profile")).otherwise(F.col("semantic_profile")),
        "updated_at": F.when(write, now).otherwise(F.col("updated_at")),
    }
    place = catalog.place.join(given, "id", "left").select(*[columns.get(c, F.col(c)).alias(c) for c in catalog.place.columns])
    suggestions = checked.filter("category is not null").select(
        "place_id", F.col("category").alias("slug"), F.lit(tax.PROFILE_CATEGORY_CONFIDENCE).alias("confidence")
    )
    return place, apply_categories(suggestions, catalog, PROFILE_CATEGORY_SOURCE, now)
