"""Categories, dishes and attributes derived from names and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.functions import text as tx
from larder.operators import lookups, upsert

CATEGORY_SOURCE = "enrichment:category:rules:v1"
DISH_SOURCE = "enrichment:dish:lexicon:v1"
ATTRIBUTE_SOURCE = "enrichment:attribute:rules:v1"


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(phrase, display) for phrase, display, _ in tax.DISH_LEXICON]
    return spark.createDataFrame(rows, "phrase string, display string")


def attribute_map(spark: SparkSession) -> DataFrame:
    rows = [(phrase, code) for phrase, _, codes in tax.DISH_LEXICON for code in codes]
    return spark.createDataFrame(rows, "normalized_name string, code string")


def category_suggestion(text: Column) -> Column:
    """Struct (confidence, slug) of the best rule; NULL when no rule or a tie is best."""
    key = F.regexp_replace(tx.fold(text), tx.SPACES, " ")
    hits = F.array_compact(
        F.array(
            *[
                F.when(key.rlike(tx.ascii_phrase(words)), F.struct(F.lit(confidence).alias("confidence"), F.lit(slug).alias("slug")))
                for slug, confidence, words in tax.NAME_RULES
            ]
        )
    )
    best = F.array_max(F.transform(hits, lambda h: h["confidence"]))
    top = F.filter(hits, lambda h: h["confidence"] == best)
    return F.when(F.size(top) == 1, F.get(top, F.lit(0)))


def category_suggestions(catalog: Catalog) -> DataFrame:
    """(place_id, slug, confidence) for active places without any category."""
    bare = lookups.active_places(catalog.place).join(
        catalog.place_category.select(F.col("place_id").alias("id")), "id", "left_anti"
    )
    text = F.coalesce(F.nullif("normalized_name", F.lit("")), "name")
    return (
        bare.select(F.col("id").alias("place_id"), category_suggestion(text).alias("s"))
        .filter(F.col("s.confidence") >= tax.CATEGORY_CONFIDENCE_FLOOR)
        .select("place_id", "s.slug", "s.confidence")
    )


def apply_categories(suggestions: DataFrame, catalog: Catalog, source: str = CATEGORY_SOURCE, now: Column | None = None) -> DataFrame:
    """`place_category` with suggestions of active slugs added; existing links stay."""
    active = catalog.category.filter("is_active").select(F.col("id").alias("category_id"), "slug")
    links = catalog.place_category
    values = {
        "source": F.lit(source),
        "confidence": F.col("confidence").cast(links.schema["confidence"].dataType),
        "updated_at": now if now is not None else F.current_timestamp(),
    }
    incoming = suggestions.join(active, "slug").dropDuplicates(["place_id", "category_id"])
    return upsert.insert_new(
        links, incoming.select(*[values.get(c, F.col(c)).alias(c) for c in links.columns]), ["place_id", "category_id"]
    )




def phrases(text: Column, max_words: int = tax.LEXICON_MAX_WORDS) -> Column:
    """Distinct runs of up to `max_words` words separated by single spaces."""
    key = tx.collapse(tx.fold(text))
    runs = F.filter(F.split(key, r"(?:[^a-z0-9 ]| (?![a-z0-9])|(?<![a-z0-9]) )+"), lambda r: r != "")

    def grams(words: Column) -> Column:
        return F.flatten(
            F.transform(
                words,
                lambda _, i: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(max_words), F.size(words) - i)),
                    lambda n: F.array_join(F.slice(words, i + 1, n), " "),
                ),
            )
        )

    # A run is split once: splitting it for every phrase would cost the square of its words.
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: tx.once(F.split(run, " "), grams))))


def phrase_hits(texts: DataFrame, words: DataFrame, keys: list[str], max_words: int = tax.LEXICON_MAX_WORDS) -> DataFrame:
    """(keys, phrase, display): lexicon phrases that occur whole in `text`.

    Linear in the text: word runs are exploded and joined to the lexicon.  Runs longer than its longest
    phrase cannot meet one and are not made.
    """
    longest = words.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    max_words = min(max_words, max(longest, 1))
    return (
        texts.select(*keys, F.explode(phrases(F.col("text"), max_words)).alias("phrase"))
        .join(F.broadcast(words), "phrase")
    )


def dish_mentions(places: DataFrame, reviews: DataFrame, words: DataFrame) -> DataFrame:
    """(place_id, phrase, display, in_name, reviews) for every phrase found."""
    named = phrase_hits(places.select("place_id", F.col("name").alias("text")), words, ["place_id"]).select(
        "place_id", "phrase", "display", F.lit(1).alias("in_name"), F.lit(0).alias("in_review")
    )
    mentioned = phrase_hits(
        reviews.select("place_id", F.col("content").alias("text")), words, ["place_id"]
    ).select("place_id", "phrase", "display", F.lit(0).alias("in_name"), F.lit(1).alias("in_review"))
    return named.unionByName(mentioned).groupBy("place_id", "phrase", "display").agg(
        (F.max("in_name") > 0).alias("in_name"), F.sum("in_review").alias("reviews")
    )


def dish_suggestions(catalog: Catalog, words: DataFrame | None = None) -> DataFrame:
    """Dishes of active places that have none: name beats two reviews beats one."""
    words = words if words is not None else lexicon(catalog.place.sparkSession)
    bare = (
        lookups.active_places(catalog.place)
        .join(catalog.dish.select(F.col("place_id").alias("id")), "id", "left_anti")
        .select(F.col("id").alias("place_id"), "name")
    )
    reviews = catalog.review.filter("content is not null and (is_visible is null or is_visible)").join(
        bare.select("place_id"), "place_id", "left_semi"
    )
    confidence = (
        F.when(F.col("in_name"), F.lit(tax.DISH_CONFIDENCE_NAME))
        .when(F.col("reviews") >= 2, F.lit(tax.DISH_CONFIDENCE_MANY_REVIEWS))
        .otherwise(F.lit(tax.DISH_CONFIDENCE_ONE_REVIEW))
    )
    return dish_mentions(bare, reviews, words).select(
        "place_id", F.col("phrase").alias("normalized_name"), F.col("display").alias("name"),
        confidence.alias("confidence"), "in_name", "reviews",
    )


def apply_dishes(suggestions: DataFrame, catalog: Catalog) -> DataFrame:
    values = {
        "id": F.sha2(F.concat_ws("\u0001", F.lit("dish"), F.col("place_id").cast("string"), "normalized_name"), 256),
        "is_popular": F.lit(False), "status": F.lit("available"), "source": F.lit(DISH_SOURCE),
    }
    dish = catalog.dish
    incoming = suggestions.select(
        *[
            (values[c] if c in values else F.col(c) if c in suggestions.columns else F.lit(None)).cast(dish.schema[c].dataType).alias(c)
            for c in dish.columns
        ]
    )
    return upsert.insert_new(dish, incoming, ["place_id", "normalized_name"])


def attribute_links(catalog: Catalog, mapping: DataFrame | None = None) -> DataFrame:
    """(dish_id, attribute_id, code) of every available dish with a known phrase."""
    mapping = mapping if mapping is not None else attribute_map(catalog.dish.sparkSession)
    active = catalog.food_attribute.filter("is_active").select(F.col("id").alias("attribute_id"), "code")
    known = F.broadcast(mapping.join(active, "code"))
    named = lookups.available_dishes(catalog.dish).filter(F.length(F.trim("normalized_name")) > 0)
    return named.select(F.col("id").alias("dish_id"), "normalized_name").join(known, "normalized_name").select(
        "dish_id", "attribute_id", "code"
    )


def apply_attributes(links: DataFrame, catalog: Catalog) -> DataFrame:
    table = catalog.dish_attribute
    values = {"source": F.lit(ATTRIBUTE_SOURCE), "confidence": F.lit(tax.ATTRIBUTE_CONFIDENCE)}
    incoming = links.select(
        *[(values[c] if c in values else F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    ).distinct()
    return upsert.insert_new(table, incoming, ["dish_id", "attribute_id"])


def enrich(catalog: Catalog, limit: int = 0, now: Column | None = None) -> tuple[Catalog, DataFrame]:
    """All three steps and a one-row summary; counting it writes nothing (a dry run).

    `limit` bounds how many gap places the first two steps look at, lowest id first.
    """
    scope = catalog
    if limit > 0:
        scope = catalog.with_tables(place=lookups.active_places(catalog.place).orderBy("id").limit(limit))
    categories = category_suggestions(scope)
    dishes = dish_suggestions(scope)
    step = catalog.with_tables(
        place_category=apply_categories(categories, catalog, now=now), dish=apply_dishes(dishes, catalog)
    )
    links = attribute_links(step)
    done = step.with_tables(dish_attribute=apply_attributes(links, step))

    def gaps(child: DataFrame) -> DataFrame:
        return lookups.active_places(scope.place).join(child.select(F.col("place_id").alias("id")), "id", "left_anti")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")

    measures = (
        counted(gaps(catalog.place_category), "scanned_categories")
        .unionByName(counted(gaps(catalog.dish), "scanned_dishes"))
        .unionByName(counted(categories, "categories_applied"))
        .unionByName(counted(dishes, "dishes_applied"))
        .unionByName(counted(links, "attributes_applied"))
    )

    def measure(name: str) -> Column:
        return F.sum(F.when(F.col("measure") == name, F.col("n")).otherwise(0))

    summary = measures.agg(
        (measure("scanned_categories") + measure("scanned_dishes")).alias("scanned"),
        measure("categories_applied").alias("categories_applied"),
        measure("dishes_applied").alias("dishes_applied"),
        measure("attributes_applied").alias("attributes_applied"),
    )
    return done, summary
