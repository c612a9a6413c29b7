"""Constraint audit and field coverage: counts, never exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.catalog import Catalog

# Row rules per table: name -> condition every row must meet (NULL passes).
ROW_RULES: dict[str, dict[str, str]] = {
    "location": {"country code": "country_code rlike '^[A-Z]{2}$'"},
    "place": {
        "price level": "price_level between 1 and 4",
        "rating": "rating between 0 and 5",
        "review count": "review_count >= 0",
        "status": "status in ('active', 'temporarily_closed', 'permanently_closed', 'unknown')",
    },
    "place_source": {"status": "status in ('active', 'missing', 'invalid', 'restricted')"},
    "place_category": {"confidence": "confidence between 0 and 1"},
    "dish": {"status": "status in ('available', 'unavailable', 'unknown')", "price": "price_amount >= 0"},
    "review": {"rating": "rating between 0 and 5"},
    "image": {"status": "status in ('active', 'unavailable', 'restricted')"},
    "hours": {
        "day": "day_of_week between 1 and 7",
        "times": "is_closed or (opens_min is not null and closes_min is not null)",
    },
    "crawl_run": {
        "counters": "records_found >= 0 and records_processed >= 0",
        "status": "status in ('queued', 'running', 'completed', 'failed', 'cancelled')",
    },
    "processing_record": {
        "attempts": "attempt_count >= 0",
        "stage": "stage in ('validation', 'normalization', 'matching', 'enrichment', 'embedding')",
        "status": "status in ('pending', 'processing', 'completed', 'failed', 'skipped')",
    },
}
UNIQUE_KEYS: dict[str, list[str]] = {
    "category": ["slug"],
    "data_source": ["code"],
    "place_source": ["data_source_id", "external_id"],
    "place_category": ["place_id", "category_id"],
    "dish": ["place_id", "normalized_name"],
    "review": ["place_source_id", "external_review_id"],
    "image": ["place_id", "place_source_id", "url"],
    "vector": ["place_id", "model", "content_hash"],
}
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("place", "location_id", "location"),
    ("place_source", "place_id", "place"),
    ("place_source", "data_source_id", "data_source"),
    ("place_category", "place_id", "place"),
    ("place_category", "category_id", "category"),
    ("dish", "place_id", "place"),
    ("review", "place_id", "place"),
    ("image", "place_id", "place"),
    ("hours", "place_id", "place"),
    ("vector", "place_id", "place"),
    ("processing_record", "crawl_run_id", "crawl_run"),
]


def _counted(table: str, rule: str, count: DataFrame) -> DataFrame:
    return count.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col("violations").cast("bigint").alias("violations"))


def row_rules(table: str, rows: DataFrame) -> DataFrame:
    """One pass over a table counts the violations of all its row rules."""
    rules = ROW_RULES[table]
    counts = rows.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint").alias("violations")
    )


def audit(catalog: Catalog) -> DataFrame:
    """(table_name, rule, violations) over ranges, allowed values, keys and references."""
    tables, parts = catalog.tables(), []
    for name in ROW_RULES:
        if name in tables:
            parts.append(row_rules(name, tables[name]))
    for name, key in UNIQUE_KEYS.items():
        if name in tables:
            repeated = tables[name].groupBy(*key).count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
            parts.append(_counted(name, "unique " + ", ".join(key), repeated))
    for name, column, parent in FOREIGN_KEYS:
        if name in tables and parent in tables:
            parents = tables[parent].select(F.col("id").alias(column))
            lost = tables[name].filter(F.col(column).isNotNull()).join(parents, column, "left_anti")
            parts.append(_counted(name, f"{column} in {parent}", lost.agg(F.count(F.lit(1)).alias("violations"))))
    if "review" in tables:
        # The same text may come back under a new id when the scan offers none.
        parts.append(_counted("review", "repeated content", repeated_reviews(tables["review"]).agg(F.count(F.lit(1)).alias("violations"))))
    return reduce(DataFrame.unionByName, parts)


def repeated_reviews(review: DataFrame) -> DataFrame:
    """(place_id, content key, n): visible texts that one place carries more than once."""
    return (
        review.filter("is_visible and content is not null")
        .groupBy("place_id", F.sha2("content", 256).alias("content_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def field_coverage(sources: DataFrame, keys: list[str], fields: list[str], column: str = "raw_data") -> DataFrame:
    """Share of sources whose scan saw each field, from the stored `extracted` flags."""
    def flag(field: str) -> Column:
        value = F.get_json_object(column, f"$.extracted.{field}")
        return F.when(value.isNull(), None).when(value.isin("true", "false"), (value == "true").cast("double")).otherwise(
            (value.try_cast("double") > 0).cast("double")
        )

    return sources.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"), *[F.avg(flag(f)).alias(f) for f in fields]
    )


def vector_sizes(vector: DataFrame) -> DataFrame:
    """(model, dimension, vectors, odd): largest dimension and rows of another size."""
    sizes = vector.groupBy("model", F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.groupBy("model").agg(F.max("n").alias("dimension"))
    return sizes.join(top, "model").groupBy("model", "dimension").agg(
        F.sum("rows").alias("vectors"), F.sum(F.when(F.col("n") != F.col("dimension"), F.col("rows")).otherwise(0)).alias("odd")
    )


