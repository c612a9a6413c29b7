"""Review refresh targets and the whole refresh chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.plans import documents, ingest


def visible_review_counts(review: DataFrame) -> DataFrame:
    return review.groupBy("place_source_id").agg(F.count_if(F.col("is_visible").isNull() | F.col("is_visible")).alias("visible_reviews"))


def refresh_targets(catalog: Catalog, threshold: int = 20, limit: int = 0, provider: str = tax.SCAN_PROVIDER) -> DataFrame:
    """Active sources with a URL whose place shows too few reviews, fewest first."""
    scanned = catalog.data_source.filter(F.col("code") == provider).select(F.col("id").alias("data_source_id"))
    sources = (
        catalog.place_source.filter("status = 'active' and source_url is not null")
        .join(scanned, "data_source_id", "left_semi")
        .select(F.col("id").alias("place_source_id"), "place_id", "external_id", "source_url")
    )
    place = catalog.place.filter("status = 'active'").select(F.col("id").alias("place_id"), "name")
    rows = (
        sources.join(place, "place_id")
        .join(visible_review_counts(catalog.review), "place_source_id", "left")
        .withColumn("visible_reviews", F.coalesce("visible_reviews", F.lit(0)))
        .filter(F.col("visible_reviews") < threshold)
        .orderBy("visible_reviews", "name", "place_source_id")
    )
    return rows.limit(limit) if limit > 0 else rows


def pin(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Scanned records put on the identity of the source they refresh.

    Records carry `target_id`, the `place_source_id` they were scanned for.
    """
    known = targets.select(
        F.col("place_source_id").alias("target_id"), F.col("external_id").alias("t_id"), F.col("source_url").alias("t_url"), F.col("name").alias("t_name")
    )
    joined = records.join(known, "target_id")
    columns = {
        "external_id": F.col("t_id"),
        "source_url": F.col("t_url"),
        "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), "t_name"),
    }
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in records.columns if c != "target_id"])


def full_refresh(
    catalog: Catalog,
    scanned: DataFrame,
    profiles: DataFrame,
    vectors: DataFrame,
    model: str,
    run_id: str,
    now: Column,
    commit,
) -> Catalog:
    """Reviews, then profiles, then the vectors of documents that changed.

    `commit(catalog)` writes a version and returns it as read back, which also cuts the
    lineage between the steps.
    """
    catalog = commit(ingest.ingest(pin(scanned, refresh_targets(catalog)), catalog, run_id, now).catalog)
    place, links = documents.apply_profiles(profiles, catalog, now)
    catalog = commit(catalog.with_tables(place=place, place_category=links))
    due = documents.vector_targets(documents.documents(catalog), catalog.vector, model, refresh=True)
    fresh = vectors.join(due.select("place_id", "content_hash"), ["place_id", "content_hash"], "left_semi")
    return commit(catalog.with_tables(vector=documents.write_vectors(catalog.vector, fresh)))
