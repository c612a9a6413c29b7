"""Repairs of known data faults, each a job that may be run again and again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.functions import scan
from larder.functions import text as tx
from larder.operators.topk import first_by

REPLACEMENT = "�"


def fill_coordinates(catalog: Catalog, now: Column, provider: str = tax.SCAN_PROVIDER) -> DataFrame:
    """`location` with missing coordinates read from a source URL of its place."""
    scanned = catalog.data_source.filter(F.col("code") == provider).select(F.col("id").alias("data_source_id"))
    found = catalog.place_source.join(scanned, "data_source_id", "left_semi").select(
        "place_id", "id", scan.pin_coordinates(F.col("source_url")).alias("point")
    ).filter("point is not null")
    owned = catalog.place.select(F.col("id").alias("place_id"), "location_id").join(found, "place_id")
    # Several sources may offer a point; the smallest source id decides.
    point = first_by(owned, ["location_id"], [F.col("id")], ["point"])
    missing = F.col("lat").isNull() & F.col("point").isNotNull()
    joined = catalog.location.join(point, F.col("id") == F.col("location_id"), "left")
    columns = {
        "lat": F.coalesce("lat", "point.latitude"),
        "lon": F.when(missing, F.col("point.longitude")).otherwise(F.col("lon")),
        "updated_at": F.when(missing, now).otherwise(F.col("updated_at")) if "updated_at" in catalog.location.columns else None,
    }
    return joined.select(*[columns[c].alias(c) if columns.get(c) is not None else F.col(c) for c in catalog.location.columns])


def is_corrupted(name: Column) -> Column:
    return name.contains(REPLACEMENT)


def drop_corrupted_dishes(dish: DataFrame) -> DataFrame:
    """Rows with replacement characters go when the place has a clean twin or clean dish.

    A clean dish of the same place covers both cases, so one semi join decides: the
    twin rule is the special case in which letters and digits agree as well.
    """
    twins = twin_corrupted(dish)
    clean = dish.filter(~is_corrupted(F.col("name"))).select("place_id").distinct()
    rest = dish.join(twins.select("id"), "id", "left_anti")
    broken = rest.filter(is_corrupted(F.col("name"))).join(clean, "place_id", "left_semi").select("id")
    return rest.join(broken, "id", "left_anti")


def twin_corrupted(dish: DataFrame) -> DataFrame:
    """Corrupted dishes whose place has a clean dish with the same letters and digits."""
    keyed = dish.withColumn("letters", tx.letters_key("name"))
    clean = keyed.filter(~is_corrupted(F.col("name"))).select("place_id", "letters").distinct()
    return keyed.filter(is_corrupted(F.col("name"))).join(clean, ["place_id", "letters"], "left_semi").drop("letters")


def is_area_card(name: Column) -> Column:
    return F.lower(name).isin(tax.AREA_CARD_NAMES)


def is_junk(name: Column) -> Column:
    """Names the catalog rejects: non-food businesses, markers, bare addresses."""

    def junk(key: Column) -> Column:
        prefix = key.rlike("^(?:" + "|".join(re.escape(p) for p in tax.JUNK_NAME_PREFIXES) + ")")
        word = key.rlike(tx.LETTER_START + "(?:" + "|".join(tax.JUNK_NAME_WORDS) + ")" + tx.LETTER_END)
        address = key.rlike("^[0-9]")
        for part in tax.JUNK_ADDRESS_PARTS:
            address = address & key.contains(part)
        return prefix | word | key.isin(tax.JUNK_NAMES) | address

    return F.coalesce(tx.once(tx.match_key(name), junk), F.lit(False))


def reject_places(catalog: Catalog, flagged: Column, now: Column, provider: str = tax.SCAN_PROVIDER) -> tuple[DataFrame, DataFrame]:
    """(`place_source`, `place`): flagged places lose their scanned sources, and their
    status unless another active source remains."""
    scanned = catalog.data_source.filter(F.col("code") == provider).select(
        F.col("id").alias("data_source_id"), F.lit(True).alias("is_scanned")
    )
    bad = catalog.place.filter(flagged).select(F.col("id").alias("place_id"), F.lit(True).alias("is_bad"))
    hit = F.coalesce(F.col("is_bad") & F.col("is_scanned"), F.lit(False)) & (F.col("status") == "active")
    sources = (
        catalog.place_source.join(scanned, "data_source_id", "left")
        .join(bad, "place_id", "left")
        .withColumn("last_seen_at", F.when(hit, now).otherwise(F.col("last_seen_at")))
        .withColumn("status", F.when(hit, F.lit("invalid")).otherwise(F.col("status")))
        .select(*catalog.place_source.columns)
    )
    alive = sources.filter("status = 'active'").select(F.col("place_id").alias("id")).distinct().withColumn("is_alive", F.lit(True))
    drop = flagged & F.col("is_alive").isNull()
    place = catalog.place.join(alive, "id", "left")
    columns = {
        "status": F.when(drop, F.lit("unknown")).otherwise(F.col("status")),
        "updated_at": F.when(drop, now).otherwise(F.col("updated_at")),
    }
    return sources, place.select(*[columns.get(c, F.col(c)).alias(c) for c in catalog.place.columns])


def collapse_images(image: DataFrame) -> DataFrame:
    """One image per (place, source, base URL): cover first, then order, then id."""
    based = image.withColumn("url", scan.stored_photo_url(F.col("url")))
    best = first_by(
        based, ["place_id", "place_source_id", "url"],
        [F.when(F.col("is_cover"), 0).otherwise(1), F.col("sort_order"), F.col("id")],
    )
    return best.select(*image.columns)


def clear_invented_counts(catalog: Catalog, now: Column) -> DataFrame:
    """`place` where a zero review count no active source reported becomes NULL."""
    reported = catalog.place_source.filter("status = 'active' and source_review_count is not null").select(
        F.col("place_id").alias("id")
    ).distinct().withColumn("reported", F.lit(True))
    invented = (F.col("review_count") == 0) & F.col("reported").isNull()
    invented = F.coalesce(invented, F.lit(False))
    columns = {
        "review_count": F.when(~invented, F.col("review_count")),
        "updated_at": F.when(invented, now).otherwise(F.col("updated_at")),
    }
    return catalog.place.join(reported, "id", "left").select(
        *[columns.get(c, F.col(c)).alias(c) for c in catalog.place.columns]
    )


def remove_retired_sources(catalog: Catalog, codes: tuple[str, ...] = tax.RETIRED_PROVIDERS) -> Catalog:
    """Catalog without inactive providers and what hangs on them; places stay."""
    gone = catalog.data_source.filter(F.col("code").isin(*codes) & ~F.col("is_active")).select(F.col("id").alias("data_source_id"))
    gone_sources = catalog.place_source.join(gone, "data_source_id", "left_semi").select(F.col("id").alias("place_source_id"))
    gone_runs = catalog.crawl_run.join(gone, "data_source_id", "left_semi").select(F.col("id").alias("crawl_run_id"))
    log = catalog.processing_record.join(gone_runs, "crawl_run_id", "left_anti")
    if "place_source_id" in log.columns:
        log = log.join(gone_sources, "place_source_id", "left_anti")
    return catalog.with_tables(
        processing_record=log.select(*catalog.processing_record.columns),
        review=catalog.review.join(gone_sources, "place_source_id", "left_anti").select(*catalog.review.columns),
        image=catalog.image.join(gone_sources, "place_source_id", "left_anti").select(*catalog.image.columns),
        place_source=catalog.place_source.join(gone, "data_source_id", "left_anti").select(*catalog.place_source.columns),
        crawl_run=catalog.crawl_run.join(gone, "data_source_id", "left_anti").select(*catalog.crawl_run.columns),
        data_source=catalog.data_source.join(gone, F.col("id") == F.col("data_source_id"), "left_anti"),
    )


def deactivate_sources(data_source: DataFrame, codes: tuple[str, ...] = tax.RETIRED_PROVIDERS) -> DataFrame:
    return data_source.withColumn("is_active", F.when(F.col("code").isin(*codes), F.lit(False)).otherwise(F.col("is_active")))
