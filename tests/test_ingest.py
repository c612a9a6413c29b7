"""Ingest on small nested fixtures: resolution order, NULL rule, idempotence, outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.catalog import empty_catalog
from larder.operators.lineage import cut
from larder.plans import ingest as plan

NOW = "2024-06-05 10:00:00"


def record(**values):
    base = dict(provider_code="feed", external_id="x1", collected_at="2024-06-01T00:00:00Z", name="  Phở   Bò ", source_metadata="{}")
    base.update(values)
    return base


def frame(spark, rows):
    return spark.read.schema(schemas.SOURCE_RECORD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


@pytest.fixture()
def start(spark):
    catalog = empty_catalog(spark)
    sources = spark.createDataFrame([("s1", "feed", "Feed", None, True), ("s2", "other", "Other", None, True)], schemas.TABLES["data_source"])
    categories = spark.createDataFrame(
        [("c1", "Noodle", "noodle", None, None, True), ("c2", "Old", "old", None, None, False)], schemas.TABLES["category"]
    )
    return catalog.with_tables(data_source=sources, category=categories)


def run(spark, rows, catalog):
    result = plan.ingest(frame(spark, rows), catalog, "run", F.lit(NOW).cast("timestamp"))
    written = catalog.with_tables(**{n: cut(t) for n, t in result.catalog.tables().items()})
    return written, result


def at(lat, lon):
    return {"latitude": lat, "longitude": lon}


def test_rejects_keep_the_first_message_and_the_run_goes_on(spark, start):
    rows = [
        record(),
        record(external_id="bad", name="  ", coordinates=at(100, 0)),
        record(external_id="far", coordinates=at(100, 0)),
        record(external_id="stars", rating=6),
        record(external_id="half", review_count=1.5),
        record(external_id="img", images=[{"url": "ftp://x"}]),
        record(external_id="date", collected_at="soon"),
        record(external_id="who", provider_code="nobody"),
    ]
    written, result = run(spark, rows, start)
    errors = {r.external_id: r.error for r in result.rejected.collect()}
    assert errors == {
        "bad": "name is required.",
        "far": "coordinates are outside valid geographic ranges.",
        "stars": "rating must be between 0 and 5.",
        "half": "reviewCount must be a non-negative integer.",
        "img": "image URLs must use http or https.",
        "date": "collectedAt must be a valid ISO timestamp.",
    }
    counters = result.counters.first()
    assert (counters.records_found, counters.records_processed, counters.records_failed) == (8, 1, 7)
    log = {r.external_id: r for r in written.processing_record.collect()}
    assert log["x1"].status == "completed" and log["x1"].error_details is None
    assert json.loads(log["bad"].error_details) == {"message": "name is required."}
    place = written.place.first()
    assert (place.name, place.normalized_name, place.status) == ("Phở Bò", "pho bo", "active")


def test_resolution_order_and_leaders(spark, start):
    rows = [
        record(external_id="a", collected_at="2024-06-01T00:00:00Z", coordinates=at(10.0, 106.0)),
        # 111 m north: joins a; 222 m north: out of reach of a, so a place of its own
        record(external_id="b", collected_at="2024-06-01T01:00:00Z", coordinates=at(10.001, 106.0)),
        record(external_id="c", collected_at="2024-06-01T02:00:00Z", coordinates=at(10.002, 106.0)),
        record(external_id="d", collected_at="2024-06-01T03:00:00Z", coordinates=at(10.0, 106.0), name="Bún"),
        record(external_id="e", address="1 Lê Lợi", city="HCM"),
        record(external_id="f", address="1 LÊ LỢI", city="hcm", provider_code="other", collected_at="2024-06-02T00:00:00Z"),
    ]
    written, result = run(spark, rows, start)
    owner = {r.external_id: r.place_id for r in result.resolved.collect()}
    assert owner["a"] == owner["b"] != owner["c"]
    assert owner["e"] == owner["f"] and len(set(owner.values())) == 4
    # Next batch: known source id wins over everything, nearest existing place otherwise.
    again, second = run(
        spark,
        [
            record(external_id="a", name="Renamed", collected_at="2024-06-03T00:00:00Z"),
            record(external_id="g", provider_code="other", coordinates=at(10.0021, 106.0), collected_at="2024-06-03T00:00:00Z"),
        ],
        written,
    )
    later = {r.external_id: (r.place_id, r.is_new) for r in second.resolved.collect()}
    assert later["a"] == (owner["a"], False) and later["g"] == (owner["c"], False)
    assert again.place.count() == 4


def test_null_never_erases_and_rerun_changes_nothing(spark, start):
    full = record(
        rating=4.65, review_count=12, price_level=2, phone="1", categories=["Noodle", "old", "nope"],
        images=[{"url": "https://i/1", "is_cover": True}], dishes=[{"name": " Phở "}],
        opening_hours=[{"day_of_week": 1, "opens_at": None, "closes_at": None, "is_closed": True}],
        reviews=[{"external_review_id": "r1", "rating": 5, "content": "ngon"}],
    )
    written, _ = run(spark, [full], start)
    place = written.place.first()
    assert str(place.rating) == "4.7" and place.review_count == 12
    assert [r.category_id for r in written.place_category.collect()] == ["c1"]
    bare = record(collected_at="2024-06-02T00:00:00Z", reviews=[{"external_review_id": "r1", "content": "ok"}])
    second, _ = run(spark, [bare], written)
    place = second.place.first()
    assert str(place.rating) == "4.7" and place.phone == "1" and place.price_level == 2
    source = second.place_source.first()
    assert source.source_rating is None
    review = second.review.first()
    assert review.content == "ok" and review.rating is None and review.is_visible
    third, _ = run(spark, [bare, bare], second)
    for name in ("place", "location", "place_source", "image", "dish", "hours", "review", "place_category"):
        assert sorted(map(str, getattr(third, name).collect())) == sorted(map(str, getattr(second, name).collect())), name
    assert third.processing_record.first().attempt_count == 4
