"""The refresh chain: reviews, then profile, then the vector of the changed document."""

import json

from pyspark.sql import functions as F

from larder import schemas, taxonomy
from larder.catalog import empty_catalog
from larder.operators.lineage import cut
from larder.plans import documents, ingest, refresh


def test_full_refresh(spark):
    def frame(rows):
        return spark.read.schema(schemas.SOURCE_RECORD).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))

    def commit(catalog):
        return catalog.with_tables(**{n: cut(t) for n, t in catalog.tables().items()})

    now = F.lit("2024-06-05 10:00:00").cast("timestamp")
    sources = spark.createDataFrame([("s", taxonomy.SCAN_PROVIDER, "Scan", None, True)], schemas.TABLES["data_source"])
    base = dict(provider_code=taxonomy.SCAN_PROVIDER, external_id="a", source_url="https://m/a", collected_at="2024-06-01T00:00:00Z", name="Phở", source_metadata="{}")
    catalog = commit(ingest.ingest(frame([base]), empty_catalog(spark).with_tables(data_source=sources), "r0", now).catalog)
    place, source = catalog.place.first().id, catalog.place_source.first().id
    scanned = frame([dict(base, external_id="other", name="", reviews=[{"external_review_id": "r", "content": "ngon"}])]).withColumn("target_id", F.lit(source))
    profiles = spark.createDataFrame([(place, 0, " món nóng ", None)], "place_id string, position int, profile string, category string")
    text = "Phở | profile: món nóng | reviews: ngon | normalized name: pho"
    hashed = spark.range(1).select(documents.content_hash(F.lit(text))).first()[0]
    vectors = spark.createDataFrame([("v", place, [1.0, 0.0], "m@doc:v3", hashed), ("w", place, [0.0, 1.0], "m@doc:v3", "stale")], "id string, place_id string, embedding array<float>, model string, content_hash string").withColumn("created_at", now)
    done = refresh.full_refresh(catalog, scanned, profiles, vectors, "m@doc:v3", "r1", now, commit)
    assert [r.content for r in done.review.collect()] == ["ngon"]
    assert done.place_source.count() == 1 and done.place.first().semantic_profile == "món nóng"
    assert [(r.id, r.content_hash) for r in done.vector.collect()] == [("v", hashed)]
