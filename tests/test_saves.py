"""A change log against the saved table."""

from larder.catalog import empty_catalog
from larder import schemas
from larder.plans.ingest import with_error
from larder.plans.listings import apply_saves


def test_created_at_follows_the_last_removal(spark):
    place = spark.createDataFrame([("p", "active"), ("q", "closed")], "id string, status string")
    saved = spark.sql("select * from values ('u', 'p', timestamp'2024-01-01'), ('v', 'p', timestamp'2024-01-05') as t(user_id, place_id, created_at)")
    log = spark.sql(
        """select * from values
        ('u', 'p', 'remove', timestamp'2024-02-01'), ('u', 'p', 'save', timestamp'2024-03-01'), ('u', 'p', 'save', timestamp'2024-04-01'),
        ('v', 'p', 'save', timestamp'2024-02-01'), ('w', 'p', 'save', timestamp'2024-02-01'), ('w', 'p', 'save', timestamp'2024-03-01'),
        ('x', 'p', 'save', timestamp'2024-02-01'), ('x', 'p', 'remove', timestamp'2024-03-01'), ('y', 'q', 'save', timestamp'2024-02-01')
        as t(user_id, place_id, op, at)"""
    )
    rows = apply_saves(saved, log, empty_catalog(spark).with_tables(place=place)).collect()
    assert {(r.user_id, r.place_id, str(r.created_at.date())) for r in rows} == {("u", "p", "2024-03-01"), ("v", "p", "2024-01-05"), ("w", "p", "2024-02-01")}


def test_names_of_white_space_are_rejected(spark):
    frame = spark.createDataFrame([], schemas.SOURCE_RECORD)
    blanks = spark.createDataFrame([("feed", f"id{k}", name, "2024-01-01T00:00:00Z") for k, name in enumerate(["\t", " ", " \n", "x"])], "provider_code string, external_id string, name string, collected_at string")
    errors = [r.error for r in with_error(frame.unionByName(blanks, allowMissingColumns=True)).orderBy("external_id").collect()]
    assert errors == ["name is required."] * 3 + [None]
