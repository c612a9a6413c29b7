"""Landed files through the streaming ingest, delivered twice."""

import json

from larder import schemas
from larder.catalog import empty_catalog
from larder.operators.lineage import cut
from larder.streaming import landing


def test_stream_ingest(spark, tmp_path):
    start = empty_catalog(spark).with_tables(
        data_source=cut(spark.createDataFrame([("s", "feed", "Feed", None, True)], schemas.TABLES["data_source"]))
    )
    versions = [start]
    record = {"provider_code": "feed", "external_id": "a", "collected_at": "2024-06-01T00:00:00Z", "name": "Phở", "source_metadata": "{}"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(r) for r in [record, record]))

    def commit(catalog, _):
        versions.append(catalog.with_tables(place=cut(catalog.place), processing_record=cut(catalog.processing_record)))

    records = landing.read_landing(spark, str(tmp_path / "in"))
    landing.run_ingest(records, lambda: versions[-1], commit, str(tmp_path / "cp")).awaitTermination()
    done = [v for v in versions[1:] if v.place.count()]
    assert done[0].place.count() == 1
    assert done[0].processing_record.first().attempt_count == 1


def test_late_records_arrive_once(spark, tmp_path):
    def land(name, days):
        rows = [{"provider_code": "feed", "external_id": str(d), "collected_at": f"2024-06-{d:02d}T00:00:00Z", "name": "n"} for d in days]
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    (tmp_path / "in").mkdir()
    for name, days in (("1.json", [20, 20]), ("2.json", [20, 11, 1]), ("3.json", [1, 21])):
        land(name, days)
        landing.deliver_once(landing.read_landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(int(r.external_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 11, 20, 21]


def test_a_batch_is_sorted_by_as_many_tasks_as_it_has_splits(spark, tmp_path):
    """The rows of a whole batch were sorted in the session's number of shuffle partitions, however many there were."""
    rows = [{"provider_code": "feed", "external_id": str(n % 300), "collected_at": None if n % 3 else "2024-06-01T00:00:00Z"} for n in range(900)]
    (tmp_path / "in").mkdir()
    small = {"spark.sql.files.maxPartitionBytes": "8000", "spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        for name in ("1.json", "2.json"):
            (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
            landing.deliver_once(landing.read_landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.select(*landing.KEY).collect()
    assert set(map(tuple, got)) == {(r["provider_code"], r["external_id"], r["collected_at"]) for r in rows} and len(got) == len(set(got))
    assert len(list((tmp_path / "out" / "batch=0").glob("*.parquet"))) > 4
