"""Places far denser than a request needs: what is read for it stays bounded, and the rows are those of a plain loop."""

import random

from pyspark.sql import functions as F

from larder.functions import geo
from larder.operators.geo_join import circle_cells, holding_radius, point_cells, within_radius
from larder.operators.nearest import newest_after


def spots(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, 10.0 + rng.random() * 0.01 * (i % 3 + 1), 106.0 + rng.random() * 0.01) for i in range(n)] + [(n, None, 106.0)]
    return rows, spark.createDataFrame(rows, "place_id long, lat double, lon double")


def test_neither_side_of_a_radius_join_is_broadcast(spark):
    """A scan's size in a file let the points of all levels be sent to the driver and back."""
    _, points = spots(spark, 50)
    circles = spark.createDataFrame([(1, 10.0, 106.0, 900.0)], "request_id long, latitude double, longitude double, radius double")
    plan = within_radius(circles, points, "latitude", "longitude", "radius")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert point_cells(points, levels=[2, 4]).count() == 50 * 2


def test_pairs_of_one_cell_are_dealt_to_tasks(spark):
    """All pairs of a cell were made by the task that its key fell to."""
    points = spark.range(400).select(F.col("id").alias("place_id"), F.lit(10.0).alias("lat"), (106.0 + F.col("id") * 1e-6).alias("lon"))
    circles = spark.range(30).select(
        F.col("id").alias("request_id"), F.lit(10.0).alias("latitude"), (106.0 + F.col("id") * 1e-5).alias("longitude"), F.lit(30.0).alias("radius")
    )
    found = within_radius(circles, points, "latitude", "longitude", "radius", pairs=500).withColumn("task", F.spark_partition_id()).cache()
    away = geo.distance(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    want = circles.crossJoin(points).filter(away <= 30).select("request_id", "place_id").collect()
    assert sorted(found.select("request_id", "place_id").collect()) == sorted(want) and len(want) > 5000
    assert max(r["count"] for r in found.groupBy("task").count().collect()) < 3000


def test_circles_are_distinct_before_their_cells(spark):
    """The cells of all circles of a task were held in one table to make them distinct."""
    rows = [(1, 10.0, 106.0, 5000.0), (1, 10.0, 106.0, 5000.0), (2, 10.0, 179.99, 5000.0), (3, -89.99, 0.0, 5000.0), (4, 10.0, 106.0, 3e7), (5, None, 1.0, 1.0)]
    cells = circle_cells(spark.createDataFrame(rows, "request_id long, latitude double, longitude double, radius double"), "latitude", "longitude", "radius")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[: plan.rindex("Generate")]
    found = cells.collect()
    assert len(found) == len(set(found)) and {r.request_id for r in found} == {1, 2, 3, 4}
    assert {r.column < 0 for r in found if r.request_id == 2} == {True, False}


def test_radius_holds_the_nearest(spark):
    rows, points = spots(spark, 400)
    asked = [(1, 10.005, 106.005), (2, 10.02, 106.001), (3, 50.0, 3.0), (4, -89.99, 179.99), (1, 10.005, 106.005)]
    circles = holding_radius(spark.createDataFrame(asked, "request_id long, latitude double, longitude double"), points, "latitude", "longitude", 5, 15_000.0)
    found = circles.collect()
    assert len(found) == len(asked)
    away = points.filter("lat is not null").crossJoin(circles.distinct()).withColumn("d", geo.distance(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")))
    inside = {r.request_id: r.n for r in away.filter("d <= radius").groupBy("request_id").agg(F.count("d").alias("n")).collect()}
    assert all(5 <= inside[k] < 400 for k in (1, 2))
    assert all(r.radius < 15_000 if r.request_id < 3 else r.radius == 15_000 for r in found)


def test_newest_after_takes_what_a_request_needs(spark):
    rng = random.Random(5)
    places = [(i, rng.choice([None, 3.0, 4.0, 4.5]), rng.choice([None, 1, 2]), rng.choice([None, 1000, 2000, 3000]) if i % 4 else 2000) for i in range(300)]
    ranks = spark.createDataFrame(places, "place_id long, rating double, price_level int, micros long")
    asked = [("a", 4, None, None, 2000, 150), ("b", 3, 4.0, None, 3000, 300), ("c", 5, None, 2, 2000, None), ("d", 4, 4.5, 1, 1000, 5), ("e", 2, None, None, 3000, -1), ("f", 3, 9.0, None, 3000, 9)]
    wanted = spark.createDataFrame(asked, "sig string, need int, min_rating double, price_level int, micros long, after_id long").withColumn(
        "after_updated_at", F.timestamp_micros("micros")
    )
    got = {}
    for r in newest_after(wanted, ranks).collect():
        got.setdefault(r.sig, []).append(r.place_id)

    def at(micros, place_id):
        return (micros is not None, micros or 0, place_id is not None, place_id or 0)

    for sig, need, least, price, micros, after_id in asked:
        fits = [p for p in places if at(p[3], p[0]) < at(micros, after_id) and (least is None or (p[1] or 0) >= least) and (price is None or p[2] == price)]
        want = [p[0] for p in sorted(fits, key=lambda p: at(p[3], p[0]), reverse=True)[:need]]
        assert sorted(got.get(sig, [])) == sorted(want), sig  # every place of the span was sent before
