from pyspark.sql import functions as F

from larder.operators.dealt_join import dealt_join


def test_every_pair_once_and_bounded_tasks(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i // 2) for i in range(300)] + [(9, 1), (9, 1)], "k int, a int")
    others = spark.createDataFrame([(i % 2 if i % 5 else None, i) for i in range(60)] + [(9, 1), (9, 1)], "k int, b int")
    for pairs in (100, 1 << 22):
        found = dealt_join(rows, others, ["k"], pairs)
        expected = rows.join(others, "k")
        assert sorted(found.select("k", "a", "b").collect()) == sorted(expected.select("k", "a", "b").collect())
    found = dealt_join(rows, others, ["k"], 100).withColumn("task", F.spark_partition_id())
    # One key alone makes over 2000 pairs, which the join by its key alone puts into one task.
    assert max(r["count"] for r in found.groupBy("task").count().collect()) < 1000


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k int, a int")
    assert dealt_join(none, none.withColumnRenamed("a", "b"), ["k"]).count() == 0
