"""What is broadcast by the size of its files."""

from pyspark.sql import functions as F

from larder.operators.lineage import cut
from larder.session import configure


def test_small_files_of_many_rows_are_not_taken_for_small_tables(spark):
    configure(spark)
    key = F.concat(F.lit("a long key that all rows share, and that a file holds once "), (F.col("id") % 2).cast("string"))
    small = cut(spark.range(800_000).select(key.alias("k"), F.col("id").alias("v")))
    size = small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 800_000 * 72 / 10  # key, and what a row takes besides
