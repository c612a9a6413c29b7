"""Equi-join whose tasks make a bounded number of pairs, however many rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that one task makes, about.
PAIRS = 1 << 22


def dealt_join(rows: DataFrame, others: DataFrame, keys: list[str], pairs: int = PAIRS) -> DataFrame:
    """`rows` joined to `others` on `keys`, every pair once.

    Where a key makes more than `pairs` pairs, its `rows` are dealt to shards by their contents and each
    shard meets all of its `others`.  Adaptive execution sizes partitions by their bytes and cannot see the
    pairs that narrow rows multiply to, so the shards go to a number of partitions that follows from the pairs.
    """
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(others.groupBy(*keys).agg(F.count(F.lit(1)).alias("_others")), keys)
    made = made.withColumn("_pairs", F.col("_rows").cast("double") * F.col("_others"))
    heavy = made.filter(F.col("_pairs") > pairs).select(*keys, F.least("_rows", F.ceil(F.col("_pairs") / pairs)).cast("int").alias("_shards"))
    total, most = (n or 0 for n in made.agg(F.sum("_pairs"), F.max("_pairs")).first())
    if total <= pairs:
        return rows.join(others, keys)
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(2 * total // pairs) + 1)
    if most <= pairs:
        return rows.repartition(tasks, *keys).hint("merge").join(others.repartition(tasks, *keys), keys)
    shards = F.coalesce("_shards", F.lit(1))
    dealt = rows.withColumn("_deal", F.xxhash64(*rows.columns)).join(heavy, keys, "left")
    dealt = dealt.withColumn("_shard", F.pmod("_deal", shards).cast("int")).drop("_shards", "_deal")
    met = others.join(heavy, keys, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1))).drop("_shards")
    on = [*keys, "_shard"]
    return dealt.repartition(tasks, *on).hint("merge").join(met.repartition(tasks, *on), on).drop("_shard")
