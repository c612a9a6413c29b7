"""Continuous ingest of landed source records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder import schemas
from larder.catalog import Catalog
from larder.plans.ingest import ingest

KEY = ["provider_code", "external_id", "collected_at"]

#: Keys of earlier batches that one task holds against its share of a batch, about.
KNOWN_ROWS = 250_000


def read_landing(spark: SparkSession, path: str, file_format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.SOURCE_RECORD).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def deliver_once(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes every record once to `folder`, however late or often it is delivered.

    Each micro-batch has a folder of its own, which a replay overwrites; a record is new
    when no other batch has its key.  Records are dealt by key before they are sorted, to as
    many partitions as the batch has splits of its files or the known keys ask for, so what a task
    sorts does not grow with the batch.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        parts = max(batch.rdd.getNumPartitions(), int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # Structs of equal fields are equal, and null fields equal each other.
        key = F.struct(*KEY)
        known = None
        if batch_id > 0:
            known = batch.sparkSession.read.parquet(folder)
            known = known.filter(F.col("batch") != batch_id).select(key.alias("_key"))
            parts = max(parts, -(-known.count() // KNOWN_ROWS))
        fresh = batch.withColumn("_key", key).repartition(parts, "_key").dropDuplicates(["_key"])
        if known is not None:
            fresh = fresh.join(known.repartition(parts, "_key").hint("merge"), "_key", "left_anti")
        fresh.drop("_key").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_ingest(
    records: DataFrame,
    load: Callable[[], Catalog],
    commit: Callable[[Catalog, int], None],
    checkpoint: str,
    run_prefix: str = "stream",
) -> StreamingQuery:
    """Ingests every micro-batch into the catalog; no record is too late.

    `load` returns the current catalog version and `commit` writes the next one.  All
    merges are keyed, so a batch that is replayed after a failure changes nothing.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        commit(ingest(batch.dropDuplicates(KEY), load(), f"{run_prefix}-{batch_id}").catalog, batch_id)

    return (
        records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
