"""Taxonomy loads and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas
from larder import taxonomy as tax
from larder.operators import upsert


def category_seeds(spark: SparkSession) -> DataFrame:
    rows = [(slug, name, slug, None, text, True) for name, slug, text in tax.CATEGORY_SEEDS]
    return spark.createDataFrame(rows, schemas.TABLES["category"])


def attribute_seeds(spark: SparkSession) -> DataFrame:
    rows = [(code, code, name, normalized, dimension, True) for code, name, normalized, dimension in tax.FOOD_ATTRIBUTES]
    return spark.createDataFrame(rows, schemas.TABLES["food_attribute"])


def load_taxonomy(current: DataFrame, seeds: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Seeds upserted by natural key; a conflict refreshes `columns` and keeps the id."""
    return upsert.overwrite(current, seeds.select(*current.columns), [key], columns)


def run_row(measures: DataFrame, run_type: str, model: str, params: str, started: Column, finished: Column, failure: str | None = None) -> DataFrame:
    """One run-log row from a one-row table of counts; missing counts are zero."""
    names = {
        "places_scanned": "scanned", "categories_applied": "categories_applied", "dishes_applied": "dishes_applied",
        "attributes_applied": "attributes_applied", "embeddings_applied": "embeddings_applied",
    }
    counts = [
        (F.col(source) if source in measures.columns else F.lit(0)).cast("long").alias(target) for target, source in names.items()
    ]
    return measures.select(
        F.lit(run_type).alias("run_type"), F.lit(model).alias("model"), F.lit(params).alias("params"),
        F.lit("failed" if failure else "completed").alias("status"), started.alias("started_at"), finished.alias("finished_at"),
        *counts, F.lit(failure).cast("string").alias("failure_message"),
    )


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_table(rows: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    """A catalog table as Parquet, clustered so that readers can prune.

    Rows are spread over the partition values by a hash of the whole row as well, so one
    large city becomes many files instead of one task.
    """
    writer = rows
    if partition_by:
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(64))
        writer = rows.repartition(*[F.col(c) for c in partition_by], spread)
    writer.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed by place, so that joins on the place need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
