"""The catalog as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from larder import schemas


@dataclass(frozen=True)
class Catalog:
    """One DataFrame per table; tables a job does not read may be left out."""

    place: DataFrame | None = None
    location: DataFrame | None = None
    category: DataFrame | None = None
    place_category: DataFrame | None = None
    dish: DataFrame | None = None
    food_attribute: DataFrame | None = None
    dish_attribute: DataFrame | None = None
    hours: DataFrame | None = None
    image: DataFrame | None = None
    review: DataFrame | None = None
    data_source: DataFrame | None = None
    place_source: DataFrame | None = None
    crawl_run: DataFrame | None = None
    processing_record: DataFrame | None = None
    vector: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}

    def with_tables(self, **tables: DataFrame) -> "Catalog":
        return replace(self, **tables)


def read_catalog(spark: SparkSession, root: str) -> Catalog:
    """Every catalog table below `root`, with its declared schema."""
    return Catalog(
        **{
            f.name: spark.read.schema(schemas.TABLES[f.name]).parquet(f"{root}/{f.name}")
            for f in fields(Catalog)
        }
    )


def empty_catalog(spark: SparkSession) -> Catalog:
    return Catalog(
        **{f.name: spark.createDataFrame([], schemas.TABLES[f.name]) for f in fields(Catalog)}
    )


def write_catalog(catalog: Catalog, root: str) -> None:
    """One new version of every table; `root` must not be the version being read."""
    for name, table in catalog.tables().items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
