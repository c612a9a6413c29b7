"""Source overview, runs, processing records, retries and coverage targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import taxonomy as tax
from larder.catalog import Catalog
from larder.functions import text as tx

MAX_ATTEMPTS = 5


def source_overview(catalog: Catalog) -> DataFrame:
    """Providers with number of source rows and last completed run, by name.

    Both sides are counted before the join, so sources and runs do not multiply.
    """
    sources = catalog.place_source.groupBy("data_source_id").agg(F.count_distinct("id").alias("source_count"))
    runs = catalog.crawl_run.filter("status = 'completed'").groupBy("data_source_id").agg(F.max("finished_at").alias("last_finished_at"))
    keyed = catalog.data_source.withColumn("data_source_id", F.col("id"))
    return (
        keyed.join(sources, "data_source_id", "left")
        .join(runs, "data_source_id", "left")
        .select("id", "code", "name", "base_url", "is_active", F.coalesce("source_count", F.lit(0)).alias("source_count"), "last_finished_at")
        .orderBy("name", "id")
    )


def runs(catalog: Catalog, limit: int, status: str | None = None) -> DataFrame:
    """Latest runs first."""
    rows = catalog.crawl_run if status is None else catalog.crawl_run.filter(F.col("status") == status)
    codes = catalog.data_source.select(F.col("id").alias("data_source_id"), F.col("code").alias("provider_code"))
    return rows.join(codes, "data_source_id").orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(limit)


def processing_records(catalog: Catalog, limit: int, status: str | None = None) -> DataFrame:
    rows = catalog.processing_record
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc_nulls_last("processed_at"), F.desc("id")).limit(limit)


def unresolved_matches(catalog: Catalog, limit: int) -> DataFrame:
    open_states = ["failed", "pending", "processing"]
    rows = catalog.processing_record.filter((F.col("stage") == "matching") & F.col("status").isin(open_states))
    return rows.orderBy(F.desc("id")).limit(limit)


def retry_targets(catalog: Catalog) -> DataFrame:
    """Failed or skipped records of discovery runs whose provider is active."""
    due = catalog.processing_record.filter(
        F.col("status").isin("failed", "skipped") & (F.col("attempt_count") < MAX_ATTEMPTS)
    ).select(F.col("id").alias("processing_record_id"), "crawl_run_id", "external_id", "attempt_count")
    discovery = catalog.crawl_run.filter("job_type = 'discovery'").select(F.col("id").alias("crawl_run_id"), "target", "job_type", "data_source_id")
    active = catalog.data_source.filter("is_active").select(F.col("id").alias("data_source_id"), F.col("code").alias("provider_code"))
    return due.join(discovery, "crawl_run_id").join(active, "data_source_id")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Found, processed and failed records per run."""
    return outcomes.groupBy("crawl_run_id").agg(
        F.count(F.lit(1)).alias("records_found"),
        F.count_if(F.col("status") == "completed").alias("records_processed"),
        F.count_if(F.col("status") == "failed").alias("records_failed"),
    )


def query_plan(districts: DataFrame, queries: DataFrame, city: str, limit: int) -> DataFrame:
    """Scan targets: every district with every query term, first spelling wins.

    `districts` and `queries` are (position, value); blank values are skipped and an
    empty district table means the city as a whole.  Both lists are distinct first.
    """
    def ordered(rows: DataFrame, value: str) -> DataFrame:
        kept = rows.select("position", tx.trim("value").alias(value)).filter(F.col(value) != "")
        return kept.groupBy(F.lower(value).alias(f"{value}_key")).agg(
            F.min("position").alias(f"{value}_at"), F.min_by(value, "position").alias(value)
        )

    terms = ordered(queries, "query")
    areas = ordered(districts, "district").select(
        F.concat_ws(", ", "district", F.lit(city.strip())).alias("location"), "district_at"
    )
    whole = terms.sparkSession.range(1).select(F.lit(city.strip()).alias("location"), F.lit(0).alias("district_at"))
    areas = whole if areas.isEmpty() else areas
    keyed = areas.withColumn("k", F.lit(1)).join(terms.withColumn("k", F.lit(1)), "k")
    return keyed.select(
        "query", "location", F.lit(min(max(int(limit), 1), 50)).alias("limit"), "district_at", "query_at"
    )


def coverage_gaps(plan: DataFrame, catalog: Catalog, provider: str = tax.SCAN_PROVIDER) -> DataFrame:
    """Targets of the plan the provider has not completed yet."""
    source = catalog.data_source.filter(F.col("code") == provider).select(F.col("id").alias("data_source_id"))
    done = (
        catalog.crawl_run.filter("status = 'completed'")
        .join(source, "data_source_id", "left_semi")
        .select(F.get_json_object("target", "$.query").alias("query"), F.get_json_object("target", "$.location").alias("location"))
        .distinct()
    )
    return plan.join(done, ["query", "location"], "left_anti")
