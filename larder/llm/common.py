"""What the operators of this package share: inputs, scratch tables, Arrow helpers."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.lineage import shared_folder

#: One separator class for every operator that speaks of words: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"

_scratch: dict[str, list[str]] = {}
_scope: list[str] = [""]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns cannot clash, and a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_names(rows: DataFrame, *stems: str) -> list[str]:
    """Column names made from `stems` that `rows` does not have yet."""
    taken = {c.lower() for c in rows.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        names.append(stem)
    return names


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text is divisible by five (null id: no)."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: `rows` as a table in the folder that all executors share."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, noted under the current scope."""
    folder = shared_folder(spark, name)
    _scratch.setdefault(_scope[-1], []).append(folder)
    return folder


@contextmanager
def scratch_scope(name: str):
    """Scratch tables made meanwhile belong to `name`."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def drop_scratch(spark: SparkSession, scope: str) -> None:
    """Deletes the scratch tables of a scope; call it only when the results made from them are written."""
    for folder in _scratch.pop(scope, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay until the driver happens to collect the plans that made them; this lets it do so now."""
    gc.collect()
    spark._jvm.System.gc()


def settled(spark: SparkSession, name: str, make) -> DataFrame:
    """The rows of `make()` as a scratch table; the scratch tables and shuffle files that they took go."""
    folder = scratch_path(spark, name)
    with scratch_scope(folder):
        rows = make()
        rows.write.parquet(folder)
    schema = rows.schema
    del rows
    drop_scratch(spark, folder)
    drop_shuffles(spark)
    return spark.read.schema(schema).parquet(folder)


def stop_split(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle partitions for `rows` at `per_task` each, never under the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // per_task))


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, for values that are dear to compute."""
    import sys
    import types

    return vars(sys.modules.setdefault("_larder_process_cache", types.ModuleType("_larder_process_cache"))).setdefault(name, {})
