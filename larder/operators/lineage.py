"""Cutting lineage where a job loops, in a folder every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    A machine-local folder is used only when the whole session is one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_root()


@lru_cache(maxsize=None)
def _local_root() -> str:
    """One folder for the tables of a one-machine process; it goes with the process."""
    folder = tempfile.mkdtemp(prefix="larder-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """`rows` as a table in the shared folder; later plans start from a scan of it.

    Unlike a checkpoint's, its scan reads only the columns a plan needs and knows its size, so small tables are
    broadcast by measure.
    """
    folder = shared_folder(rows.sparkSession, "cut")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
