"""Keyed merges of an incoming table into an existing one.

Incoming rows are reduced to one per key before they meet the existing table.  The
reduction is an aggregate, so a key delivered a million times is combined on the map
side and never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.topk import first_by


def _on(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in keys])


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row with the largest `newest` columns of every key."""
    value = [c for c in rows.columns if c not in keys]
    picked = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(newest)],
                            F.struct(*value).alias("_row")))
    return rows.groupBy(*keys).agg(picked.alias("_last")).select(
        *keys, *[F.col("_last._row")[v].alias(v) for v in value]
    )


def replace(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows win wholly; columns in `keep` hold on to the old value."""
    return _merge(old, new, keys, {c: "old" for c in keep}, "new")


def fill(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New non-NULL values win; a missing new value never erases an old one."""
    return _merge(old, new, keys, {}, "fill")


def overwrite(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """On a conflict only `columns` take the new value."""
    return _merge(old, new, keys, {c: "new" for c in columns}, "old")


def _merge(old, new, keys, modes, default) -> DataFrame:
    joined = new.withColumn("_new", F.lit(True)).alias("new").join(
        old.withColumn("_old", F.lit(True)).alias("old"), _on(keys), "full_outer"
    )
    has_new, has_old = F.col("new._new").isNotNull(), F.col("old._old").isNotNull()
    columns = []
    for c in old.columns:
        n, o = F.col(f"new.{c}"), F.col(f"old.{c}")
        mode = "key" if c in keys else modes.get(c, default)
        if mode == "key":
            value = F.when(has_new, n).otherwise(o)
        elif mode == "new":
            value = F.when(has_new, n).otherwise(o)
        elif mode == "old":
            value = F.when(has_old, o).otherwise(n)
        else:
            value = F.coalesce(n, o)
        columns.append(value.alias(c))
    return joined.select(*columns)


def insert_new(
    old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Old rows plus incoming rows whose key is not present yet; first incoming wins.

    NULL keys compare as equal.
    """
    if order:
        new = first_by(new, keys, order)
    fresh = new.alias("new").join(old.select(*keys).alias("old"), _on(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))
