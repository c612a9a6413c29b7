"""Top rows per key, exact under skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_rows(
    rows: DataFrame,
    keys: list[str],
    order: list[Column],
    need: int | Column,
    spread: str,
    rank: str = "rank",
) -> DataFrame:
    """The first `need` rows of every key in `order`, numbered from 1 in `rank`.

    A constant `need` becomes a limit Spark applies on the map side of the shuffle,
    so a key holding most of the rows still ships only `need` rows per task.  A
    `need` that differs per row cannot be pushed that way: rows are first cut within
    (key, salt) and the survivors, at most salts x need, are ranked again.
    `spread` names a column that varies within a key; it feeds the salt.
    """
    if not isinstance(need, Column):
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= need)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(first))
        .filter(F.col(rank) <= need)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= need)
    )


def first_by(
    rows: DataFrame, keys: list[str], order: list[Column], value: list[str] | None = None
) -> DataFrame:
    """The single smallest row of every key; combines before the shuffle.

    `order` are ascending sort expressions; descending numbers are passed negated.
    """
    value = value or [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                      F.struct(*value).alias("_row"))
    return rows.groupBy(*keys).agg(F.min(ranked).alias("_first")).select(
        *keys, *[F.col("_first._row")[v].alias(v) for v in value]
    )
