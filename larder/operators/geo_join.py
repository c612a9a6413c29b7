"""Radius join on a grid whose cell size follows the radius.

Cells are rows of latitude cut into columns of longitude.  A point lies in one cell
per grid level; a circle asks for the cells of one level that its bounding box
touches, at most a handful.  The join is an equi-join on (level, row, column) and the
true distance decides afterwards, so the grid never changes a result, it only skips
pairs that are too far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import geo
from larder.operators.dealt_join import PAIRS, dealt_join

# Cell heights in metres; the last level is one cell for the whole globe.
LEVELS = [30, 60, 125, 250, 500, 1_000, 2_000, 4_000, 8_000, 16_000, 32_000, 64_000, 1_000_000]
_GLOBE = len(LEVELS)
# Halvings of one degree down to the smallest cell that is counted, about 3 m.
_FINEST = 15
_DEGREE = 3.141592653589793 * geo.EARTH_RADIUS_M / 180


def _level(radius: Column) -> Column:
    level = F.lit(_GLOBE)
    for i in range(len(LEVELS) - 1, -1, -1):
        level = F.when(radius <= LEVELS[i], F.lit(i)).otherwise(level)
    return level


def _height(level: Column) -> Column:
    """Cell height in degrees."""
    sizes = F.array(*[F.lit(size / _DEGREE) for size in LEVELS], F.lit(400.0))
    return F.element_at(sizes, level + 1)


def _width(row: Column, height: Column) -> Column:
    """Column width in degrees for one row of cells; never wider than 400 degrees."""
    middle = F.radians((row + 0.5) * height)
    return F.least(F.lit(400.0), height / F.greatest(F.lit(0.01), F.abs(F.cos(middle))))


def point_cells(points: DataFrame, lat: str = "lat", lon: str = "lon", levels: list[int] | None = None) -> DataFrame:
    """One row per point and level (each of `levels`, or every one) with `level`, `row`, `column`."""
    located = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    height = _height(F.col("level"))
    levels = range(_GLOBE + 1) if levels is None else levels
    return (
        located.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>")))
        .withColumn("row", F.floor(F.col(lat) / height))
        .withColumn("column", F.floor(F.col(lon) / _width(F.col("row"), height)))
    )


def circle_cells(circles: DataFrame, lat: str, lon: str, radius: str) -> DataFrame:
    """One row per circle and touched cell."""
    reach = F.col(radius) / _DEGREE
    height = _height(F.col("level"))
    # Widest longitude offset of any point of the circle; all of it near a pole.
    sine = F.sin(F.radians(F.least(reach, F.lit(90.0)))) / F.greatest(
        F.lit(1e-12), F.cos(F.radians(F.col(lat)))
    )
    spread = F.when(
        (F.abs(F.col(lat)) + reach >= 90) | (sine >= 1), F.lit(360.0)
    ).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine))))
    width = _width(F.col("row"), height)
    slack = 1e-7

    def columns(turn: float) -> Column:
        """Columns of a row that the circle touches, seen from the other side of the date line for a turn."""
        west = F.greatest(F.col(lon) + turn - F.col("_spread"), F.lit(-180.0))
        east = F.least(F.col(lon) + turn + F.col("_spread"), F.lit(180.0))
        touched = F.sequence(F.floor((west - slack) / width), F.floor((east + slack) / width))
        return F.when(west <= east, touched).otherwise(F.array().cast("array<bigint>"))

    # Circles are made distinct before cells multiply them: the table of a task that does so afterwards holds every cell.
    return (
        circles.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(radius).isNotNull())
        .distinct()
        .withColumn("level", _level(F.col(radius)))
        .withColumn("_spread", spread)
        .withColumn(
            "row",
            F.explode(
                F.sequence(
                    F.floor((F.col(lat) - reach - slack) / height),
                    F.floor((F.col(lat) + reach + slack) / height),
                )
            ),
        )
        # A circle across the date line continues on the other side of the globe.
        .withColumn("column", F.explode(F.array_distinct(F.concat(*[columns(turn) for turn in (0.0, 360.0, -360.0)]))))
        .drop("_spread")
    )


def holding_radius(circles: DataFrame, points: DataFrame, lat: str, lon: str, need: int, most_m: float) -> DataFrame:
    """`circles` with `radius`: `most_m`, or less where a smaller circle is known to hold `need` of the `points`.

    Points are counted in nested cells of halved degrees.  The smallest cell around a circle's centre
    that holds enough bounds the distance of its `need` nearest points, however dense the points are.
    """

    def cells(rows: DataFrame, latitude: str, longitude: str) -> DataFrame:
        fine = [F.floor((F.col(c) + offset) * (1 << _FINEST)).cast("long") for c, offset in ((latitude, 90.0), (longitude, 180.0))]
        return rows.withColumn("row", fine[0]).withColumn("column", fine[1]).filter("row is not null and column is not null")

    def nested(rows: DataFrame) -> DataFrame:
        up = rows.withColumn("halved", F.explode(F.sequence(F.lit(0), F.lit(_FINEST))))
        return up.withColumns({c: F.expr(f"shiftright(`{c}`, {_FINEST} - halved)") for c in ("row", "column")})

    fine = cells(points, "lat", "lon").groupBy("row", "column").agg(F.count(F.lit(1)).alias("n"))
    full = nested(fine).groupBy("halved", "row", "column").agg(F.sum("n").alias("n")).filter(F.col("n") >= need).drop("n")
    centres = nested(cells(circles.select(lat, lon).distinct(), lat, lon))
    smallest = centres.join(full, ["halved", "row", "column"]).groupBy(lat, lon).agg(F.max("halved").alias("halved"))
    # From a centre to a point of its cell: along its parallel, then along a meridian.
    side = F.pow(F.lit(0.5), F.col("halved")) * _DEGREE
    reach = F.least(side * (1 + F.cos(F.radians(F.col(lat)))) * 1.000001 + 0.01, F.lit(float(most_m)))
    return circles.join(smallest.select(lat, lon, reach.alias("radius")), [lat, lon], "left").withColumn(
        "radius", F.coalesce("radius", F.lit(float(most_m)))
    )


def within_radius(
    circles: DataFrame, points: DataFrame, lat: str, lon: str, radius: str, on: list[str] = (), pairs: int = PAIRS
) -> DataFrame:
    """Circles joined to the points (`lat`, `lon`) they contain, with `distance_m`.

    Points are dealt only to the levels that the radii use, at most fourteen, and the pairs of a cell to
    tasks of about `pairs`, however many circles and points share it.
    Circle columns `lat`/`lon`/`radius` are named by the caller and must differ from
    the point columns.  `on` names columns of both sides that must be equal as well.
    """
    cells = circle_cells(circles, lat, lon, radius)
    used = sorted(r.level for r in circles.filter(F.col(radius).isNotNull()).select(_level(F.col(radius)).alias("level")).distinct().collect())
    away = geo.distance(F.col("lat"), F.col("lon"), F.col(lat), F.col(lon))
    # Files understate rows in memory, and more so before cells multiply them: neither side is broadcast by their size.
    return (
        dealt_join(point_cells(points, levels=used), cells.hint("merge"), ["level", "row", "column", *on], pairs)
        .withColumn("distance_m", away)
        .filter(F.col("distance_m") <= F.col(radius))
        .drop("level", "row", "column")
    )
