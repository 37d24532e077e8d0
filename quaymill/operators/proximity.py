"""Points near other points or inside regions, through a grid whose cells are as large as the radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def repaired(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """``struct<lat,lon>`` of the place meant, or null.

    Exchanged coordinates, lost or added signs and a common power of ten (micro-degrees) are undone
    if the result lies in the bounds. Where the bounds of latitude and longitude are apart by less
    than a power of ten, as here, at most one reading does. NaN, null, 0 and others give null.
    """
    a, b = F.abs(lat.cast("double")), F.abs(lon.cast("double"))
    place = F.lit(None)
    steps = [(lat.cast("double"), lon.cast("double"))]
    for k in sorted(range(-2, 10), key=abs):
        f = F.lit(10.0**k)
        steps += [(a / f, b / f), (b / f, a / f)]
    for x, y in reversed(steps):
        place = F.when(x.between(south, north) & y.between(west, east), F.struct(x.alias("lat"), y.alias("lon"))).otherwise(place)
    return place


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


class Grid:
    """Rows of latitude of one radius' height; each row has its own number of columns, none narrower than the radius."""

    def __init__(self, radius_m: float):
        self.step = math.degrees(radius_m / EARTH_M) * 1.0001
        self.rows = max(1, math.ceil(180 / self.step))

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step).cast("int")

    def columns(self, row: Column) -> Column:
        # the widest span a radius can cover in this row and the next ones is at the row's end nearer to a pole
        worst = F.least(F.lit(89.999999), F.greatest(F.abs((row - 1) * self.step - 90.0), F.abs((row + 2) * self.step - 90.0)))
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(worst)) / self.step)).cast("int")

    def column(self, lon: Column, row: Column) -> Column:
        n = self.columns(row)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("int"), n)

    def key(self, row: Column, column: Column) -> Column:
        return F.shiftleft(row.cast("long"), 32) + column.cast("long")

    def cell(self, lat: Column, lon: Column) -> Column:
        return self.key(self.row(lat), self.column(lon, self.row(lat)))

    def around(self, lat: Column, lon: Column) -> Column:
        """The distinct cells that may hold points within the radius."""
        keys = []
        for d in (-1, 0, 1):
            row = self.row(lat) + d
            n = self.columns(row)
            keys += [self.key(row, F.pmod(self.column(lon, row) + e + n, n)) for e in (-1, 0, 1)]
        return F.array_distinct(F.array(*keys))


def located(df: DataFrame, key: str, lat: str, lon: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """One row ``(id, lat, lon)`` per key with a usable place; of disagreeing rows the south-western-most."""
    return (
        df.select(F.col(key).alias("id"), repaired(F.col(lat), F.col(lon), *bounds).alias("p"))
        .where("id is not null and p is not null")
        # as many tasks as the session has partitions: what follows makes several rows of each
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        .groupBy("id")
        .agg(F.min("p").alias("p"))
        .select("id", "p.lat", "p.lon")
    )


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """``(id_a, id_b, metres)``, id_a < id_b, of ``points (id, lat, lon)`` at most ``radius_m`` apart.

    Each point goes to its own cell once and asks that and those of its at most eight neighbours that come after it, so that each
    two cells meet once and the join's input grows with the points; the great-circle distance decides. Ids must be
    unique; points with a null or NaN coordinate take no part, equal places are 0 m apart, an empty table gives no pair.
    """
    grid = Grid(radius_m)
    ok = points.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    here = ok.select("id", "lat", "lon", grid.cell(F.col("lat"), F.col("lon")).alias("own"))
    ahead = F.filter(grid.around(F.col("lat"), F.col("lon")), lambda c: c >= F.col("own"))
    a = here.select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), "own", F.explode(ahead).alias("cell"))
    b = here.select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), F.col("own").alias("cell"))
    return (
        a.join(b, "cell")
        .where("own < cell or id_a < id_b")
        .withColumn("metres", great_circle(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
        .where(F.col("metres") <= radius_m)
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "metres")
    )


def inside(points: DataFrame, edges: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """``(id, region)``: the regions that contain each of ``points (id, lat, lon)``.

    ``edges (region, lat1, lon1, lat2, lon2)`` are the sides of simple polygons in degrees. An even-odd
    ray towards the east is cast per point: each side is given to the rows of ``cell_deg`` that it
    crosses and, as the ray needs it, to the point's row only; the crossings are counted per pair.
    Points on a side may fall on either side of it.
    """
    row = lambda c: F.floor((c + 90.0) / cell_deg)
    box = edges.groupBy("region").agg(F.min(F.least("lon1", "lon2")).alias("w"), F.max(F.greatest("lon1", "lon2")).alias("e"))
    e = edges.join(box, "region").withColumn("row", F.explode(F.sequence(row(F.least("lat1", "lat2")), row(F.greatest("lat1", "lat2")))))
    p = points.where("id is not null and lat is not null and lon is not null").select("id", "lat", "lon", row(F.col("lat")).alias("row"))
    crosses = ((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))) & (
        F.col("lon") < (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) + F.col("lon1")
    )
    return p.join(e, "row").where("lon between w and e").where(crosses).groupBy("id", "region").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "region")
