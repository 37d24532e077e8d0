"""Station features: density, diversity, design, destination and distance, one row per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymill.operators import geometry as G
from quaymill.operators import graph as N
from quaymill.operators.tables import average_rank, entropy


def density_features(stations: DataFrame, population: DataFrame, radius: float) -> DataFrame:
    """``(id, population, density_km2)`` from raster cells; the area is that of the 64-gon buffer."""
    z = G.zonal_sum(stations, population, radius).withColumnRenamed("total", "population")
    return z.withColumn("density_km2", F.col("population") / (G.buffer_area(F.lit(float(radius))) / 1e6))


def landuse_features(stations: DataFrame, classes: DataFrame, radius: float) -> DataFrame:
    """``(id, landuse_entropy)`` from categorical cells."""
    h = G.zonal_shares(stations, classes, radius)
    k = F.count("*")
    return h.groupBy("id").agg(entropy(-F.sum(F.col("share") * F.log("share")), k).alias("landuse_entropy"))


def design_features(stations: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """``(id, intersections, intersection_density, street_density, circuity)`` from a directed street graph
    ``nodes (id, x, y)`` and ``edges (src, dst, length)``.

    Crossings have three or more directed edge ends. Edges that touch the circle count whole, each direction for
    itself; circuity is the median of length against the straight way, of edges between different places.
    """
    km2 = G.buffer_area(F.lit(float(radius))) / 1e6
    crossings = nodes.join(N.degree(edges.select("src", "dst")).where("degree >= 3").select("id"), "id", "left_semi")
    found = G.count_near(stations, crossings, radius).select("id", F.col("n").alias("intersections"))
    a, b = (nodes.select(F.col("id").alias(e), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for e, k in (("src", 1), ("dst", 2)))
    streets = edges.join(a, "src").join(b, "dst").withColumn("line", F.xxhash64("src", "dst", "length")).withColumn("part", F.lit(0))
    touched = G.near_segments(stations, streets.select("line", "part", "x1", "y1", "x2", "y2"), radius).select("id", "line").distinct()
    facts = streets.select("line", "length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("straight"))
    per = touched.join(facts, "line").groupBy("id").agg((F.sum("length") / 1000).alias("km"), F.median(F.when(F.col("straight") > 0, F.col("length") / F.col("straight"))).alias("circuity"))
    out = found.join(per, "id", "left").fillna(0.0, ["km"])
    return out.select("id", "intersections", (F.col("intersections") / km2).alias("intersection_density"), (F.col("km") / km2).alias("street_density"), "circuity")


def poi_features(stations: DataFrame, pois: DataFrame, radius: float, kinds: dict[str, list[str]]) -> DataFrame:
    """``(id, poi_<group> ..., poi_total)`` of ``pois (id, x, y, kind)``: all groups in one join, 0 where there is none."""
    j = G.near(stations, pois, radius).join(pois.select(F.col("id").alias("b_id"), "kind"), "b_id")
    got = j.groupBy(F.col("a_id").alias("id")).agg(*(F.count_if(F.col("kind").isin(*v)).alias(f"poi_{k}") for k, v in kinds.items()))
    out = stations.select("id").distinct().join(got, "id", "left").fillna(0)
    return out.withColumn("poi_total", sum((F.col(f"poi_{k}") for k in kinds), F.lit(0)))


def feeder_features(stations: DataFrame, stops: DataFrame, parking: DataFrame, rail: DataFrame, stop_m: float = 500.0, park_m: float = 500.0, hub_m: float = 1000.0) -> DataFrame:
    """``(id, bus_stops, parking_area_m2, is_intermodal_hub)``; ``parking`` has an ``area_m2``."""
    a = G.count_near(stations, stops, stop_m).select("id", F.col("n").alias("bus_stops"))
    b = G.count_near(stations, parking, park_m, "area_m2").select("id", F.col("area_m2").alias("parking_area_m2"))
    c = G.count_near(stations, rail, hub_m).select("id", (F.col("n") > 0).cast("int").alias("is_intermodal_hub"))
    return a.join(b, "id").join(c, "id")


def network_catchments(stations: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float, snap: float, ratio: float = 0.3) -> DataFrame:
    """``(id, network_area_m2, nodes, pnr, snap_m)``: each station starts at its nearest node within ``snap``, walks both ways along
    the shortest edges up to ``radius``, and the places reached make its catchment. Stations without a node have none."""
    start = G.nearest(stations, nodes, snap)
    both = N.both_ways(edges.withColumnRenamed("length", "weight"), "weight")
    reach = N.bounded_distances(start.select(F.col("a_id").alias("source"), F.col("b_id").alias("id")), both, radius)
    places = reach.join(nodes, "id").select(F.col("source").alias("id"), "x", "y")
    return G.catchments(places, radius, ratio).join(start.select(F.col("a_id").alias("id"), F.col("distance").alias("snap_m")), "id")


def assembled(stations: DataFrame, *parts: DataFrame, ranked: tuple[str, ...] = (), city: str | None = None) -> DataFrame:
    """Stations with all their features, joined by id, and ``<c>_pctl`` ranks within the city of the ``ranked`` ones."""
    out = stations
    for p in parts:
        out = out.join(p, "id", "left")
    for c in ranked:
        out = average_rank(out, [city] if city else [], c, f"{c}_pctl")
    return out
