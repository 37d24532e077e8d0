"""Spatial and graph queries over whole tables.

Planar things and the vertices of lines are the first two components of all embeddings, in thousandths, planar stations the next two
of all; stations of the station table are projected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.operators import geometry as G
from quaymill.operators import graph as N
from quaymill.operators import stations as B
from quaymill.operators.proximity import inside, located
from quaymill.operators.tables import mix_entropy, zero_filled
from quaymill.plans.data_quality import BOUNDS
from quaymill.plans.registry import Registry
from quaymill.session import cut, table

R = Registry()
S = SparkSession
_P = "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label FROM embeddings), s AS (SELECT vec_id AS id, embedding[3]::DOUBLE * 1000 AS x, embedding[4]::DOUBLE * 1000 AS y, label FROM embeddings), t AS (SELECT * FROM p)"
_D = "sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2)"


def _points(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"), "label")


def _two(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Stations and things: of every row the third and fourth component, and the first two."""
    e = table(spark, d, "embeddings")
    stations = e.select(F.col("vec_id").alias("id"), (F.col("embedding")[2].cast("double") * 1000).alias("x"), (F.col("embedding")[3].cast("double") * 1000).alias("y"), "label")
    return stations, _points(spark, d)


def _stations(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "dim_station")
    p = located(s, "station_id", "latitude", "longitude", BOUNDS)
    x, y = G.utm(F.col("lat"), F.col("lon"), 43)
    line = s.where("station_id is not null").groupBy(F.col("station_id").alias("id")).agg(F.min("line").alias("line"), F.min("phase").alias("phase"), F.min("name").alias("name"), F.min("position_source").alias("source"))
    return p.select("id", "lat", "lon", x.alias("x"), y.alias("y")).join(line, "id")


@R.query(_P + f" SELECT s.id, count(t.id) AS stops FROM s LEFT JOIN t ON {_D} <= 50 GROUP BY 1")
def q_distance_count(spark: S, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return G.count_near(a, b, 50.0).select("id", F.col("n").alias("stops"))


@R.query(_P + f" SELECT s.id, coalesce(sum(t.label), 0) AS area FROM s LEFT JOIN t ON {_D} <= 50 GROUP BY 1")
def q_distance_sum(spark: S, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return G.count_near(a, b, 50.0, "label").select("id", F.col("label").alias("area"))


@R.query(_P + f" SELECT s.id AS a_id, arg_min(t.id, ({_D}, t.id)) AS b_id, round(min({_D}), 6) AS distance FROM s JOIN t ON {_D} <= 120 GROUP BY 1")
def q_nearest(spark: S, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return G.nearest(a, b, 120.0).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@R.query(_P + f" SELECT s.id AS a_id, t.id AS b_id, row_number() OVER (PARTITION BY s.id ORDER BY {_D}, t.id)::INT AS rk FROM s JOIN t ON {_D} <= 120 QUALIFY rk <= 6")
def q_knn(spark: S, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return G.nearest(a, b, 120.0, 6).select("a_id", "b_id", F.col("rk").cast("int").alias("rk"))


@R.query(_P + " SELECT id, round(least(sqrt(x ** 2 + y ** 2), sqrt((x - 100) ** 2 + (y + 50) ** 2)), 6) AS distance FROM p")
def q_min_centre(spark: S, d: str) -> DataFrame:
    return _points(spark, d).select("id", F.round(G.min_distance(F.col("x"), F.col("y"), [(0.0, 0.0), (100.0, -50.0)]), 6).alias("distance"))


@R.query(_P + " SELECT id, EXISTS (SELECT 1 FROM p q WHERE q.id <> p.id AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) < 5) AS crowded FROM p")
def q_proximity_flag(spark: S, d: str) -> DataFrame:
    return G.crowded(_points(spark, d), 5.0).select("id", "crowded")


@R.query(_P + """ SELECT a.label AS group_a, b.label AS group_b, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS distance, arg_min(a.id, (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.id, b.id)) AS a_id
FROM p a JOIN p b ON a.label < b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 30 GROUP BY 1, 2""")
def q_closest_pair(spark: S, d: str) -> DataFrame:
    return G.closest_between_groups(_points(spark, d), "label", 30.0).select("group_a", "group_b", F.round("distance", 6).alias("distance"), "a_id")


_SEG = "seg AS (SELECT label AS line, id AS part, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY label ORDER BY id)), g AS (SELECT * FROM seg WHERE x2 IS NOT NULL)"


def _segs(spark: S, d: str) -> DataFrame:
    """The points of each label, in id order, as a line."""
    lines = _points(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("pts"))
    return G.segments(lines, "label", "pts")


@R.query(_P + ", " + _SEG + " SELECT line, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 4) AS length, count(*) AS parts FROM g GROUP BY 1")
def q_line_length(spark: S, d: str) -> DataFrame:
    return G.line_lengths(_segs(spark, d)).select("line", F.round("length", 4).alias("length"), "parts")


_FOOT = "least(1, greatest(0, ((s.x - x1) * (x2 - x1) + (s.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"


@R.query(_P + ", " + _SEG + f""", f AS (SELECT s.id, line, sqrt((x1 + {_FOOT} * (x2 - x1) - s.x) ** 2 + (y1 + {_FOOT} * (y2 - y1) - s.y) ** 2) AS d FROM s, g)
SELECT id, line, round(min(d), 5) AS distance FROM f WHERE d <= 40 GROUP BY 1, 2""")
def q_project_to_line(spark: S, d: str) -> DataFrame:
    j = G.near_segments(_two(spark, d)[0], _segs(spark, d), 40.0)
    return j.groupBy("id", "line").agg(F.round(F.min("distance"), 5).alias("distance"))


@R.query(_P + ", " + _SEG + f""", f AS (SELECT s.id, line, sqrt((x1 + {_FOOT} * (x2 - x1) - s.x) ** 2 + (y1 + {_FOOT} * (y2 - y1) - s.y) ** 2) AS d FROM s, g)
SELECT s.id, n.line FROM s LEFT JOIN (SELECT id, arg_min(line, (d, line)) AS line FROM f WHERE d <= 15 GROUP BY 1) n USING (id)""")
def q_nearest_line(spark: S, d: str) -> DataFrame:
    return G.nearest_line(_two(spark, d)[0], _segs(spark, d), 15.0).select("id", "line")


@R.query(_P + ", " + _SEG + f""", f AS (SELECT s.id, s.label, line, sqrt((x1 + {_FOOT} * (x2 - x1) - s.x) ** 2 + (y1 + {_FOOT} * (y2 - y1) - s.y) ** 2) AS d FROM s, g)
SELECT s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = s.id AND f.line = s.label AND d <= 2)""")
def q_off_line(spark: S, d: str) -> DataFrame:
    return G.off_line(_two(spark, d)[0], _segs(spark, d), 2.0, "label").select("id")


@R.query(_P + ", " + _SEG + f""", f AS (SELECT s.id, s.label AS own, line, least(40, min(sqrt((x1 + {_FOOT} * (x2 - x1) - s.x) ** 2 + (y1 + {_FOOT} * (y2 - y1) - s.y) ** 2))) AS d FROM s, g GROUP BY 1, 2, 3)
SELECT own, line, round(median(d), 5) AS median_m FROM f GROUP BY 1, 2 HAVING min(d) < 40""")
def q_line_mapping(spark: S, d: str) -> DataFrame:
    return G.line_mapping(_two(spark, d)[0], _segs(spark, d), 40.0, "label").select("own", "line", F.round("median_m", 5).alias("median_m"))


@R.query(_P + ", " + _SEG + f""", f AS (SELECT s.id, s.label = line AS own, x1 + {_FOOT} * (x2 - x1) AS px, y1 + {_FOOT} * (y2 - y1) AS py, sqrt((x1 + {_FOOT} * (x2 - x1) - s.x) ** 2 + (y1 + {_FOOT} * (y2 - y1) - s.y) ** 2) AS d FROM s, g),
n AS (SELECT id, min((NOT own, d, px, py)) AS m FROM f WHERE d <= 40 GROUP BY 1)
SELECT s.id, CASE WHEN n.id IS NOT NULL AND s.id % 2 = 0 THEN round(m[3], 4) ELSE round(s.x, 4) END AS x, CASE WHEN n.id IS NOT NULL AND s.id % 2 = 0 THEN round(m[4], 4) ELSE round(s.y, 4) END AS y,
n.id IS NOT NULL AND s.id % 2 = 0 AS moved, CASE WHEN n.id IS NOT NULL AND s.id % 2 = 0 THEN round(m[2], 4) ELSE 0 END AS moved_m FROM s LEFT JOIN n USING (id)""")
def q_snapped(spark: S, d: str) -> DataFrame:
    """Stations of doubtful place (here those with an even id) moved onto their own line, or else the nearest one."""
    p = _two(spark, d)[0].withColumn("movable", F.col("id") % 2 == 0)
    out = G.snapped(p, _segs(spark, d), 40.0, "label", "movable")
    return out.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "moved", F.round("moved_m", 4).alias("moved_m"))


def q_merged_lines(spark: S, d: str) -> DataFrame:
    """Paths of each label's segments."""
    m = G.merged_lines(_segs(spark, d))
    return m.groupBy("line", "path").agg(F.count("*").alias("parts"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("length"))


R.query(_P + ", " + _SEG + " SELECT line, 0::BIGINT AS path, count(*) AS parts, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 3) AS length FROM g GROUP BY 1")(q_merged_lines)


def _cells(spark: S, d: str) -> DataFrame:
    """A raster of 20 x 20 cells: how many points fall into each."""
    p = _points(spark, d)
    c = p.groupBy(F.floor(F.col("y") / 20).alias("row"), F.floor(F.col("x") / 20).alias("col")).agg(F.count("*").cast("double").alias("value"))
    return c.select("row", "col", (F.col("col") * 20 + 10.0).alias("x"), (F.col("row") * 20 + 10.0).alias("y"), "value")


_CELLS = "c AS (SELECT floor(y / 20)::BIGINT AS row, floor(x / 20)::BIGINT AS col, count(*)::DOUBLE AS value FROM p GROUP BY 1, 2), t2 AS (SELECT row, col, col * 20 + 10.0 AS x, row * 20 + 10.0 AS y, value FROM c)"


@R.query(_P + ", " + _CELLS + " SELECT s.id, sum(t.value) AS total FROM s LEFT JOIN t2 t ON " + _D + " <= 60 GROUP BY 1")
def q_zonal_sum(spark: S, d: str) -> DataFrame:
    return G.zonal_sum(_two(spark, d)[0], _cells(spark, d), 60.0)


@R.query(_P + ", " + _CELLS + f""", h AS (SELECT s.id, t.value, count(*) AS n FROM s JOIN t2 t ON {_D} <= 60 GROUP BY 1, 2), q AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS share, count(*) OVER (PARTITION BY id) AS k FROM h)
SELECT id, round(CASE WHEN k <= 1 THEN 0 ELSE -sum(share * ln(share)) / ln(k) END, 6) AS entropy FROM q GROUP BY id, k""")
def q_zonal_classes(spark: S, d: str) -> DataFrame:
    """Classes of the cells around each station and how mixed they are."""
    h = G.zonal_shares(_two(spark, d)[0], _cells(spark, d), 60.0)
    k = F.count("*")
    return h.groupBy("id").agg(F.round(F.when(k <= 1, 0.0).otherwise(-F.sum(F.col("share") * F.log("share")) / F.log(k.cast("double"))), 6).alias("entropy"))


@R.query(_P + ", " + _CELLS + f""", u AS (SELECT row, col, value FROM t2 s WHERE value >= 2 AND NOT EXISTS (SELECT 1 FROM s t WHERE {_D} <= 30))
SELECT count(*) AS cells, sum(value) AS people FROM u""")
def q_unserved_cells(spark: S, d: str) -> DataFrame:
    """Dense cells outside every catchment, summed over the gaps they form."""
    gaps = G.coverage_gaps(_two(spark, d)[0], _cells(spark, d), 30.0, 20.0, 2.0, 0.0)
    return gaps.agg(F.sum("cells").alias("cells"), F.sum("total").alias("people"))


@R.query(_P + ", " + _CELLS + f""", u AS (SELECT row, col, row || ':' || col AS id, value FROM t2 s WHERE value >= 1 AND NOT EXISTS (SELECT 1 FROM s t WHERE {_D} <= 12)),
e AS (SELECT a.id AS src, b.id AS dst FROM u a JOIN u b ON abs(a.row - b.row) + abs(a.col - b.col) = 1)
SELECT gap, cells, total, cells * 400.0 AS area_m2 FROM (WITH RECURSIVE r(id, c) AS (SELECT id, id FROM u UNION SELECT e.dst, r.c FROM r JOIN e ON r.id = e.src),
c AS (SELECT id, min(c) AS gap FROM r GROUP BY 1) SELECT gap, count(*) AS cells, sum(value) AS total FROM c JOIN u USING (id) GROUP BY 1) WHERE cells * 400.0 > 500""")
def q_coverage_gaps(spark: S, d: str) -> DataFrame:
    """Connected dense places that no station serves, larger than a cell."""
    return G.coverage_gaps(_two(spark, d)[0], _cells(spark, d), 12.0, 20.0, 1.0, 500.0)


@R.query("SELECT station_id AS id, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM (SELECT station_id, min(latitude) AS latitude, min(longitude) AS longitude FROM dim_station WHERE latitude BETWEEN 8 AND 23 AND longitude BETWEEN 72 AND 88 GROUP BY 1)")
def q_projection_round_trip(spark: S, d: str) -> DataFrame:
    """Stations to UTM and back."""
    s = table(spark, d, "dim_station").where("latitude between 8 and 23 and longitude between 72 and 88").groupBy(F.col("station_id").alias("id")).agg(F.min("latitude").alias("a"), F.min("longitude").alias("b"))
    x, y = G.utm(F.col("a"), F.col("b"), 43)
    lat, lon = G.from_utm(F.col("x"), F.col("y"), 43)
    return s.select("id", x.alias("x"), y.alias("y")).select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_BOX = "SELECT n_nationkey AS region, 8.0 + n_nationkey * 0.1 AS lo, 8.0 + n_nationkey * 0.1 + 0.15 AS hi FROM nation"


@R.query(f"WITH pt AS (SELECT station_id AS id, min(latitude) AS lat, min(longitude) AS lon FROM dim_station WHERE latitude BETWEEN 8 AND 23 AND longitude BETWEEN 72 AND 88 GROUP BY 1), b AS ({_BOX}) SELECT id, region FROM pt JOIN b ON lat > lo AND lat <= hi AND lon BETWEEN 72.5 AND 73.4")
def q_point_in_region(spark: S, d: str) -> DataFrame:
    """Stations in overlapping rectangles, by the polygon test."""
    s = table(spark, d, "dim_station").where("latitude between 8 and 23 and longitude between 72 and 88").groupBy(F.col("station_id").alias("id")).agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    lo = 8.0 + F.col("n_nationkey") * 0.1
    hi = lo + 0.15
    w, e = F.lit(72.5), F.lit(73.4)
    sides = F.array(*(F.struct(a.alias("lat1"), b.alias("lon1"), c.alias("lat2"), f.alias("lon2")) for a, b, c, f in ((lo, w, lo, e), (lo, e, hi, e), (hi, e, hi, w), (hi, w, lo, w))))
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("region"), F.explode(sides).alias("s")).select("region", "s.*")
    return inside(s, edges)


@R.query("SELECT s_suppkey, round(abs((s_suppkey + 2.0) * (s_nationkey + 3.0)), 4) AS area, round((s_suppkey + 2.0) / 2, 4) AS cx, round((s_nationkey + 3.0) / 2, 4) AS cy FROM supplier")
def q_ring_area(spark: S, d: str) -> DataFrame:
    a, b = F.col("s_suppkey") + 2.0, F.col("s_nationkey") + 3.0
    z = F.lit(0.0)
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((z, z), (a, z), (a, b), (z, b))))
    r = table(spark, d, "supplier").select("s_suppkey", ring.alias("ring"))
    c = G.ring_centroid(F.col("ring"))
    return r.select("s_suppkey", F.round(G.ring_area(F.col("ring")), 4).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"))


def q_station_clusters(spark: S, d: str) -> DataFrame:
    """Stations within 150 m of each other as one."""
    return G.merged_by_proximity(_stations(spark, d), 150.0, "name")


def q_line_order(spark: S, d: str) -> DataFrame:
    """Stations of each line in order, and the distance to the next."""
    s = cut(_stations(spark, d).where("line is not null"), "stations")
    order = cut(G.ordered_along(s, "line"), "order")
    return order.join(G.consecutive(order, s, "line").withColumnRenamed("src", "id"), "id", "left").select("line", "id", "pos", F.col("dst").alias("next_id"), F.round("weight", 1).alias("metres"))


def q_fallback_guides(spark: S, d: str) -> DataFrame:
    return G.ordered_along(_stations(spark, d).where("phase = 'phase2'"), "line", by_axis=False)


for _q in (q_station_clusters, q_line_order, q_fallback_guides):
    R.query()(_q)

# ---- graphs

_G = "WITH n AS (SELECT count(*) AS n FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 3 + 1) % n AS dst, p_size::DOUBLE AS weight FROM part, n UNION ALL SELECT p_partkey, (p_partkey + 7) % n, (p_size % 9 + 4)::DOUBLE FROM part, n WHERE p_partkey % 3 = 0)"


def _graph(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = p.agg(F.count("*")).scalar()
    k = F.col("p_partkey")
    a = p.select(k.alias("src"), ((k * 3 + 1) % n).alias("dst"), F.col("p_size").cast("double").alias("weight"))
    b = p.where("p_partkey % 3 = 0").select(k.alias("src"), ((k + 7) % n).alias("dst"), (F.col("p_size") % 9 + 4).cast("double").alias("weight"))
    return cut(a.unionAll(b), "graph")


@R.query(_G + " SELECT id, count(*) AS degree, count(*) >= 3 AS is_crossing FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def q_degree(spark: S, d: str) -> DataFrame:
    return N.degree(_graph(spark, d)).withColumn("is_crossing", F.col("degree") >= 3)


_SPARSE = "WITH e AS (SELECT s_suppkey AS src, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS dst FROM supplier)"


@R.query(_SPARSE + """, RECURSIVE_DUMMY AS (SELECT 1) SELECT * FROM (WITH RECURSIVE b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(id, c) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT b.dst, r.c FROM r JOIN b ON r.id = b.src)
SELECT id, min(c) AS component FROM r GROUP BY 1)""")
def q_components(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = s.agg(F.count("*")).scalar()
    e = s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % n).alias("dst"))
    return N.components(e, s.select(F.col("s_suppkey").alias("id")))


@R.query(_G + """ SELECT * FROM (WITH RECURSIVE r(source, id, distance) AS (SELECT p_partkey, p_partkey, 0.0::DOUBLE FROM part UNION SELECT r.source, e.dst, r.distance + e.weight FROM r JOIN e ON r.id = e.src WHERE r.distance + e.weight <= 60)
SELECT source, id, min(distance) AS distance FROM r GROUP BY 1, 2)""")
def q_bounded_reach(spark: S, d: str) -> DataFrame:
    sources = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_partkey").alias("id"))
    return N.bounded_distances(sources, _graph(spark, d), 60.0)


def q_spanning_forest(spark: S, d: str) -> DataFrame:
    return N.spanning_forest(_graph(spark, d))


def q_centrality(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    n = s.agg(F.count("*")).scalar()
    k = F.col("s_suppkey")
    e = s.select(k.alias("src"), ((k * 3 + 1) % n).alias("dst"), (k % 5 + 1).cast("double").alias("weight"))
    c = N.centrality(e)
    return c.select("id", F.round("betweenness", 8).alias("betweenness"), F.round("closeness", 8).alias("closeness"))


def q_catchments(spark: S, d: str) -> DataFrame:
    """Walk catchments: the points of a neighbourhood graph each point reaches, their hull and the pedestrian ratio."""
    p = cut(_points(spark, d), "points")
    edges = G.near(p, p, 40.0).where("a_id <> b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("distance").alias("weight"))
    reach = N.bounded_distances(p.select(F.col("id").alias("source"), "id"), edges, 100.0)
    return G.catchments(reach.join(p.select("id", "x", "y"), "id").select(F.col("source").alias("id"), "x", "y"), 100.0)


@R.query("SELECT name, min(station_id) AS src, count(*) - 1 AS links FROM (SELECT DISTINCT station_id, name FROM dim_station WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def q_same_name_links(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "dim_station").select(F.col("station_id").alias("id"), "name").distinct()
    links = N.same_name_links(s)
    return links.join(s.withColumnRenamed("id", "src"), "src").groupBy("name").agg(F.min("src").alias("src"), F.count("*").alias("links"))


def q_network_position(spark: S, d: str) -> DataFrame:
    """Stations of a line as a graph: consecutive edges, same-name transfers, transfers between the closest stations of two lines; degree,
    interchange and terminal flags, component. Centralities are in ``q_centrality``."""
    s = cut(_stations(spark, d).where("line is not null"), "stations")
    e = cut(B.metro_edges(s), "network")
    deg = N.degree(e, s.select("id"), directed=False)
    return deg.join(N.components(e, s.select("id")), "id").select("id", "degree", (F.col("degree") > 2).cast("int").alias("is_interchange"), (F.col("degree") == 1).cast("int").alias("is_terminal"), "component")


def q_line_centrality(spark: S, d: str) -> DataFrame:
    """Position of the stations of the operating line with the most stations within its own graph."""
    s = cut(_stations(spark, d).where("line is not null"), "stations")
    top = s.groupBy("line").count().agg(F.max_by("line", F.struct("count", "line"))).scalar()
    p = B.network_position(s.where(F.col("line") == top))
    return p.select("id", "metro_degree", F.round("metro_betweenness", 8).alias("metro_betweenness"), F.round("metro_closeness", 10).alias("metro_closeness"), "is_terminal")


def q_station_build(spark: S, d: str) -> DataFrame:
    """The composed layer: canonical names matched with typed ones, placed from a map (vetoed by their line), from articles, or from a
    gazetteer by name and stem; doubtful places snapped, crowded ones marked."""
    names = table(spark, d, "station_names").where("station is not null").select(F.col("station").alias("name"), "line", F.col("ref_id").cast("bigint").alias("pos"))
    there = cut(_stations(spark, d), "stations")
    mapped = there.where("source = 'osm'").select("name", "x", "y", F.xxhash64("id").alias("pos"))
    articles = there.where("source = 'wikipedia'").select("name", "x", "y")
    gazetteer = there.where("source is null or source not in ('osm', 'wikipedia')").select("name", "x", "y")
    order = G.ordered_along(there.where("line is not null"), "line")
    pts = order.join(there.select("id", "x", "y"), "id").groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))  # a line's stations
    lines = cut(G.segments(pts, "line", "pts"), "lines")
    placed = cut(B.positioned(names, mapped, lines, articles, gazetteer), "placed")
    running = there.where("phase = 'phase1'").select("name", "line", "x", "y", "source", F.lit("high").alias("confidence"))
    return B.combined(running, placed, lines)


for _q in (q_line_centrality, q_station_build):
    R.query()(_q)


def q_morans_i(spark: S, d: str) -> DataFrame:
    return G.morans_i(_points(spark, d), "label", 150.0, 6, 999)


for _q in (q_spanning_forest, q_centrality, q_catchments, q_network_position, q_morans_i):
    R.query()(_q)


@R.query(_P + f""", nn AS (SELECT s.id AS a, t.id AS b, row_number() OVER (PARTITION BY s.id ORDER BY {_D}, t.id) AS rk FROM p s JOIN p t ON s.id <> t.id AND {_D} <= 150 QUALIFY rk <= 6),
w AS (SELECT a, b, 1.0 / count(*) OVER (PARTITION BY a) AS w FROM nn), z AS (SELECT id, label - (SELECT avg(label) FROM p) AS z FROM p)
SELECT round(sum(w * x.z * y.z) / sum(w) / (SELECT sum(z * z) / count(*) FROM z), 6) AS i FROM w JOIN z x ON a = x.id JOIN z y ON b = y.id""")
def q_morans_index(spark: S, d: str) -> DataFrame:
    return G.morans_i(_points(spark, d), "label", 150.0, 6).select(F.round("i", 6).alias("i"))


@R.query(_P + f""", c AS (SELECT s.id, t.label FROM s JOIN t ON {_D} <= 50) SELECT s.id, count(c.id) FILTER (c.label = 0) AS retail, count(c.id) FILTER (c.label = 1) AS office, count(c.id) AS total FROM s LEFT JOIN c USING (id) GROUP BY 1""")
def q_feature_assembly(spark: S, d: str) -> DataFrame:
    """Counts by kind around each station, in one join, 0 where there is none."""
    a, b = _two(spark, d)
    near = G.near(a, b, 50.0).join(b.select(F.col("id").alias("b_id"), "label"), "b_id").withColumnRenamed("a_id", "id")
    return zero_filled(a, "id", near, F.count_if(F.col("label") == 0).alias("retail"), F.count_if(F.col("label") == 1).alias("office"), F.count("*").alias("total"))


@R.query(_P + f""", h AS (SELECT s.id AS a_id, t.label, count(*) AS n FROM s JOIN t ON {_D} <= 60 GROUP BY 1, 2), q AS (SELECT a_id, n / sum(n) OVER (PARTITION BY a_id) AS share, count(*) OVER (PARTITION BY a_id) AS k FROM h)
SELECT a_id, k AS kinds, round(CASE WHEN k <= 1 THEN 0 ELSE -sum(share * ln(share)) / ln(k) END, 6) AS entropy FROM q GROUP BY a_id, k""")
def q_mix_around(spark: S, d: str) -> DataFrame:
    """Entropy of the kinds of places around each station."""
    a, b = _two(spark, d)
    near = G.near(a, b, 60.0).join(b.select(F.col("id").alias("b_id"), "label"), "b_id")
    return mix_entropy(near, "a_id", "label").withColumn("entropy", F.round("entropy", 6))


QUERIES, SQL = R.queries, R.sql
