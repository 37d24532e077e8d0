"""Planar geometry on tables of points ``(id, x, y)`` and segments ``(line, x1, y1, x2, y2)``, in metres.

Neighbourhood joins are equi-joins on grid cells as large as the radius, verified by the exact distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.operators.graph import components
from quaymill.operators.tables import row_numbers
from quaymill.session import cut

_A, _F = 6_378_137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the transverse Mercator series in the third flattening.
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_BACK = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _EAST = 0.9996, 500_000.0


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) on WGS 84, within a millimetre in the zone."""
    p, l = F.radians(lat), F.radians(lon - (zone * 6 - 183))  # noqa: E741
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(p)) - e * F.atanh(e * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(l)), F.atanh(F.sin(l) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_TO, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _EAST + _K0 * _RECT * x, _K0 * _RECT * y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude of a UTM place north of the equator."""
    xi, eta = y / (_K0 * _RECT), (x - _EAST) / (_K0 * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_FROM, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    c = F.asin(F.sin(u) / F.cosh(v))
    lat = c
    for j, d in enumerate(_BACK, 1):
        lat = lat + d * F.sin(2 * j * c)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183)


#: UTM zones of the cities known. Fixed values.
CITY_ZONES = {"bengaluru": 43, "chennai": 44}


def city_zone(city: str) -> int:
    """The UTM zone of a city; an unknown city is an error, as a wrong zone would go unnoticed."""
    if city.lower() not in CITY_ZONES:
        raise ValueError(f"no projection is known for {city!r}: one of {', '.join(sorted(CITY_ZONES))}")
    return CITY_ZONES[city.lower()]


def catchment_circles(stations: DataFrame, radii: list[float]) -> DataFrame:
    """``stations (id, x, y, ...)`` with each of ``radii`` in metres and the area of its buffer. Places in degrees are refused: all
    of the table lies within 180 by 90, which no projected table of a city does. An empty table gives an empty one."""
    most = stations.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    if most["x"] is not None and most["x"] <= 180 and most["y"] <= 90:
        raise ValueError("the places are in degrees: project them before they are buffered")
    wide = stations.withColumn("radius_m", F.explode(F.array(*(F.lit(float(r)) for r in radii))))
    return wide.withColumn("buffer_area_m2", buffer_area(F.col("radius_m")))


def buffer_area(radius: Column) -> Column:
    """Area of the 64-gon that stands for a circle."""
    return 32 * F.sin(F.lit(2 * math.pi / 64)) * radius * radius


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``(a_id, b_id, distance)`` of the points of ``a`` and ``b`` at most ``radius`` apart. Points without coordinates take no part."""
    ok = "id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = a.where(ok).select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(steps).alias("o"))
    left = left.select("a_id", "ax", "ay", (_cell(F.col("ax"), radius) + F.col("o.i")).alias("cx"), (_cell(F.col("ay"), radius) + F.col("o.j")).alias("cy"))
    right = b.where(ok).select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    d = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return left.join(right, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select("a_id", "b_id", "distance")


def count_near(stations: DataFrame, things: DataFrame, radius: float, *sums: str) -> DataFrame:
    """``(id, n, sum of each of sums)`` of ``things`` within ``radius`` of every station, 0 where there is none."""
    pairs = near(stations, things, radius)
    if sums:
        pairs = pairs.join(things.select(F.col("id").alias("b_id"), *sums), "b_id")
    got = pairs.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    return stations.select("id").distinct().join(got, "id", "left").fillna(0)


def nearest(a: DataFrame, b: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """The ``k`` nearest ``b`` of each ``a`` within ``radius``: ``(a_id, b_id, distance, rk)``, ties by b_id."""
    pairs = near(a, b, radius)
    if k == 1:
        return pairs.groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("m")).select("a_id", "m.b_id", "m.distance", F.lit(1).alias("rk"))
    return pairs.withColumn("rk", F.row_number().over(W.partitionBy("a_id").orderBy("distance", "b_id"))).where(F.col("rk") <= k)


def min_distance(x: Column, y: Column, centres: list[tuple[float, float]]) -> Column:
    """Distance to the nearest of a few fixed places."""
    d = [F.hypot(x - cx, y - cy) for cx, cy in centres]
    return d[0] if len(d) == 1 else F.least(*d)


def closest_between_groups(points: DataFrame, group: str, radius: float) -> DataFrame:
    """For each two groups the closest pair of their points within ``radius``: ``(group_a, group_b, a_id, b_id, distance)``."""
    g = points.select("id", F.col(group).alias("g"))
    pairs = near(points, points, radius).join(g.toDF("a_id", "group_a"), "a_id").join(g.toDF("b_id", "group_b"), "b_id").where("group_a < group_b")
    best = pairs.groupBy("group_a", "group_b").agg(F.min(F.struct("distance", "a_id", "b_id")).alias("m"))
    return best.select("group_a", "group_b", "m.a_id", "m.b_id", "m.distance")


def crowded(points: DataFrame, radius: float) -> DataFrame:
    """``points`` with the flag ``crowded``: another point is less than ``radius`` away."""
    close = near(points, points, radius).where((F.col("a_id") != F.col("b_id")) & (F.col("distance") < radius)).select(F.col("a_id").alias("id")).distinct()
    return points.join(close.withColumn("crowded", F.lit(True)), "id", "left").fillna(False, ["crowded"])


def merged_by_proximity(points: DataFrame, radius: float, name: str) -> DataFrame:
    """Points whose chain of gaps is at most ``radius`` as one: ``(id, x, y, name, nodes)``, the least id, the mean place, the longest name with Latin letters, else the longest."""
    pairs = near(points, points, radius).where("a_id < b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    c = components(pairs, points)
    latin = F.coalesce(F.col(name).rlike("[A-Za-z]"), F.lit(False))
    best = F.max_by(F.col(name), F.struct(latin, F.coalesce(F.length(name), F.lit(0)), F.col(name)))
    return points.join(c, "id").groupBy(F.col("component").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), best.alias("name"), F.count("*").alias("nodes"))


# ---- lines


def segments(lines: DataFrame, line: str, points: str) -> DataFrame:
    """``(line, part, x1, y1, x2, y2)`` of an array of structs ``(x, y)`` per line. Lines of one point have none."""
    pairs = F.transform(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.struct(i.alias("part"), p["x"].alias("x1"), p["y"].alias("y1"), F.get(F.col(points), i + 1)["x"].alias("x2"), F.get(F.col(points), i + 1)["y"].alias("y2")))
    return lines.where(F.col(points).isNotNull()).select(F.col(line).alias("line"), F.explode(pairs).alias("s")).select("line", "s.*")


def line_lengths(segs: DataFrame) -> DataFrame:
    """Segments dissolved by line: ``(line, length, parts)``."""
    return segs.groupBy("line").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"), F.count("*").alias("parts"))


def merged_lines(segs: DataFrame, grain: float = 1e-6) -> DataFrame:
    """``(line, path, part, x1, y1, x2, y2)``: the segments of each label joined to paths, each in order along its path.

    Equal segments count once, in whichever direction. Paths run through places where exactly two segments of the label
    meet and end elsewhere; a ring starts at its least place. Places nearer than ``grain`` are one. Paths are found by
    their components, so that only one path's segments meet in a task. ``path`` numbers the paths of a label from 0 by their first place.
    """
    near_ = lambda c: F.round(F.col(c) / grain).cast("long")
    ends = segs.select("line", "x1", "y1", "x2", "y2", F.struct(near_("x1").alias("x"), near_("y1").alias("y")).alias("a"), F.struct(near_("x2").alias("x"), near_("y2").alias("y")).alias("b")).where("a <> b")
    turned = ends.select("line", *(F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"), ("a", "b"), ("b", "a"))))
    one = cut(turned.groupBy("line", "a", "b").agg(*(F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2"))).withColumn("id", F.xxhash64("line", "a", "b")), "segments")
    places = one.select("line", F.col("a").alias("p"), "id").union(one.select("line", "b", "id"))
    through = places.groupBy("line", "p").agg(F.collect_list("id").alias("ids"), F.count("*").alias("n")).where("n = 2")  # two ids
    joined = components(through.select(F.col("ids")[0].alias("src"), F.col("ids")[1].alias("dst")), one)

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        at: dict = {}
        rows = list(g.itertuples(index=False))
        for i, r in enumerate(rows):
            for e in ((r.ax, r.ay), (r.bx, r.by)):
                at.setdefault(e, []).append(i)
        loose = [e for e, ids in at.items() if len(ids) == 1]
        here = min(loose or at)
        used, out = set(), []
        while True:
            i = min((i for i in at[here] if i not in used), default=None)
            if i is None:
                break
            used.add(i)
            r = rows[i]
            forward = (r.ax, r.ay) == here
            out.append((r.line, r.path, len(out), *((r.x1, r.y1, r.x2, r.y2) if forward else (r.x2, r.y2, r.x1, r.y1))))
            here = (r.bx, r.by) if forward else (r.ax, r.ay)
        return pd.DataFrame(out, columns=["line", "path", "part", "x1", "y1", "x2", "y2"])

    kind = dict(segs.dtypes)["line"]
    flat = one.join(joined, "id").select("line", F.col("component").alias("path"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "x1", "y1", "x2", "y2")
    walked = cut(flat.groupBy("line", "path").applyInPandas(walk, f"line {kind}, path bigint, part int, x1 double, y1 double, x2 double, y2 double"), "paths")
    first = walked.where("part = 0").select("line", "path", F.struct("x1", "y1", "path").alias("o"))
    number = first.select("line", "path", (F.row_number().over(W.partitionBy("line").orderBy("o")) - 1).alias("n"))  # a label's paths
    return walked.join(number, ["line", "path"]).select("line", F.col("n").alias("path"), "part", "x1", "y1", "x2", "y2")


def ring_area(points: Column) -> Column:
    """Area of a ring of structs ``(x, y)``, closed or not."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def ring_centroid(points: Column) -> Column:
    """``struct<x, y>``, the centroid of a ring; of a ring without area the mean of its points."""
    n = F.size(points)
    nxt = lambda i: F.get(points, (i + 1) % n)
    total = lambda f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda s, t: s + t)
    cross = lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"]
    twice = total(cross)
    flat = F.abs(twice) < 1e-9
    one = lambda c: F.when(flat, total(lambda p: p[c]) / n).otherwise(total(lambda p, i: (p[c] + nxt(i)[c]) * cross(p, i)) / (3 * F.when(~flat, twice)))
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def _foot(x: Column, y: Column) -> tuple[Column, Column]:
    """The point of a segment nearest to (x, y)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.col("x1") + t * dx, F.col("y1") + t * dy


def near_segments(points: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """``(id, line, part, distance, px, py)``: the segments at most ``radius`` from each point, with the nearest place on them.

    A segment asks the cells around pieces of it that are no longer than a cell, so that a slanting one doesn't fill its box.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    pieces = F.greatest(F.lit(1), F.ceil(length / radius)).cast("int")
    lo, hi = ((F.col("piece") + e) / F.col("pieces") for e in (0, 1))
    at = lambda c, t: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    span = lambda c: F.sequence(_cell(F.least(at(c, lo), at(c, hi)), radius) - 1, _cell(F.greatest(at(c, lo), at(c, hi)), radius) + 1)
    cells = segs.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    wide = cells.select("line", "part", "x1", "y1", "x2", "y2", "cx", "cy").distinct()
    p = points.where("id is not null and x is not null and y is not null").select("id", "x", "y", _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    px, py = _foot(F.col("x"), F.col("y"))
    j = p.join(wide, ["cx", "cy"]).withColumn("px", px).withColumn("py", py).withColumn("distance", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")))
    return j.where(F.col("distance") <= radius).select("id", "line", "part", "distance", "px", "py")


def nearest_line(points: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """``(id, line, distance, px, py)`` of the nearest line within ``radius``; nulls where there is none."""
    best = near_segments(points, segs, radius).groupBy("id").agg(F.min(F.struct("distance", "line", "px", "py")).alias("m"))
    return points.select("id").distinct().join(best, "id", "left").select("id", "m.line", "m.distance", "m.px", "m.py")


def snapped(points: DataFrame, segs: DataFrame, radius: float, own: str, movable: str, own_only: bool = False) -> DataFrame:
    """Points where ``movable`` moved onto the nearest place of their ``own`` line, or else (unless ``own_only``) of any line, within ``radius``: ``(id, x, y, moved, moved_m)``."""
    j = near_segments(points, segs, radius).join(points.select("id", F.col(own).alias("own")), "id")
    j = j.where("line = own") if own_only else j
    best = j.groupBy("id").agg(F.min(F.struct((~F.coalesce(F.col("line") == F.col("own"), F.lit(False))).alias("other"), F.col("distance"), F.col("px"), F.col("py"))).alias("m"))
    go = F.col(movable) & F.col("m").isNotNull()
    return points.join(best, "id", "left").select(
        "id", F.when(go, F.col("m.px")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("m.py")).otherwise(F.col("y")).alias("y"), F.coalesce(go, F.lit(False)).alias("moved"), F.when(go, F.col("m.distance")).otherwise(0.0).alias("moved_m")
    )


def off_line(points: DataFrame, segs: DataFrame, radius: float, own: str) -> DataFrame:
    """Points farther than ``radius`` from their own line; points whose line has no segments stay."""
    have = segs.select(F.col("line").alias(own)).distinct()
    fine = near_segments(points, segs, radius).join(points.select("id", F.col(own).alias("own")), "id").where("line = own").select("id").distinct()
    return points.join(have, own, "left_semi").join(fine, "id", "left_anti")


def line_mapping(points: DataFrame, segs: DataFrame, radius: float, own: str) -> DataFrame:
    """How near the points of each ``own`` value lie to each line: ``(own, line, median_m, points, best)``; distances beyond ``radius`` count as it."""
    d = near_segments(points, segs, radius).groupBy("id", "line").agg(F.min("distance").alias("d"))
    p = points.select("id", F.col(own).alias("own")).where("own is not null")
    near_ = d.join(p, "id").groupBy("own", "line", "d").agg(F.count("*").alias("k"))
    seen = near_.groupBy("own", "line").agg(F.sum("k").alias("points")).join(p.groupBy("own").agg(F.count("*").alias("all")), "own")
    far = seen.where("all > points").select("own", "line", F.lit(float(radius)).alias("d"), (F.col("all") - F.col("points")).alias("k"))
    mid = near_.union(far).groupBy("own", "line").agg(F.percentile("d", 0.5, F.col("k")).alias("median_m"))
    out = mid.join(seen.select("own", "line", "points"), ["own", "line"]).select("own", "line", "median_m", "points")
    best = F.row_number().over(W.partitionBy("own").orderBy("median_m", "line")) == 1
    return out.withColumn("best", best)


# ---- kernels per group; a group is a station's catchment or a line's stations


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def polygon_area(p: np.ndarray) -> float:
    return float(abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(np.roll(p[:, 0], -1), p[:, 1])) / 2) if len(p) > 2 else 0.0


def _crosses(a, b, c: np.ndarray, d: np.ndarray) -> bool:
    """Segment ab properly crosses any of the segments cd."""
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    return bool(np.any((turn(c, d, a) * turn(c, d, b) < -1e-9) & (turn(a, b, c) * turn(a, b, d) < -1e-9)))


def concave_hull(points: np.ndarray, ratio: float = 0.3) -> np.ndarray:
    """A hull without long edges: from the convex hull, edges longer than ``ratio`` of the way from the
    shortest to the longest are dug inwards to the free point that sees them at the flattest angle, as long
    as no edge is crossed and no point is left outside. ``ratio`` 1 keeps the convex hull."""
    p = np.unique(points, axis=0)
    if len(p) < 4:
        return p
    hull = [tuple(x) for x in _hull(p)]
    if len(hull) < 3:
        return np.array(hull)
    free = {tuple(x) for x in p} - set(hull)
    length = lambda a, b: math.hypot(b[0] - a[0], b[1] - a[1])
    sides = [length(a, b) for a, b in zip(hull, hull[1:] + hull[:1])]
    gaps = [np.partition(np.hypot(*(p - q).T), 1)[1] for q in p]
    limit = min(gaps) + ratio * (max(sides) - min(gaps))
    i = 0
    while i < len(hull):
        a, b = hull[i], hull[(i + 1) % len(hull)]
        dug = False
        if free and (ab := length(a, b)) > limit:
            f = np.array(sorted(free))
            u = (b[0] - a[0]) / ab, (b[1] - a[1]) / ab
            along, away = (f - a) @ u, (f[:, 1] - a[1]) * u[0] - (f[:, 0] - a[0]) * u[1]
            can = (along > 1e-9) & (along < ab - 1e-9) & (away > -1e-9)  # points on the edge come first
            steep = np.maximum(np.arctan2(away, along), np.arctan2(away, ab - along))
            h = np.array(hull)
            for k in np.argsort(np.where(can, steep, np.inf))[:8]:
                if not can[k]:
                    break
                q = tuple(f[k])
                left = (f[:, 0] - a[0]) * (q[1] - a[1]) - (f[:, 1] - a[1]) * (q[0] - a[0])
                right = (f[:, 0] - q[0]) * (b[1] - q[1]) - (f[:, 1] - q[1]) * (b[0] - q[0])
                if np.any((away > 1e-9) & (left > 1e-9) & (right > 1e-9)):
                    continue
                if _crosses(np.array(a), np.array(q), h, np.roll(h, -1, 0)) or _crosses(np.array(q), np.array(b), h, np.roll(h, -1, 0)):
                    continue
                hull.insert(i + 1, q)
                free.discard(q)
                dug = True
                break
        i += not dug
    return np.array(hull)


def catchments(reached: DataFrame, radius: float, ratio: float = 0.3, few: float = 50.0) -> DataFrame:
    """``(id, network_area_m2, nodes, pnr)`` from ``reached (id, x, y)``: the area of a concave hull around the
    nodes a station reaches, against its circle. Fewer than four nodes, or a hull without area, count as a disc of ``few`` metres."""
    disc = math.pi * few * few

    def one(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y"]].dropna().to_numpy(float)
        area = polygon_area(concave_hull(p, ratio)) if len(np.unique(p, axis=0)) >= 4 else 0.0
        area = area or disc
        return pd.DataFrame({"id": [g["id"].iloc[0]], "network_area_m2": [area], "nodes": [len(p)], "pnr": [min(area / (math.pi * radius * radius), 1.0)]})

    kind = dict(reached.dtypes)["id"]
    return reached.select("id", "x", "y").groupBy("id").applyInPandas(one, f"id {kind}, network_area_m2 double, nodes bigint, pnr double")


def _chain(p: np.ndarray, start: int) -> list[int]:
    """From ``start`` always to the nearest point that is left."""
    left, order = np.ones(len(p), bool), [start]
    left[start] = False
    while left.any():
        d = np.where(left, np.hypot(*(p - p[order[-1]]).T), np.inf)
        order.append(int(np.argmin(d)))
        left[order[-1]] = False
    return order


def ordered_along(points: DataFrame, group: str, by_axis: bool = True) -> DataFrame:
    """``(group, id, pos)``: points chained nearest to nearest, from the end of the principal axis (or the
    south-western-most point if not ``by_axis``). A group is one line's stations."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        p = g[["x", "y"]].to_numpy(float)
        if by_axis and len(p) > 1:
            c = p - p.mean(0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1]
            axis = axis if axis[np.argmax(np.abs(axis))] > 0 else -axis
            start = int(np.argmin(c @ axis))
        else:
            start = int(np.lexsort((p[:, 1], p[:, 0]))[0])
        return g.iloc[_chain(p, start)].assign(pos=range(len(g)))[["grp", "id", "pos"]]

    kinds = dict(points.dtypes)
    rows = points.where(F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(group).alias("grp"), "id", "x", "y")
    return rows.groupBy("grp").applyInPandas(one, f"grp {kinds[group]}, id {kinds['id']}, pos bigint").withColumnRenamed("grp", group)


def consecutive(ordered: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Edges ``(src, dst, weight)`` between neighbours of an order, weighted by their distance."""
    nxt = ordered.withColumn("dst", F.lead("id").over(W.partitionBy(group).orderBy("pos"))).where("dst is not null").select(F.col("id").alias("src"), "dst")
    a, b = (points.select(F.col("id").alias(e), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y")) for e in ("src", "dst"))
    return nxt.join(a, "src").join(b, "dst").select("src", "dst", F.hypot(F.col("dstx") - F.col("srcx"), F.col("dsty") - F.col("srcy")).alias("weight"))


# ---- rasters as cell tables (row, col, x, y, value)


def zonal_sum(stations: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """``(id, total)`` of the cells whose centre is within ``radius``; null where no cell is."""
    c = cells.where("value is not null and not isnan(value)").select(F.concat_ws(":", "row", "col").alias("id"), "x", "y", "value")
    got = near(stations, c, radius).join(c.select(F.col("id").alias("b_id"), "value"), "b_id").groupBy(F.col("a_id").alias("id")).agg(F.sum("value").alias("total"))
    return stations.select("id").distinct().join(got, "id", "left")


def zonal_shares(stations: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """``(id, value, n, share)``: the classes of the cells around each station."""
    c = cells.where("value is not null").select(F.concat_ws(":", "row", "col").alias("id"), "x", "y", "value")
    n = near(stations, c, radius).join(c.select(F.col("id").alias("b_id"), "value"), "b_id").groupBy(F.col("a_id").alias("id"), "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("id")))


def coverage_gaps(stations: DataFrame, cells: DataFrame, radius: float, size: float, least_value: float, least_area: float) -> DataFrame:
    """Dense places no station serves: cells of at least ``least_value`` outside all catchments, joined to their
    four neighbours: ``(gap, cells, total, area_m2)`` of gaps larger than ``least_area``."""
    c = cells.where(F.col("value") >= least_value).select(F.concat_ws(":", "row", "col").alias("id"), "row", "col", "x", "y", "value")
    served = near(c, stations, radius).select(F.col("a_id").alias("id")).distinct()
    bare = cut(c.join(served, "id", "left_anti"), "bare")
    there = bare.select("row", "col", F.col("id").alias("dst"))
    right = bare.select((F.col("row")).alias("row"), (F.col("col") + 1).alias("col"), F.col("id").alias("src")).join(there, ["row", "col"])
    down = bare.select((F.col("row") + 1).alias("row"), F.col("col"), F.col("id").alias("src")).join(there, ["row", "col"])
    label = components(right.select("src", "dst").union(down.select("src", "dst")), bare)
    out = bare.join(label, "id").groupBy(F.col("component").alias("gap")).agg(F.count("*").alias("cells"), F.sum("value").alias("total"))
    return out.withColumn("area_m2", F.col("cells") * (size * size)).where(F.col("area_m2") > least_area)


def morans_i(points: DataFrame, value: str, radius: float, k: int = 6, permutations: int = 0, seed: int = 3) -> DataFrame:
    """``(i, p)``: spatial autocorrelation with the ``k`` nearest neighbours within ``radius``, each row of weights adding up to 1;
    p from ``permutations`` rearrangements by hash, null if none."""
    p = points.select("id", "x", "y", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    p = cut(p.withColumn("z", F.col("v") - p.agg(F.avg("v")).scalar()), "points")
    nn = near(p, p, radius).where("a_id <> b_id").withColumn("rk", F.row_number().over(W.partitionBy("a_id").orderBy("distance", "b_id"))).where(F.col("rk") <= k)
    w = cut(nn.withColumn("w", 1 / F.count("*").over(W.partitionBy("a_id"))).select("a_id", "b_id", "w"), "weights")
    z = p.select("id", "z")

    def index(zs: DataFrame, *by: str) -> DataFrame:
        a, b = zs.select(*by, F.col("id").alias("a_id"), F.col("z").alias("za")), zs.select(*by, F.col("id").alias("b_id"), F.col("z").alias("zb"))
        top = w.join(a, "a_id").join(b, [*by, "b_id"])
        return top.groupBy(*by).agg((F.sum(F.col("w") * F.col("za") * F.col("zb")) / F.sum("w")).alias("top"))

    n = z.agg((F.sum(F.col("z") * F.col("z")) / F.count("*")).alias("v"))
    i = index(z).withColumn("i", F.col("top") / n.scalar())
    if not permutations:
        return i.select("i", F.lit(None).cast("double").alias("p"))
    many = z.select("id", "z", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("rep"))
    ranked = row_numbers(many.withColumn("h", F.xxhash64("id", "rep", F.lit(seed))), ["rep"], ["h", "id"], "slot")
    home = row_numbers(many, ["rep"], ["id"], "slot").select("rep", "slot", "id")
    drawn = cut(ranked.select("rep", "slot", "z").join(home, ["rep", "slot"]).select("rep", "id", "z"), "drawn")
    tops = index(drawn, "rep").withColumn("perm", F.col("top") / n.scalar())
    return tops.withColumn("i", i.select("i").scalar()).groupBy("i").agg(((F.count_if(F.abs("perm") >= F.abs("i")) + 1) / (F.count("*") + 1)).alias("p"))
