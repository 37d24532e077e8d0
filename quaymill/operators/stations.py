"""Stations composed from several sources, and their network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymill.functions.scalars import stem
from quaymill.operators import geometry as G
from quaymill.operators import graph as N
from quaymill.operators.matching import match_names
from quaymill.operators.tables import row_numbers
from quaymill.session import cut

# Metres.
OFF_LINE_M = 3000.0
SNAP_M = 2500.0
SPACING_M = 250.0
TRANSFER_M = 1500.0


def canonical_names(entries: DataFrame, canon: DataFrame, explicit: DataFrame, threshold: float = 0.72, aliases: DataFrame | None = None) -> DataFrame:
    """``(name, station, how)`` of each distinct ``entries (name, pos)``: by the ``explicit (name, station)`` table where its station is one of
    ``canon (name, pos)``, the rest by likeness among the stations that are left, one to one; null where nothing is left for it."""
    names = entries.where("name is not null").groupBy("name").agg(F.min("pos").alias("pos"))
    listed = canon.select(F.col("name").alias("station")).where("station is not null").distinct()
    given = explicit.where("name is not null and station is not null").groupBy("name").agg(F.min("station").alias("station")).join(listed, "station", "left_semi")
    known = cut(names.join(given, "name").select("name", "station"), "given")
    rest = names.join(known.select("name"), "name", "left_anti")
    free = canon.join(known.select(F.col("station").alias("name")), "name", "left_anti")
    found = match_names(rest, free, threshold, aliases).select(F.col("l").alias("name"), F.col("r").alias("station"))
    return known.withColumn("how", F.lit("explicit")).unionByName(found.withColumn("how", F.when(F.col("station").isNotNull(), "likeness")))


def positioned(wanted: DataFrame, mapped: DataFrame, lines: DataFrame, articles: DataFrame, gazetteer: DataFrame, threshold: float = 0.88) -> DataFrame:
    """``(name, line, x, y, source, confidence)`` of each ``wanted (name, line, pos)``, from the best source that has a place; nulls where none has.

    First ``mapped (name, x, y, pos)`` features of a map, matched by likeness one to one, unless they lie more than 3 km from
    the station's own line (``lines`` are segments by line; without its line a match stands); then ``articles (name, x, y)`` by name; then ``gazetteer
    (name, x, y)`` by name, and by the name without its ordinal and role word. The first two are sure, the last two not.
    """
    want = cut(wanted.where("name is not null").groupBy("name").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("pos")), "wanted")
    places = mapped.where("name is not null").groupBy("name").agg(F.min(F.struct("pos", "x", "y")).alias("p")).select("name", "p.*")
    match = match_names(want, places, threshold).where("r is not null")
    hits = match.join(places.select(F.col("name").alias("r"), "x", "y"), "r").join(want.select(F.col("name").alias("l"), "line"), "l").select(F.col("l").alias("id"), "line", "x", "y")
    hits = cut(hits, "hits")
    strays = G.off_line(hits, lines, OFF_LINE_M, "line").select("id")
    kept = hits.join(strays, "id", "left_anti").select(F.col("id").alias("name"), F.struct("x", "y").alias("by_map"))
    place = lambda df, name: df.where("name is not null and x is not null and y is not null").groupBy("name").agg(F.min(F.struct("x", "y")).alias(name))
    stems = want.select("name", stem(F.col("name")).alias("stem")).where("stem <> name and stem <> ''")
    by_stem = stems.join(place(gazetteer, "by_stem").withColumnRenamed("name", "stem"), "stem").select("name", "by_stem")
    out = want.join(kept, "name", "left").join(place(articles, "by_article"), "name", "left").join(place(gazetteer, "by_name"), "name", "left").join(by_stem, "name", "left")
    steps = [("by_map", "osm", "high"), ("by_article", "wikipedia", "high"), ("by_name", "nominatim", "low"), ("by_stem", "nominatim_stem", "low")]
    where_ = F.coalesce(*(F.col(c) for c, _, _ in steps))

    def first(values: list[str]) -> Column:
        return F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(v)) for (c, _, _), v in zip(steps, values)))

    return out.select("name", "line", where_["x"].alias("x"), where_["y"].alias("y"), first([s for _, s, _ in steps]).alias("source"), first([c for _, _, c in steps]).alias("confidence"))


def combined(operating: DataFrame, planned: DataFrame, lines: DataFrame, prefix: str = "MAA") -> DataFrame:
    """One layer ``(station_id, name, line, phase, x, y, source, confidence, moved_m)`` of ``operating`` and ``planned`` stations ``(name, line, x, y, source, confidence)``.

    Planned stations of no sure place move onto their line, if one is within reach, and are then of medium confidence; planned
    stations nearer than 250 m to another planned one are of low confidence, as their places can't both be right. Stations
    without a place stay out. Ids count operating stations by name first, then the planned ones.
    """
    there = planned.where("x is not null and y is not null").withColumn("id", F.col("name")).withColumn("movable", F.col("confidence") == "low")
    there = cut(there, "planned")
    moved = cut(G.snapped(there, lines, SNAP_M, "line", "movable", own_only=True), "moved")
    close = G.crowded(moved.select("id", "x", "y"), SPACING_M).select("id", "crowded")
    sure = F.when(F.col("crowded"), "low").when(F.col("moved"), "medium").otherwise(F.col("confidence"))
    second = there.drop("x", "y").join(moved, "id").join(close, "id").select("name", "line", F.lit("phase2").alias("phase"), "x", "y", "source", sure.alias("confidence"), "moved_m")
    first = operating.where("x is not null and y is not null").select("name", "line", F.lit("phase1").alias("phase"), "x", "y", "source", "confidence", F.lit(0.0).alias("moved_m"))
    both = row_numbers(first.unionByName(second), [], ["phase", "name", "line", "x", "y"], "n")
    return both.select(F.concat(F.lit(prefix), F.lpad((F.col("n") - 1).cast("string"), 3, "0")).alias("station_id"), "name", "line", "phase", "x", "y", "source", "confidence", "moved_m")


def metro_edges(stations: DataFrame, transfer_m: float = TRANSFER_M) -> DataFrame:
    """The metro as edges ``(src, dst, weight, kind)`` of ``stations (id, x, y, line, name)``.

    'track' joins consecutive stations of a line, 'same name' the stations of one name (weight 1), 'transfer' the closest two stations of each two
    lines, if they are at most ``transfer_m`` apart (weight at least 1 m). Lines of one station have none of these but the second.
    Where no station has a line, 'forest' is a minimum spanning tree of the places; it is taken among pairs ever farther apart until one tree
    is left. Of two edges between the same stations the one named first counts.
    """
    s = cut(stations.where("id is not null and x is not null and y is not null").select("id", "x", "y", "line", "name"), "stations")
    lined = s.where("line is not null")
    if lined.isEmpty():
        return _spanning(s).withColumn("kind", F.lit("forest"))
    served = lined.join(lined.groupBy("line").count().where("count > 1").select("line"), "line", "left_semi")
    track = G.consecutive(G.ordered_along(served, "line"), served, "line").withColumn("kind", F.lit("track"))
    same = N.same_name_links(lined).withColumn("kind", F.lit("same name"))
    change = G.closest_between_groups(served, "line", transfer_m).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.greatest("distance", F.lit(1.0)).alias("weight"), F.lit("transfer").alias("kind"))
    rank = F.array_position(F.array(F.lit("track"), F.lit("same name"), F.lit("transfer")), F.col("kind"))
    both = track.unionByName(same).unionByName(change).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "kind")
    return both.groupBy("src", "dst").agg(F.min_by(F.struct("weight", "kind"), F.struct(rank, "weight")).alias("e")).select("src", "dst", "e.*")


def _spanning(places: DataFrame) -> DataFrame:
    n, box = places.count(), places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if n < 2:
        return places.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")).limit(0)
    radius = max(1.0, max(box) / n**0.5)
    while True:  # an edge of the whole tree is never longer than the least radius that connects all
        pairs = G.near(places, places, radius).where("a_id < b_id").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), F.col("distance").alias("weight"))
        tree = cut(N.spanning_forest(pairs), "tree")
        if tree.count() == n - 1 or radius > 2 * max(*box, 1.0):
            return tree
        radius *= 2


def network_position(stations: DataFrame, transfer_m: float = TRANSFER_M) -> DataFrame:
    """``(id, metro_degree, metro_betweenness, metro_closeness, is_interchange, is_terminal, component)`` of each station with a place, on the metro of
    ``metro_edges``. Stations without an edge have degree 0 and null centralities."""
    e = cut(metro_edges(stations, transfer_m), "metro")
    ids = stations.where("id is not null and x is not null and y is not null").select("id").distinct()
    c = N.centrality(e).select("id", F.col("betweenness").alias("metro_betweenness"), F.col("closeness").alias("metro_closeness"))
    out = N.degree(e, ids, directed=False).join(c, "id", "left").join(N.components(e, ids), "id")
    d = F.col("degree")
    return out.select("id", d.alias("metro_degree"), "metro_betweenness", "metro_closeness", (d > 2).cast("int").alias("is_interchange"), (d == 1).cast("int").alias("is_terminal"), "component")
