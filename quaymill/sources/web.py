"""Answers of web services, already fetched: JSON to rows, HTML tables, tiles and caches. Fetching is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW = "array<struct<line:string,series:array<struct<name:string,data:array<bigint>>>>>"
HOURLY = "struct<series:array<struct<name:string,data:array<bigint>>>>"


def station_flow(df: DataFrame, body: str, labels: dict[str, list[str]], *keys: str) -> DataFrame:
    """``(keys, line, name, boardings)`` from the positional arrays of each line; a line whose array doesn't fit its labels is an error."""
    lines = df.select(*keys, F.explode(F.from_json(body, FLOW)).alias("l")).select(*keys, F.col("l.line").alias("line"), F.col("l.series")[0]["data"].alias("data"))
    names = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    lines = lines.withColumn("names", names[F.col("line")])
    fits = F.assert_true(F.coalesce(F.size("names") == F.size("data"), F.lit(False)), F.concat(F.lit("labels don't fit line "), F.coalesce("line", F.lit("?"))))
    zipped = F.when(fits.isNull(), F.arrays_zip("names", "data"))
    return lines.select(*keys, "line", F.explode(zipped).alias("z")).select(*keys, "line", F.col("z.names").alias("name"), F.col("z.data").alias("boardings"))


def hourly(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """``(keys, hour, boardings)``: the place in the array is the hour."""
    return df.select(*keys, F.posexplode(F.from_json(body, HOURLY)["series"][0]["data"]).alias("hour", "boardings"))


def ticket_mix(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """``(keys, medium, count)`` of a flat object of numbers, zeros left out. Totals stand beside their parts: never add them all up."""
    m = df.select(*keys, F.explode(F.from_json(body, "map<string,double>")).alias("medium", "count"))
    words = F.regexp_replace(F.regexp_replace("medium", "^noOf", ""), "([a-z])([A-Z])", "$1 $2")
    return m.where("count > 0").withColumn("medium", words)


def map_elements(df: DataFrame, body: str) -> DataFrame:
    """``(id, kind, lat, lon, tags)`` of a map query's answers, each element once however many tiles gave it; ways and relations at their centre."""
    point = "lat:double,lon:double"
    e = df.select(F.explode(F.from_json(body, f"struct<elements:array<struct<type:string,id:bigint,{point},center:struct<{point}>,geometry:array<struct<{point}>>,tags:map<string,string>>>>")["elements"]).alias("e")).select("e.*")
    mean = lambda c: F.aggregate(F.transform("geometry", lambda p: p[c]), F.lit(0.0), lambda s, x: s + x) / F.size("geometry")
    at = lambda c: F.coalesce(F.col(c), F.col("center")[c], F.when(F.size("geometry") > 0, mean(c)))
    return e.select("id", F.col("type").alias("kind"), at("lat").alias("lat"), at("lon").alias("lon"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags")).dropDuplicates(["kind", "id"])


def tiles(south: float, west: float, north: float, east: float, rows: int = 3, cols: int = 4, overlap: float = 0.0) -> list[tuple[float, float, float, float]]:
    """A bounding box in parts, each larger by ``overlap`` on all sides."""
    h, w = (north - south) / rows, (east - west) / cols
    return [(south + r * h - overlap, west + c * w - overlap, south + (r + 1) * h + overlap, west + (c + 1) * w + overlap) for r in range(rows) for c in range(cols)]


def raster_tiles(corners: list[tuple[float, float]], x0: float, y0: float, size: float) -> set[tuple[int, int]]:
    """1-based (row, column) of the tiles of ``size`` from the upper left ``(x0, y0)`` that a box's projected corners span."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    cols = range(math.floor((min(xs) - x0) / size) + 1, math.floor((max(xs) - x0) / size) + 2)
    rows = range(math.floor((y0 - max(ys)) / size) + 1, math.floor((y0 - min(ys)) / size) + 2)
    return {(r, c) for r in rows for c in cols}


def from_mirrors(ask: Callable[[str], object], mirrors: list[str], attempts: int = 2) -> object:
    """The first answer of any mirror, an empty one too; raises only if all attempts failed."""
    last: Exception | None = None
    for _ in range(attempts):
        for m in mirrors:
            try:
                return ask(m)
            except Exception as e:  # noqa: BLE001
                last = e
    raise RuntimeError(f"no mirror answered in {attempts} attempts") from last


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append([r for r in self.open.pop() if r])

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(page: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(page)
    return p.tables


def table_with(spark: SparkSession, page: str, words: tuple[str, ...], least: int = 2) -> DataFrame | None:
    """The longest table of a page whose header has all the words, at least ``least`` rows, as texts; None if there is none."""
    fit = [t for t in html_tables(page) if len(t) > least and all(any(w.lower() in h.lower() for h in t[0]) for w in words)]
    if not fit:
        return None
    t = max(fit, key=len)
    head = [h or f"column_{i}" for i, h in enumerate(t[0])]
    head = [h if head.index(h) == i else f"{h}_{i}" for i, h in enumerate(head)]
    return spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for r in t[1:]], ", ".join(f"`{h.replace('`', '')}` string" for h in head))


def looked_up(names: DataFrame, name: str, cache: DataFrame, ask: Callable[[list[str]], dict[str, tuple[float, float] | None]], batch: int = 40) -> tuple[DataFrame, DataFrame]:
    """All places of ``names`` and the rows to append to ``cache (name, lat, lon)``.

    Only names not in the cache are asked, ``batch`` at a time; a null place is a known miss and isn't asked again. Names
    that ``ask`` leaves out, as after a failure, stay out of the cache and are asked next time.
    """
    asked = names.select(F.col(name).alias("name")).where("name is not null").distinct().join(cache, "name", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                got = ask(b["name"].iloc[i : i + batch].tolist())
                yield pd.DataFrame([(k, *(v or (None, None))) for k, v in got.items()], columns=["name", "lat", "lon"]).astype({"lat": "float64", "lon": "float64"})

    fresh = asked.mapInPandas(run, "name string, lat double, lon double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("lat", "lon")})
    from quaymill.session import cut

    fresh = cut(fresh, "looked-up")
    return names.select(F.col(name).alias("name")).distinct().join(cache.unionByName(fresh), "name", "left"), fresh


#: Networks and operators that run a metro, and the words that a tag of each lifecycle stage may hold.
METRO_WORDS = ["metro", "cmrl", "bmrcl"]
STOPPING_PLACES = ["station", "halt"]
UNFINISHED = ["construction", "proposed"]
BEING_BUILT = ["station", "subway", "light_rail"]


def station_class(tags: Column) -> Column:
    """What a railway element is, by its tags: metro_construction, other_construction, metro_operational, other_rail or other.

    A stage of planning or building comes first; a stage that is named by a railway tag of its own counts as metro.
    Values compare without case; a tag that is missing or empty says nothing.
    """
    tag = lambda key: F.lower(F.coalesce(tags[key], F.lit("")))
    named = F.concat_ws(" ", tag("name"), tag("name:en")).contains("metro")
    run_by = F.concat_ws(" ", tag("network"), tag("operator"))
    metro = (tag("station") == "subway") | (tag("subway") == "yes") | named
    for word in METRO_WORDS:
        metro |= run_by.contains(word)
    to_be_built, planned = tag("construction:railway"), tag("proposed:railway")
    unfinished = tag("railway").isin(*UNFINISHED) | to_be_built.isin(*STOPPING_PLACES) | planned.isin(*STOPPING_PLACES) | tag("construction").isin(*BEING_BUILT)
    of_metro = metro | (to_be_built != "") | (planned != "")
    built = F.when(metro, "metro_operational").when(tag("railway").isin(*STOPPING_PLACES), "other_rail").otherwise("other")
    return F.when(unfinished & of_metro, "metro_construction").when(unfinished, "other_construction").otherwise(built)


#: The lines that carry a line's whole name, and those named by a part of it.
LINE_NAMES = {
    "Chennai Metro Line 1": ("phase1", "Blue Line"),
    "Chennai Metro Line 2": ("phase1", "Green Line"),
}
LINE_PARTS = {
    "Line 3:": ("phase2", "Purple Line"),
    "Line 5:": ("phase2", "Red Line"),
    "Yellow Line": ("phase2", "Yellow Line"),
}
#: Parts of names that rule an alignment out; the first whatever its case.
NO_ALIGNMENT = ["proposed", "Line 5B", "corridor switch"]


def alignment_class(name: Column) -> Column:
    """``struct<phase, line>`` of an alignment's name; null for what is no line of the network."""
    out = F.lit(None)
    for part, (phase, line) in reversed(LINE_PARTS.items()):
        out = F.when(name.contains(part), F.struct(F.lit(phase).alias("phase"), F.lit(line).alias("line"))).otherwise(out)
    for whole, (phase, line) in LINE_NAMES.items():
        out = F.when(name == whole, F.struct(F.lit(phase).alias("phase"), F.lit(line).alias("line"))).otherwise(out)
    first, *others = NO_ALIGNMENT
    ruled_out = F.lower(name).contains(first)
    for part in others:
        ruled_out |= name.contains(part)
    return F.when(~F.coalesce(ruled_out, F.lit(True)), out)


def composed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One street graph from the answers of overlapping tiles: ``nodes (tile, id, x, y)`` by id, ``edges (tile, src, dst, length)`` by both ends
    and length. A node or edge of several tiles counts once, as its first tile by name gives it; edges whose ends are in no tile stay out."""
    one = nodes.where("id is not null").groupBy("id").agg(F.min_by(F.struct("x", "y"), "tile").alias("p")).select("id", "p.x", "p.y")
    ways = edges.where("src is not null and dst is not null").select("src", "dst", "length").distinct()
    ids = one.select("id")
    return one, ways.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "length")
