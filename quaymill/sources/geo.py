"""Geographic files to rows, with the standard library: GeoPackage, Shapefile, GeoTIFF, GraphML, OSM extracts."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.operators.geometry import ring_area, ring_centroid, utm
from quaymill.session import cut

SHAPE = "kind string, parts array<array<struct<x:double,y:double>>>"


def _each_file(spark: SparkSession, path: str, read: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Files of ``path`` read in parallel, each whole, by ``read`` into rows."""
    names = [c.strip().split(" ")[0] for c in _top_level(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                for r in read(p, c):
                    rows.append(r)
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _top_level(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def wkb(raw: bytes) -> tuple[str, list[list[dict]]]:
    """Kind and parts of a well-known-binary geometry; a polygon's parts are its rings, heights are dropped."""
    pos = 0

    def take(fmt: str) -> tuple:
        nonlocal pos
        out = struct.unpack_from(fmt, raw, pos)
        pos += struct.calcsize(fmt)
        return out

    def one() -> tuple[str, list[list[dict]]]:
        e = "<" if take("B")[0] else ">"
        code = take(e + "I")[0]
        if code & 0x20000000:
            take(e + "I")
        dims = 2 + bool(code & 0x80000000 or (code & 0xFFFF) // 1000 in (1, 3)) + bool(code & 0x40000000 or (code & 0xFFFF) // 1000 in (2, 3))
        code = (code & 0xFFFF) % 1000

        def points(n: int) -> list[dict]:
            v = take(f"{e}{n * dims}d")
            return [{"x": v[i * dims], "y": v[i * dims + 1]} for i in range(n)]

        if code == 1:
            return "point", [points(1)]
        if code == 2:
            return "line", [points(take(e + "I")[0])]
        if code == 3:
            return "polygon", [points(take(e + "I")[0]) for _ in range(take(e + "I")[0])]
        inner = [one() for _ in range(take(e + "I")[0])]
        return {4: "multipoint", 5: "multiline", 6: "multipolygon"}.get(code, "collection"), [p for _, ps in inner for p in ps]

    return one()


def geopackage(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """``(file, fid, tags map, kind, parts)`` of a layer; attributes as texts."""

    def read(name: str, raw: bytes) -> Iterator[tuple]:
        db = sqlite3.connect(":memory:")
        db.deserialize(raw)
        geom = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
        cur = db.execute(f'select rowid, * from "{layer.replace(chr(34), "")}"')
        cols = [c[0] for c in cur.description][1:]
        for fid, *row in cur:
            at = dict(zip(cols, row))
            g = at.pop(geom[0], None) if geom else None
            kind, parts = (None, None)
            if g:
                flags = g[3]
                kind, parts = wkb(g[8 + (0, 32, 48, 48, 64)[flags >> 1 & 7] :])
            yield name, fid, {k: str(v) for k, v in at.items() if v is not None}, kind, parts

    return _each_file(spark, path, read, "file string, fid bigint, tags map<string,string>, " + SHAPE)


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """``(file, fid, kind, parts)`` of .shp files: points, lines and polygons."""

    def read(name: str, raw: bytes) -> Iterator[tuple]:
        at, fid = 100, 0
        while at + 8 <= len(raw):
            length = struct.unpack_from(">i", raw, at + 4)[0] * 2
            b = at + 8
            code = struct.unpack_from("<i", raw, b)[0] % 10
            if code == 1:
                x, y = struct.unpack_from("<2d", raw, b + 4)
                yield name, fid, "point", [[{"x": x, "y": y}]]
            elif code in (3, 5):
                n, m = struct.unpack_from("<2i", raw, b + 36)
                starts = [*struct.unpack_from(f"<{n}i", raw, b + 44), m]
                xy = struct.unpack_from(f"<{2 * m}d", raw, b + 44 + 4 * n)
                parts = [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(s, e)] for s, e in zip(starts, starts[1:])]
                yield name, fid, "line" if code == 3 else "polygon", parts
            else:
                yield name, fid, None, None
            at, fid = b + length, fid + 1

    return _each_file(spark, path, read, "file string, fid bigint, " + SHAPE)


def dbase(spark: SparkSession, path: str) -> DataFrame:
    """``(file, fid, tags map)`` of the .dbf beside a shapefile."""

    def read(name: str, raw: bytes) -> Iterator[tuple]:
        n, head, size = struct.unpack_from("<IHH", raw, 4)
        fields, at = [], 32
        while raw[at] != 13:
            fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
            at += 32
        for i in range(n):
            p, tags = head + i * size + 1, {}
            for f, w in fields:
                v = raw[p : p + w]
                try:
                    t = v.decode("utf-8").strip()
                except UnicodeDecodeError:
                    t = v.decode("latin-1").strip()
                if t:
                    tags[f] = t
                p += w
            yield name, i, tags

    return _each_file(spark, path, read, "file string, fid bigint, tags map<string,string>")


def layers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Shapefiles of several vintages as one table with the ``vintage``; vintages without a file are passed over."""
    out: DataFrame | None = None
    for vintage, path in paths.items():
        try:
            one = shapefile(spark, path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        one = one.withColumn("vintage", F.lit(vintage))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise FileNotFoundError(", ".join(paths.values()))
    return out


def _lzw(data: bytes) -> bytes:
    table, out, prev = [bytes([i]) for i in range(256)] + [b"", b""], [], b""
    width, bits, have, pos = 9, 0, 0, 0
    while True:
        while have < width and pos < len(data):
            bits, have, pos = bits << 8 | data[pos], have + 8, pos + 1
        if have < width:
            break
        code = bits >> (have - width) & ((1 << width) - 1)
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, prev = 9, b""
            continue
        entry = table[code] if code < len(table) else prev + prev[:1]
        out.append(entry)
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def tiff_grid(raw: bytes) -> tuple[np.ndarray, float, float, float, float, float | None]:
    """First band, upper left x and y, cell width and height, no-data value of a TIFF in strips or tiles, plain, deflated or LZW."""
    e = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", raw, 4)[0]
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
    tag = {}
    for i in range(struct.unpack_from(e + "H", raw, at)[0]):
        t, k, n = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * i)
        if k in kinds:
            size = struct.calcsize(kinds[k]) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(e + "I", raw, at + 10 + 12 * i)[0]
            tag[t] = raw[where : where + n] if k == 2 else struct.unpack_from(f"{e}{n}{kinds[k]}", raw, where)
    w, h = tag[256][0], tag[257][0]
    form = {1: "u", 2: "i", 3: "f"}[tag.get(339, (1,))[0]]
    dtype = np.dtype(f"{e}{form}{tag.get(258, (8,))[0] // 8}")
    bands, code, ahead = tag.get(277, (1,))[0], tag.get(259, (1,))[0], tag.get(317, (1,))[0]
    tw, th = (tag[322][0], tag[323][0]) if 322 in tag else (w, tag.get(278, (h,))[0])
    grid = np.zeros((h, w), dtype.newbyteorder("="))
    across = -(-w // tw)
    for i, (o, n) in enumerate(zip(tag.get(324, tag.get(273)), tag.get(325, tag.get(279)))):
        block = raw[o : o + n]
        block = zlib.decompress(block) if code in (8, 32946) else _lzw(block) if code == 5 else block
        if code not in (1, 5, 8, 32946):
            raise ValueError(f"TIFF compression {code}")
        r, c = i // across * th, i % across * tw
        rows = th if 322 in tag else min(th, h - r)
        a = np.frombuffer(block, dtype, rows * tw * bands).reshape(rows, tw, bands)[:, :, 0]
        if ahead == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        grid[r : r + rows, c : c + tw] = a[: h - r, : w - c]
    sx, sy = tag.get(33550, (1.0, 1.0))[:2]
    tie = tag.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    none = tag.get(42113)
    return grid, tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy, float(none.strip(b"\0 ")) if none else None


def geotiff_cells(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, col, x, y, value)`` of all cells with a value, x and y at the cell's centre."""

    def read(name: str, raw: bytes) -> Iterator[tuple]:
        grid, x0, y0, sx, sy, none = tiff_grid(raw)
        keep = ~np.isnan(grid.astype(float)) if none is None else (grid != none) & ~np.isnan(grid.astype(float))
        for r, c in np.argwhere(keep).tolist():
            yield name, r, c, x0 + (c + 0.5) * sx, y0 - (r + 0.5) * sy, float(grid[r, c])

    return _each_file(spark, path, read, "file string, row bigint, col bigint, x double, y double, value double")


def of_epoch(cells: DataFrame, epoch: str | None) -> DataFrame:
    """Cells of the files named for exactly this epoch."""
    return cells if epoch is None else cells.where(F.regexp_extract("file", r"[^/]*$", 0).rlike(rf"(?<![0-9A-Za-z]){epoch}(?![0-9A-Za-z])"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes (id, x, y)`` and ``edges (src, dst, length)`` of a street graph; a node or edge that several files have counts once."""
    keys = spark.read.format("xml").option("rowTag", "key").load(path)
    named = {r["_attr.name"]: r["_id"] for r in keys.select("`_attr.name`", "_id").distinct().collect()}  # a file's declarations
    data = "data array<struct<_key:string,_VALUE:string>>"
    value = lambda k: F.filter("data", lambda d: d["_key"] == named.get(k, ""))[0]["_VALUE"].cast("double")
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    n = nodes.select(F.col("_id").alias("id"), value("x").alias("x"), value("y").alias("y")).groupBy("id").agg(F.first("x", True).alias("x"), F.first("y", True).alias("y"))
    return n, edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("length").alias("length")).distinct()


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers, or bytes."""
    at, end = 0, len(raw)
    while at < end:
        key, at = _varint(raw, at)
        if key & 7 == 0:
            v, at = _varint(raw, at)
        elif key & 7 == 2:
            n, at = _varint(raw, at)
            v, at = raw[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            v, at = raw[at : at + n], at + n
        yield key >> 3, v


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _packed(raw: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = _varint(raw, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


_SIGN = lambda v: (v >> 1) ^ -(v & 1)
_MEMBERS = ("node", "way", "relation")
_ELEMENT = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<kind:string,ref:bigint,role:string>>"


def _blobs(raw: bytes) -> Iterator[bytes]:
    """The data blobs of an extract, still compressed."""
    at = 0
    while at < len(raw):
        n = struct.unpack_from(">I", raw, at)[0]
        head = dict(_fields(raw[at + 4 : at + 4 + n]))
        at += 4 + n
        if head[1] == b"OSMData":
            yield raw[at : at + head[3]]
        at += head[3]


def _elements(packed: bytes, kinds: tuple[str, ...], tagged: bool, box: tuple[float, float, float, float] | None) -> Iterator[tuple]:
    """Rows of one blob. Nodes are tested for tags and place before a row is made."""
    blob = dict(_fields(packed))
    block = blob[1] if 1 in blob else zlib.decompress(blob[3])
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in _fields(block):
        if k == 1:
            strings = [s for _, s in _fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    text = lambda i: strings[i].decode("utf-8", "replace")
    tags_of = lambda f: {text(a): text(b) for a, b in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")))}

    def node(i: int, a: int, b: int, tags: dict) -> Iterator[tuple]:
        lat, lon = (lat0 + grain * a) * 1e-9, (lon0 + grain * b) * 1e-9
        if (tags or not tagged) and (box is None or (box[0] <= lat <= box[2] and box[1] <= lon <= box[3])):
            yield "node", i, lat, lon, tags, None, None

    for g in groups:
        for k, v in _fields(g):
            if k == 1 and "node" in kinds:
                f: dict = dict(_fields(v))
                yield from node(_SIGN(f[1]), _SIGN(f[8]), _SIGN(f[9]), tags_of(f))
            elif k == 2 and "node" in kinds:
                f = {10: b""} | dict(_fields(v))
                ids, lats, lons = (np.cumsum(_packed(f[i], True)).tolist() for i in (1, 8, 9))
                kv, p = _packed(f[10]), 0
                for i, a, b in zip(ids, lats, lons):
                    tags = {}
                    while p < len(kv) and kv[p]:
                        tags[text(kv[p])] = text(kv[p + 1])
                        p += 2
                    p += 1
                    yield from node(i, a, b, tags)
            elif k == 3 and "way" in kinds:
                f = dict(_fields(v))
                yield "way", f[1], None, None, tags_of(f), np.cumsum(_packed(f.get(8, b""), True)).tolist(), None
            elif k == 4 and "relation" in kinds:
                f = dict(_fields(v))
                refs = np.cumsum(_packed(f.get(9, b""), True)).tolist()
                of = [{"kind": _MEMBERS[t], "ref": r, "role": text(w)} for t, r, w in zip(_packed(f.get(10, b"")), refs, _packed(f.get(8, b"")))]
                yield "relation", f[1], None, None, tags_of(f), None, of


def osm_elements(spark: SparkSession, path: str, kinds: tuple[str, ...] = _MEMBERS, tagged: bool = False, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(kind, id, lat, lon, tags, refs, members)`` of .pbf extracts: nodes (with tags only if ``tagged``, inside ``box`` south, west,
    north, east), ways with the ids of their nodes, relations with their members. Files are cut into blobs, which are decoded in as many
    tasks as the session has partitions."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["content"]:
                for blob in _blobs(c):
                    yield pd.DataFrame({"blob": [blob]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in map(str.strip, _top_level(_ELEMENT))]
        for b in batches:
            for blob in b["blob"]:
                yield pd.DataFrame(list(_elements(blob, kinds, tagged, box)), columns=names)

    blobs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, "blob binary")
    return blobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(decode, _ELEMENT)


def osm_nodes(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, tagged: bool = True) -> DataFrame:
    """``(id, lat, lon, tags)`` of the nodes of .pbf extracts, inside ``box`` (south, west, north, east), only those with tags if ``tagged``."""
    return osm_elements(spark, path, ("node",), tagged, box).select("id", "lat", "lon", "tags")


def osm_lines(spark: SparkSession, path: str, wanted: Callable[[Column], Column], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(id, tags, points array<struct<x,y>>, closed)`` of the ways whose tags are ``wanted``, x the longitude, in the order of
    their nodes; with ``box`` those that have a node in it, whole. Nodes that the extract lacks are passed over."""
    ways = cut(osm_elements(spark, path, ("way",)).where(wanted(F.col("tags"))).groupBy("id").agg(F.first(F.struct("tags", "refs")).alias("w")).select("id", "w.*"), "ways")
    places = osm_elements(spark, path, ("node",)).groupBy(F.col("id").alias("ref")).agg(F.first(F.struct("lat", "lon")).alias("p")).select("ref", "p.*")
    spots = ways.select("id", F.posexplode("refs").alias("pos", "ref")).join(places, "ref")
    inside = F.lit(True) if box is None else F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("x"), s["lat"].alias("y")))  # a way's nodes
    lines = spots.groupBy("id").agg(points.alias("points"), F.bool_or(inside).alias("in")).where("in")
    refs = F.col("refs")
    return ways.join(lines, "id").select("id", "tags", "points", ((F.size(refs) > 3) & (F.element_at(refs, 1) == F.element_at(refs, -1))).alias("closed"))


def _rings(pieces: list[list[tuple]]) -> list[list[tuple]]:
    """Closed rings from pieces of boundary, joined end to end in either direction; pieces that close nothing are left out."""
    loose, out = [list(p) for p in pieces if len(p) > 1], []
    while loose:
        ring = loose.pop()
        while ring[0] != ring[-1]:
            fit = next((i for i, p in enumerate(loose) if ring[-1] in (p[0], p[-1])), None)
            if fit is None:
                break
            p = loose.pop(fit)
            ring += p[1:] if p[0] == ring[-1] else p[-2::-1]
        if ring[0] == ring[-1] and len(ring) > 3:
            out.append(ring)
    return out


def osm_areas(spark: SparkSession, path: str, wanted: Callable[[Column], Column], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(kind, id, tags, ring, hole, points)``: closed ways, and the rings of multipolygon relations, whose tags are ``wanted``; ``hole`` marks
    inner rings. A way that is a boundary of a wanted relation and has wanted tags itself gives both."""
    own = osm_lines(spark, path, wanted, box).where("closed").select(F.lit("way").alias("kind"), "id", "tags", F.lit(0).alias("ring"), F.lit(False).alias("hole"), "points")
    rel = cut(osm_elements(spark, path, ("relation",)).where(wanted(F.col("tags")) & F.coalesce(F.col("tags")["type"].isin("multipolygon", "boundary"), F.lit(False))).select("id", "tags", "members"), "relations")
    member = cut(rel.select("id", F.explode("members").alias("m")).where("m.kind = 'way'").select("id", F.col("m.ref").alias("ref"), (F.col("m.role") == "inner").alias("hole")), "members")
    asked = member.select("ref").distinct()
    ways = osm_elements(spark, path, ("way",)).select(F.col("id").alias("ref"), "refs").join(asked, "ref", "left_semi").dropDuplicates(["ref"])
    places = osm_elements(spark, path, ("node",)).select(F.col("id").alias("node"), "lat", "lon").dropDuplicates(["node"])
    spots = ways.select("ref", F.posexplode("refs").alias("pos", "node")).join(places, "node")
    pieces = member.join(spots.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")), "ref")

    def assemble(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for hole in (False, True):
            for ring in _rings([[(s["lon"], s["lat"]) for s in p] for p, h in zip(g["p"], g["hole"]) if h == hole]):
                out.append((g["id"].iloc[0], len(out), hole, [{"x": x, "y": y} for x, y in ring]))
        return pd.DataFrame(out, columns=["id", "ring", "hole", "points"])

    rings = pieces.select("id", "hole", "p").groupBy("id").applyInPandas(assemble, "id bigint, ring int, hole boolean, points array<struct<x:double,y:double>>")
    whole = rings.join(rel.select("id", "tags"), "id").select(F.lit("relation").alias("kind"), "id", "tags", "ring", "hole", "points")
    if box is not None:
        whole = whole.where(F.exists("points", lambda p: p["y"].between(box[0], box[2]) & p["x"].between(box[1], box[3])))
    return own.unionByName(whole)


def has_tags(wanted: dict[str, bool | str | list[str]]) -> Callable[[Column], Column]:
    """A test of tags: any of the keys is there (True), or has the value, or one of the values. Never null."""

    def test(tags: Column) -> Column:
        out = F.lit(False)
        for k, v in wanted.items():
            value = tags[k]
            out = out | F.coalesce(value.isNotNull() if v is True else value.isin(*([v] if isinstance(v, str) else v)), F.lit(False))
        return out

    return test


def _projected(points: Column, zone: int) -> Column:
    def at(p: Column) -> Column:
        x, y = utm(p["y"], p["x"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, at)


def alignment_layer(spark: SparkSession, path: str, wanted: dict, zone: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(id, name, points, length_km)``: named lines with the ``wanted`` tags, projected."""
    lines = osm_lines(spark, path, has_tags(wanted), box).where(F.col("tags")["name"].isNotNull() & (F.size("points") > 1))
    lines = lines.select("id", F.col("tags")["name"].alias("name"), _projected(F.col("points"), zone).alias("points"))
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.hypot(F.get("points", i)["x"] - F.get("points", i - 1)["x"], F.get("points", i)["y"] - F.get("points", i - 1)["y"]))
    return lines.withColumn("length_km", F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / 1000)


def place_layer(spark: SparkSession, path: str, categories: dict[str, dict], zone: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(kind, id, category, name, tags, x, y, area_m2)``: all nodes and areas that fit a category, once for each that they fit; areas at the centroid of their
    largest outer ring, their area without the holes. Shops, bus stops and parking are such layers."""
    fits = F.filter(F.array(*(F.when(has_tags(w)(F.col("tags")), F.lit(c)) for c, w in categories.items())), lambda c: c.isNotNull())
    any_of = lambda tags: reduce(lambda a, b: a | b, (has_tags(w)(tags) for w in categories.values()))
    x, y = utm(F.col("lat"), F.col("lon"), zone)
    nodes = osm_nodes(spark, path, box).where(any_of(F.col("tags"))).dropDuplicates(["id"]).select(F.lit("node").alias("kind"), "id", "tags", x.alias("x"), y.alias("y"), F.lit(0.0).alias("area_m2"))
    rings = osm_areas(spark, path, any_of, box).select("kind", "id", "tags", "hole", _projected(F.col("points"), zone).alias("points"))
    rings = rings.withColumns({"area": ring_area(F.col("points")), "c": ring_centroid(F.col("points"))})
    sign = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    areas = rings.groupBy("kind", "id").agg(F.first("tags").alias("tags"), F.max_by("c", F.when(~F.col("hole"), F.col("area"))).alias("c"), F.sum(sign).alias("area_m2"))
    both = nodes.unionByName(areas.select("kind", "id", "tags", "c.x", "c.y", "area_m2"))
    return both.select("kind", "id", F.explode(fits).alias("category"), F.col("tags")["name"].alias("name"), "tags", "x", "y", "area_m2")
