"""Sources and sinks: round trips, and files built by hand."""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymill.functions import scalars as X
from quaymill.sources import files, geo, sinks, web


def test_marked_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("01", "Gu,indy \"x\""), ("1", "கிண்டி")], "line string, name string")
    path = str(tmp_path / "a.csv")
    assert sinks.csv_with_mark(df, path) and open(path, "rb").read(3) == b"\xef\xbb\xbf"
    assert rows(files.csv_table(spark, path, "line string, name string").select("line")) == [("01",), ("1",)]
    assert sorted(r["cells"]["name"] for r in files.any_table(spark, path).collect()) == sorted(r["name"] for r in df.collect())
    assert not sinks.csv_with_mark(df.limit(0), str(tmp_path / "b.csv")) and not (tmp_path / "b.csv").exists()


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("Station;Boardings\nCafé;1.200\n".encode(encoding))
    assert files.any_table(spark, str(tmp_path)).first()["cells"] == {"Station": "Café", "Boardings": "1.200"}


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 1, 2.5), (None, 3, None)], "name string, n int, v double")
    sinks.write_workbook({"first": df, "second": df.limit(0)}, str(tmp_path / "a.xlsx"))
    got = files.workbook_rows((tmp_path / "a.xlsx").read_bytes())
    assert got == [["name", "n", "v"], ["a & b", "1", "2.5"], [None, "3"]]


def test_newest_and_free_form(spark, tmp_path, rows):
    import os

    (tmp_path / "old.csv").write_text("x\n1\n")
    (tmp_path / "new.csv").write_text('Station Name,Monthly Ridership,Note\nGuindy,"3,04,000",x\nGuindy,"3,04,000",\nEgmore,60800,\n,5,\nAlandur,none,\n')
    (tmp_path / "~$new.csv").write_text("lock")
    os.utime(tmp_path / "old.csv", (1, 1))
    path = files.newest(spark, str(tmp_path))
    assert path.endswith("new.csv") and "~$" not in path
    assert rows(files.free_form_target(spark, path)) == [("Egmore", 2000.0, None), ("Guindy", 10000.0, None)]


def test_monthly_totals_and_listed(spark, rows):
    df = spark.createDataFrame([("Apr-23", "1,04,68,732"), ("x", "5"), ("May-23", "n"), ("Feb-24", "29")], "m string, t string")
    assert [(str(r[0]), r[1], r[2]) for r in rows(files.monthly_totals(df, "m", "t"))] == [("2023-04-01", 10468732.0, 30), ("2024-02-01", 29.0, 29)]
    wiki = spark.createDataFrame([("Name",), ("Guindy†*",), ("Egmore[2]",), (None,), (" ",)], "Name string")
    assert sorted(r["name"] for r in files.listed(wiki, "Name").collect()) == ["Egmore", "Guindy"]


def test_station_flow(spark, rows):
    body = json.dumps([{"line": "01", "series": [{"name": "x", "data": [5, 7]}]}, {"line": "02", "series": [{"name": "x", "data": [9]}]}])
    df = spark.createDataFrame([("d1", body)], "day string, body string")
    labels = {"01": ["A", "B"], "02": ["C"]}
    assert rows(web.station_flow(df, "body", labels, "day")) == [("d1", "01", "A", 5), ("d1", "01", "B", 7), ("d1", "02", "C", 9)]
    with pytest.raises(Exception, match="labels don't fit"):
        web.station_flow(df, "body", labels | {"02": ["C", "D"]}, "day").collect()
    one = spark.createDataFrame([('{"series":[{"name":"h","data":[3,null,5]}]}', '{"noOfCashTickets": 4, "Total_QR": 0, "noOfQRTickets": 2.0}')], "h string, t string")
    assert rows(web.hourly(one, "h")) == [(0, 3), (1, None), (2, 5)]
    assert rows(web.ticket_mix(one, "t")) == [("Cash Tickets", 4.0), ("QRTickets", 2.0)]


def test_map_elements_once(spark, rows):
    body = json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"railway": "station", "station": "subway"}}, {"type": "way", "id": 1, "geometry": [{"lat": 0, "lon": 0}, {"lat": 2, "lon": 4}]}]})
    got = web.map_elements(spark.createDataFrame([(body,), (body,), ('{"elements": []}',)], "b string"), "b")
    assert rows(got.select("kind", "lat", "lon", web.station_class(F.col("tags")))) == [("node", 1.0, 2.0, "metro_operational"), ("way", 1.0, 2.0, "other")]


@pytest.mark.parametrize("tags,kind", [
    ({"railway": "construction", "network": "City Metro"}, "metro_construction"), ({"railway": "construction"}, "other_construction"), ({"railway": "proposed"}, "other_construction"), ({"railway": "halt"}, "other_rail"), ({}, "other"),
    ({"subway": "yes"}, "metro_operational"), ({"proposed:railway": "station"}, "metro_construction"), ({"construction:railway": "Halt"}, "metro_construction"), ({"construction:railway": "rail", "railway": "construction"}, "metro_construction"),
    ({"construction": "light_rail"}, "other_construction"), ({"construction": "tower"}, "other"), ({"railway": "rail"}, "other"), ({"railway": "station", "network": "CMRL"}, "metro_operational"), ({"railway": "station", "operator": "bmrcl"}, "metro_operational"),
    ({"railway": "station", "name:en": "Guindy METRO"}, "metro_operational"), ({"public_transport": "station"}, "other"), ({"station": "subway", "railway": "construction"}, "metro_construction"), (None, "other"),
])
def test_station_class(spark, tags, kind):
    assert spark.createDataFrame([(tags,)], "t map<string,string>").select(web.station_class(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize("name,want", [
    ("Chennai Metro Line 1", ("phase1", "Blue Line")), ("Line 3: A - B", ("phase2", "Purple Line")), ("Chennai Metro Line 5: C", ("phase2", "Red Line")), ("The Yellow Line (u/c)", ("phase2", "Yellow Line")),
    ("Line 3: Proposed", None), ("Line 5B: Line 5:", None), ("Yellow Line corridor switch", None), ("yellow line", None), ("", None), (None, None),
])
def test_alignment_class(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(web.alignment_class(F.col("n")).alias("c")).first()["c"]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text,group", [
    ("Built up, Urban", "Built-up"), ("Agriculture, Plantation", "Agriculture"), ("FALLOW land", "Agriculture"), ("Forest, Scrub Forest", "Forest/Scrub"), ("Wasteland, Scrub land", "Forest/Scrub"), ("Inland Wetland", "Water/Wetland"),
    ("Salt pan, lake", "Water/Wetland"), ("Wasteland, Sandy area", "Barren/Open"), ("snow", None), ("", None), (None, None),
])
def test_land_use(spark, text, group):
    from quaymill.functions.scalars import land_use

    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(land_use(F.col("t")), land_use(F.col("t"), open_by_default=True)).first()) == (group or "Other", group or "Barren/Open")


def test_tiles_of_a_street_graph(spark, rows):
    nodes = spark.createDataFrame([("t1", 1, 0.0, 0.0), ("t1", 2, 1.0, 0.0), ("t2", 2, 1.0, 0.0), ("t2", 3, 2.0, 0.0), ("t2", None, 0.0, 0.0)], "tile string, id int, x double, y double")
    edges = spark.createDataFrame([("t1", 1, 2, 5.0), ("t2", 2, 3, 6.0), ("t2", 1, 2, 5.0), ("t1", 2, 1, 5.0), ("t1", 2, 9, 5.0)], "tile string, src int, dst int, length double")
    n, e = web.composed(nodes, edges)
    assert rows(n) == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)] and rows(e) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 6.0)]


def test_tiles_mirrors_and_html(spark, rows):
    assert len(web.tiles(0, 0, 3, 4)) == 12 and web.tiles(0, 0, 3, 4, overlap=0.5)[0] == (-0.5, -0.5, 1.5, 1.5)
    assert web.raster_tiles([(5.0, 95.0), (15.0, 85.0)], 0.0, 100.0, 10.0) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    asked = []

    def ask(m):
        asked.append(m)
        if m != "c":
            raise OSError
        return []

    assert web.from_mirrors(ask, ["a", "b", "c"]) == [] and asked == ["a", "b", "c"]
    with pytest.raises(RuntimeError):
        web.from_mirrors(ask, ["a"], 3)
    page = "<table><tr><th>x</th></tr></table><table><tr><th>Station name</th><th>Line</th></tr>" + "".join(f"<tr><td>S<b>{i}</b></td><td>L &amp; M</td></tr>" for i in range(3)) + "</table>"
    assert rows(web.table_with(spark, page, ("station", "line")))[0] == ("S0", "L & M")
    assert web.table_with(spark, page, ("nowhere",)) is None


def test_lookup_cache(spark, rows):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "name string")
    cache = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, None)], "name string, lat double, lon double")
    found, fresh = web.looked_up(names, "name", cache, lambda batch: {n: (3.0, 4.0) if n == "c" else None for n in batch if n != "d"})
    assert rows(fresh) == [("c", 3.0, 4.0)]
    assert {r[0]: r[1] for r in rows(found)} == {"a": 1.0, "b": None, "c": 3.0, "d": None, None: None}


def test_tags(spark):
    df = spark.createDataFrame([('"shop"=>"yes", "name"=>"a \\"b\\", c"',), (None,), ("",), ('"k"=>"1","k"=>"2"',)], "t string")
    assert [r[0] for r in df.select(X.tags_of(F.col("t"))).collect()] == [{"shop": "yes", "name": 'a "b", c'}, {}, {}, {"k": "1"}]


def _wkb_line(*pts):
    return struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)


def test_wkb_and_geopackage(spark, tmp_path):
    assert geo.wkb(struct.pack(">BI2d", 0, 1, 3.0, 4.0)) == ("point", [[{"x": 3.0, "y": 4.0}]])
    assert geo.wkb(struct.pack("<BII", 1, 5, 2) + _wkb_line((0, 0), (1, 1)) + _wkb_line((2, 2), (3, 3)))[0] == "multiline"
    ring = struct.pack("<BIII", 1, 1003, 1, 3) + b"".join(struct.pack("<3d", *p) for p in ((0, 0, 9), (1, 0, 9), (0, 1, 9)))
    assert geo.wkb(ring) == ("polygon", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]])
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("create table st (fid integer primary key, name text, geom blob)")
    db.execute("insert into gpkg_geometry_columns values ('st', 'geom')")
    db.execute("insert into st values (7, 'Guindy', ?)", (b"GP\0\x03" + struct.pack("<i4d", 4326, 0, 1, 0, 1) + _wkb_line((0, 0), (1, 1)),))
    db.execute("insert into st values (8, null, null)")
    db.commit()
    db.close()
    got = sorted((r["fid"], r["tags"].get("name"), r["kind"]) for r in geo.geopackage(spark, str(tmp_path / "a.gpkg"), "st").collect())
    assert got == [(7, "Guindy", "line"), (8, None, None)]


def test_shapefile(spark, tmp_path):
    pts = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, 3, 0) + b"".join(struct.pack("<2d", *p) for p in pts)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(bytes(100) + record + struct.pack(">2i", 2, 2) + struct.pack("<i", 0))
    head = b"\x03" + bytes(3) + struct.pack("<IHH", 1, 65, 11) + bytes(20) + b"DESCR\0\0\0\0\0\0C" + bytes(4) + bytes([10]) + bytes(15) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" Water     ")
    got = geo.shapefile(spark, str(tmp_path / "a.shp")).orderBy("fid").collect()
    assert [(r["kind"], len(r["parts"][0]) if r["parts"] else 0) for r in got] == [("polygon", 3), (None, 0)]
    assert geo.dbase(spark, str(tmp_path / "a.dbf")).first()["tags"] == {"DESCR": "Water"}
    both = geo.layers(spark, {"2006": str(tmp_path / "a.shp"), "2012": str(tmp_path / "none.shp")})
    assert {r["vintage"] for r in both.collect()} == {"2006"}


@pytest.mark.parametrize("code", [1, 8])
def test_geotiff(spark, tmp_path, code):
    grid = np.array([[1.5, -9.0, 3.0], [4.0, 5.0, 6.0]], "<f4")
    strips = [zlib.compress(r.tobytes()) if code == 8 else r.tobytes() for r in grid]
    entries = [(256, 4, [3]), (257, 4, [2]), (258, 3, [32]), (259, 3, [code]), (277, 3, [1]), (278, 4, [1]), (339, 3, [3]), (33550, 12, [100.0, 50.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0]), (42113, 2, b"-9\0\0\0")]
    size = 2 + 12 * (len(entries) + 2) + 4
    data, at, out = b"", 8 + size, []
    starts = []
    for s in strips:
        starts.append(at + len(data))
        data += s
    entries += [(273, 4, starts), (279, 4, [len(s) for s in strips])]
    for t, k, v in sorted(entries, key=lambda x: x[0]):
        raw = v if k == 2 else struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[k]}", *v)
        if len(raw) <= 4:
            out.append(struct.pack("<HHI", t, k, len(v)) + raw.ljust(4, b"\0"))
        else:
            out.append(struct.pack("<HHII", t, k, len(v), at + len(data)))
            data += raw
    (tmp_path / "pop_E2030_x.tif").write_bytes(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(out)) + b"".join(out) + bytes(4) + data)
    cells = geo.geotiff_cells(spark, str(tmp_path))
    got = sorted((r["row"], r["col"], r["x"], r["y"], r["value"]) for r in cells.collect())
    assert got == [(0, 0, 1050.0, 1975.0, 1.5), (0, 2, 1250.0, 1975.0, 3.0), (1, 0, 1050.0, 1925.0, 4.0), (1, 1, 1150.0, 1925.0, 5.0), (1, 2, 1250.0, 1925.0, 6.0)]
    assert geo.of_epoch(cells, "E2030").count() == 5 and geo.of_epoch(cells, "E203").count() == 0


def test_lzw():
    assert geo._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_graphml(spark, tmp_path, rows):
    text = """<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="x" attr.type="string"/><key id="d1" for="node" attr.name="y" attr.type="string"/><key id="d2" for="edge" attr.name="length" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d0">2.5</data><data key="d1">3</data></node><node id="2"><data key="d1">1</data><data key="d0">4</data></node>
<edge source="1" target="2" id="0"><data key="d2">12.5</data><data key="d9">z</data></edge></graph></graphml>"""
    (tmp_path / "a.graphml").write_text(text)
    nodes, edges = geo.graphml(spark, str(tmp_path / "a.graphml"))
    assert rows(nodes) == [("1", 2.5, 3.0), ("2", 4.0, 1.0)] and rows(edges) == [("1", "2", 12.5)]


def _pb(*fields):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in fields)


def test_osm_nodes(spark, tmp_path, rows):
    zz = lambda *v: b"".join(_pb((0, x << 1 if x >= 0 else -x * 2 - 1))[1:] for x in v)
    dense = _pb((1, zz(10, 1, 1)), (8, zz(130000000, 1000000, 500000000)), (9, zz(800000000, 2000000, 0)), (10, b"".join(_pb((0, x))[1:] for x in (1, 2, 0, 0, 1, 2, 0))))
    block = _pb((1, _pb((1, b""), (1, b"railway"), (1, b"station"))), (2, _pb((2, dense))))
    blob = _pb((3, zlib.compress(block)))
    head = _pb((1, b"OSMData"), (3, len(blob)))
    (tmp_path / "a.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    got = geo.osm_nodes(spark, str(tmp_path / "a.pbf"), (12.0, 79.0, 14.0, 81.0))
    assert [(r["id"], round(r["lat"], 6), round(r["lon"], 6), r["tags"]) for r in got.collect()] == [(10, 13.0, 80.0, {"railway": "station"})]
    assert geo.osm_nodes(spark, str(tmp_path / "a.pbf"), tagged=False).count() == 3


def test_geojson_and_dictionary(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 80.0, 13.0), ("b", None, None)], "name string, lon double, lat double")
    sinks.write_geojson(df, "lon", "lat", str(tmp_path / "a.js"), "DATA")
    text = (tmp_path / "a.js").read_text()
    data = json.loads(text.removeprefix("const DATA = ").rstrip(";"))
    assert sorted((f["properties"]["name"], f["geometry"] and f["geometry"]["coordinates"]) for f in data["features"]) == [("a", [80.0, 13.0]), ("b", None)]
    assert rows(sinks.dictionary({"t": df}).where("column = 'lon'")) == [("t", "lon", "double", 2, 1)]
    assert json.loads(sinks.manifest(df, source="x"))["rows"] == 2
    sinks.write_layer(df, str(tmp_path / "pkg"), "stations")
    assert spark.read.parquet(str(tmp_path / "pkg" / "stations")).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"), True)
    assert rows(files.csv_table(spark, str(tmp_path / "csv"), "name string, lon double, lat double"))[0] == ("a", 80.0, 13.0)
    assert tuple(sinks.extent(df, "lon", "lat").first()) == (80.0, 13.0, 80.0, 13.0)


def _extract(path, nodes, ways, relations):
    """A .pbf file of one block: nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, members, tags)."""
    words = [b""]

    def word(t):
        words.append(t.encode())
        return len(words) - 1

    zz = lambda n: n * 2 if n >= 0 else -n * 2 - 1

    def packed(values):
        out = b""
        for n in values:
            while True:
                out += bytes([n & 127 | (128 if n > 127 else 0)])
                n >>= 7
                if not n:
                    break
        return out

    def deltas(values):
        return packed([zz(b - a) for a, b in zip([0, *values], values)])

    tagged = lambda tags: [(2, packed([word(k) for k in tags])), (3, packed([word(v) for v in tags.values()]))]
    group = []
    kv = []
    for _, _, _, tags in nodes:
        kv += [x for k, v in tags.items() for x in (word(k), word(v))] + [0]
    group.append((2, _pb((1, deltas([n[0] for n in nodes])), (8, deltas([round(n[1] * 1e7) for n in nodes])), (9, deltas([round(n[2] * 1e7) for n in nodes])), (10, packed(kv)))))
    for i, refs, tags in ways:
        group.append((3, _pb((1, i), *tagged(tags), (8, deltas(refs)))))
    kinds = {"node": 0, "way": 1, "relation": 2}
    for i, members, tags in relations:
        group.append((4, _pb((1, i), *tagged(tags), (8, packed([word(m[2]) for m in members])), (9, deltas([m[1] for m in members])), (10, packed([kinds[m[0]] for m in members])))))
    block = _pb((1, _pb(*((1, w) for w in words))), (2, _pb(*group)))
    blob = _pb((3, zlib.compress(block)))
    head = _pb((1, b"OSMData"), (3, len(blob)))
    path.write_bytes(struct.pack(">I", len(head)) + head + blob)


def test_osm_ways_relations_and_layers(spark, tmp_path):
    d = 0.001
    grid = {10 * r + c: (13.0 + d * r, 80.0 + d * c) for r in range(6) for c in range(6)}
    nodes = [(i, *p, {"amenity": "bus_station"} if i == 55 else {}) for i, p in sorted(grid.items())]
    ways = [
        (1, [0, 1, 2], {"railway": "subway", "name": "Purple Line"}), (2, [2, 3], {"railway": "subway"}), (3, [0, 1, 11, 10, 0], {"amenity": "parking", "name": "P"}),
        (4, [0, 5, 55], {}), (5, [0, 50, 55], {}), (6, [22, 23, 33, 32, 22], {}), (7, [3, 999], {"railway": "subway", "name": "cut off"}), (8, [40, 41], {"highway": "path"}),
    ]
    relations = [(9, [("way", 4, "outer"), ("way", 5, "outer"), ("way", 6, "inner"), ("node", 55, "label")], {"type": "multipolygon", "amenity": "parking"}), (10, [("way", 4, "")], {"type": "route"})]
    _extract(tmp_path / "a.pbf", nodes, ways, relations)
    path = str(tmp_path / "a.pbf")
    got = geo.osm_elements(spark, path)
    assert {(r["kind"], r["count"]) for r in got.groupBy("kind").count().collect()} == {("node", 36), ("way", 8), ("relation", 2)}
    assert [(m["kind"], m["ref"], m["role"]) for m in got.where("id = 9 and kind = 'relation'").first()["members"]] == relations[0][1]
    lines = {r["id"]: r for r in geo.osm_lines(spark, path, geo.has_tags({"railway": ["subway", "light_rail"]})).collect()}
    assert set(lines) == {1, 2, 7} and [(round(p["y"], 6), round(p["x"], 6)) for p in lines[1]["points"]] == [grid[0], grid[1], grid[2]] and not lines[1]["closed"]
    layer = {r["name"]: r for r in geo.alignment_layer(spark, path, {"railway": "subway"}, 44).collect()}
    assert set(layer) == {"Purple Line"} and layer["Purple Line"]["length_km"] == pytest.approx(0.217, abs=0.002)
    assert geo.osm_lines(spark, path, geo.has_tags({"railway": True}), (13.0, 80.0025, 13.1, 80.1)).count() == 2
    places = {(r["kind"], r["id"], r["category"]): r for r in geo.place_layer(spark, path, {"parking": {"amenity": "parking"}, "stops": {"amenity": ["bus_station"], "highway": "bus_stop"}}, 44).collect()}
    cell = 108.4 * 110.6
    assert set(places) == {("way", 3, "parking"), ("relation", 9, "parking"), ("node", 55, "stops")}
    assert places["way", 3, "parking"]["area_m2"] == pytest.approx(cell, rel=0.01) and places["relation", 9, "parking"]["area_m2"] == pytest.approx(24 * cell, rel=0.01)
    assert geo.osm_nodes(spark, path).count() == 1 and geo.osm_areas(spark, path, geo.has_tags({"amenity": "school"})).count() == 0


def test_rings_from_pieces():
    assert geo._rings([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)], [(5, 5), (6, 6)]])[0][0] in {(0, 0), (1, 0), (1, 1)}
    assert geo._rings([[(0, 0), (1, 0), (1, 1), (0, 0)]]) == [[(0, 0), (1, 0), (1, 1), (0, 0)]] and geo._rings([]) == []


def test_daily_steps(tmp_path):
    from quaymill.streaming.daily import run_steps

    ran = []

    def fails():
        print("asked")
        raise OSError("no answer")

    steps = {"fetch": fails, "merge": lambda: ran.append(1)}
    for _ in range(3):
        assert run_steps(steps, tmp_path / "logs" / "daily.log") == {"fetch": "OSError: no answer", "merge": "done"}
    text = (tmp_path / "logs" / "daily.log").read_text()
    assert len(ran) == 3 and text.count("=====\n") == 3 and "asked" in text and text.rstrip().endswith("done")
    run_steps(steps, tmp_path / "logs" / "daily.log", most=100, lines=5)
    assert len((tmp_path / "logs" / "daily.log").read_text().splitlines()) == 5


def test_sheet_names_and_limits(spark, tmp_path, monkeypatch):
    from quaymill.sources import sinks

    long = "predictions of the second phase "
    names = sinks._sheet_names([long + "a", long + "b", "a/b", "A:B", ""])
    assert len({n.lower() for n in names}) == 5 and all(0 < len(n) <= 31 for n in names) and names[1].endswith(" 2")
    monkeypatch.setattr(sinks, "SHEET_ROWS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        sinks.write_workbook({"x": spark.range(3)}, str(tmp_path / "a.xlsx"))
    assert not (tmp_path / "a.xlsx").exists()
