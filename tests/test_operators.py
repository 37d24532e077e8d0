"""Relational, matching, geometry, graph, model and streaming operators against plain Python."""

from __future__ import annotations

import heapq
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymill.operators import geometry as G
from quaymill.operators import graph as N
from quaymill.operators import matching as M
from quaymill.operators import models as L
from quaymill.operators import stations as B
from quaymill.operators import tables as T
from quaymill.streaming import store as X


def test_average_rank(spark):
    rnd = random.Random(0)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), 1.0, 2.0, 2.0, 5.0, rnd.random()]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double, id int")
    want = pd.DataFrame(data, columns=["g", "v", "id"]).assign(g=lambda x: x.g.fillna("none"))
    want["r"] = want.groupby("g")["v"].rank(pct=True)
    got = {r["id"]: r["r"] for r in T.average_rank(df, ["g"], "v", "r").collect()}
    for i, r in zip(want["id"], want["r"]):
        assert (got[i] is None) == (r != r) and (r != r or math.isclose(got[i], r))
    assert T.average_rank(df.limit(0), ["g"], "v", "r").count() == 0


def test_running_sum_and_numbers(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("k"))
    got = sorted((r["g"], r["k"], r["id"], r["n"]) for r in T.row_numbers(df, ["g"], ["k", "id"], "n").collect())
    for g in range(3):
        assert [x[3] for x in got if x[0] == g] == list(range(1, len([x for x in got if x[0] == g]) + 1))


@pytest.mark.parametrize("n", [1, 5, 6, 7, 11, 40, 94, 134])
def test_quantile_bands(spark, n):
    df = spark.range(n).select("id")
    want = pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False, duplicates="drop") + 1 if n > 1 else [1]
    assert [r["b"] for r in T.quantile_bands(df, ["id"], "b").orderBy("id").collect()] == list(want)


def test_upsert_prefers_complete_then_late_then_fresh(spark, rows):
    s = "k string, v int, is_partial boolean, stamp int"
    old = spark.createDataFrame([("a", 1, True, 1), ("b", 2, False, 1), ("c", 3, False, 5), ("d", 4, None, 1)], s)
    new = spark.createDataFrame([("a", 10, False, 0), ("b", 20, True, 9), ("c", 30, False, 5), ("d", 40, False, None), ("e", 50, True, None)], s)
    assert rows(T.upsert(old, new, ["k"], "is_partial", "stamp").select("k", "v")) == [("a", 10), ("b", 2), ("c", 30), ("d", 40), ("e", 50)]


def test_entropy_and_metrics(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None)], "k string, t string")
    got = {r["k"]: r["entropy"] for r in T.mix_entropy(df, "k", "t").collect()}
    assert got["b"] == 0 and math.isclose(got["a"], -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(2)) and "c" not in got
    m = T.fit_metrics(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (0.0, 1.0), (None, 2.0), (3.0, float("nan"))], "a double, p double"), "a", "p").first()
    assert m["n"] == 3 and math.isclose(m["mae"], 2 / 3) and math.isclose(m["mape"], 25.0) and math.isclose(m["r2"], 0.0)
    x = pd.Series([1, 2, 2, 9, 30.0])
    assert math.isclose(spark.createDataFrame(x.to_frame("v")).agg(T.adjusted_skewness("v")).first()[0], x.skew())


@pytest.mark.parametrize("a,b,low,high", [
    ("Anna Nagar East", "Anna Nagar West", 0, 0), ("SIPCOT I", "SIPCOT II", 0, 0), ("Perambur", "Perambur Market", 0, 0), ("Alwarpet", "Alwarpet Metro", 0.9, 1), ("", "", 0, 0), ("Guindy", "", 0, 0),
    ("கிண்டி", "கிண்டி", 1, 1), ("வண்ணாரப்பேட்டை", "ஆயிரம் விளக்கு", 0, 0.8), ("Washermanpet†*", "Washermanpet", 1, 1), ("Kandanchavadi", "Kumananchavadi", 0.85, 0.99), (None, "Guindy", 0, 0), (float("nan"), "Guindy", 0, 0),
])
def test_likeness(spark, a, b, low, high):
    df = spark.createDataFrame([(a if isinstance(a, str) else None, b)], "a string, b string")
    assert low <= df.select(M.likeness(M.plain_key(F.col("a")), M.plain_key(F.col("b")))).first()[0] <= high


@pytest.mark.parametrize("name,key", [
    ("Arignar Anna Alandur", "anna alandur"), ("Sholinganallur metro station", "sholinganallur"), ("Washermanpet†*", "washermanpet"), ("Chennai Egmore Metro", "egmore"), ("Guindy (UG) #2", "guindy 2"),
    ("Metropolis Road", "polis road"), ("Dr. M.G. Ramachandran Central¤", "m g ramachandran central"), ("Café  du\tNord", "cafe du nord"), ("ﬁne²", "fine2"), ("Sri-Ram_Nagar", "ram_nagar"), ("(all)", ""), ("", ""), (None, ""), ("கிண்டி", "க ண ட"),
])
def test_plain_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(M.plain_key(F.col("n"))).first()[0] == key


def _likeness(x: str, y: str) -> float:
    marks = lambda k: sorted({w for w in k.split() if w in M.QUALIFIERS})
    return SequenceMatcher(None, x, y).ratio() if x and y and marks(x) == marks(y) else 0.0


def _match(spark, left, right, t, aliases=None):
    one = lambda x: spark.createDataFrame(list(zip(x, range(len(x)))), "name string, pos bigint")
    al = None if aliases is None else spark.createDataFrame([(k, v) for k, vs in aliases for v in vs], "name string, alias string")
    return {r["l"]: r["r"] for r in M.match_names(one(left), one(right), t, al).collect()}


def test_match_names(spark):
    assert _match(spark, ["New Washermanpet", "Washermanpet"], ["Washermanpet"], 0.75) == {"New Washermanpet": None, "Washermanpet": "Washermanpet"}
    assert _match(spark, ["Guindy", "Thousand Lights"], ["ஆயிரம் விளக்கு", "கிண்டி"], 0.75, [("Guindy", ["கிண்டி"]), ("Thousand Lights", ["ஆயிரம் விளக்கு"])]) == {"Guindy": "கிண்டி", "Thousand Lights": "ஆயிரம் விளக்கு"}
    assert _match(spark, ["Dr. X Central¤"], ["Central Metro"], 0.8, [("Dr. X Central", ["Central Metro"]), ("Dr. X Central¤", ["மத்திய"])]) == {"Dr. X Central¤": "Central Metro"}
    assert _match(spark, ["Guindy"], ["Koyambedu"], 0.82) == {"Guindy": None}
    got = _match(spark, ["Aaaa", "Aaab", "Aaac"], ["Aaaa", "Aaad"], 0.5)
    used = [v for v in got.values() if v]
    assert len(used) == len(set(used)) == 2 and got["Aaaa"] == "Aaaa"
    assert _match(spark, [], ["x"], 0.5) == {} and _match(spark, ["x"], [], 0.5) == {"x": None}


@pytest.mark.parametrize("threshold,letters", [(0.4, "abcd "), (0.72, "abcd "), (0.72, "ab"), (0.82, "abc"), (0.95, "ab")])
def test_scored_pairs_lose_none(spark, threshold, letters):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12)))
    a, b = ({" ".join(word().split()) for _ in range(120)} - {""} for _ in range(2))
    want = {(x, y) for x in a for y in b if _likeness(x, y) >= threshold}
    got = M.scored_pairs(spark.createDataFrame([(x, x) for x in a], "l string, key string"), spark.createDataFrame([(x, x) for x in b], "r string, key string"), threshold)
    assert {(r["l"], r["r"]) for r in got.collect()} == want and want


def _pts(spark, n=120, seed=1, size=1000):
    rnd = random.Random(seed)
    p = [(i, rnd.uniform(-size, size), rnd.uniform(-size, size), rnd.choice("abc")) for i in range(n)]
    return p, spark.createDataFrame([*p, (9998, None, 1.0, "a"), (9999, float("nan"), 1.0, "b")], "id int, x double, y double, g string")


def test_near_and_nearest(spark):
    p, df = _pts(spark)
    want = {(a[0], b[0]) for a in p for b in p if math.hypot(a[1] - b[1], a[2] - b[2]) <= 150}
    assert {(r[0], r[1]) for r in G.near(df, df, 150.0).collect()} == want
    got = {(r["a_id"], r["rk"]): r["b_id"] for r in G.nearest(df, df, 400.0, 3).collect()}
    for a in p[:20]:
        order = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in p)
        assert [got.get((a[0], k + 1)) for k in range(3)] == [i if d <= 400 else None for d, i in order[:3]]
    assert {r["id"] for r in G.crowded(df, 30.0).where("crowded").collect()} == {a[0] for a in p for b in p if a[0] != b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) < 30}


def test_projection(spark):
    df = spark.createDataFrame([(13.0827, 80.2707), (0.0, 81.0), (60.0, 84.0)], "lat double, lon double")
    x, y = G.utm(F.col("lat"), F.col("lon"), 44)
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert abs(r[1]["x"] - 500000) < 1e-3 and abs(r[1]["y"]) < 1e-3
    assert abs(r[0]["x"] - 420932.0) < 60 and abs(r[0]["y"] - 1446414.0) < 100
    lat, lon = G.from_utm(x, y, 44)
    for a in df.select("lat", "lon", lat.alias("p"), lon.alias("q")).collect():
        assert abs(a["lat"] - a["p"]) < 1e-8 and abs(a["lon"] - a["q"]) < 1e-8


def test_lines(spark, rows):
    lines = spark.createDataFrame([("L", [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0)]), ("M", [(0.0, 300.0), (100.0, 300.0)]), ("one", [(1.0, 1.0)]), ("none", None)], "name string, p array<struct<x:double,y:double>>")
    s = G.segments(lines, "name", "p")
    assert rows(G.line_lengths(s)) == [("L", 150.0, 2), ("M", 100.0, 1)]
    p = spark.createDataFrame([(1, 50.0, 10.0, "M", True), (2, 120.0, 25.0, "L", True), (3, 50.0, 200.0, "M", True), (4, 50.0, 900.0, "M", True), (5, 50.0, 10.0, "L", False)], "id int, x double, y double, own string, go boolean")
    assert rows(G.nearest_line(p, s, 150.0).select("id", "line")) == [(1, "L"), (2, "L"), (3, "M"), (4, None), (5, "L")]
    got = {r["id"]: r for r in G.snapped(p, s, 400.0, "own", "go").collect()}
    assert (got[1]["x"], got[1]["y"]) == (50.0, 300.0) and (got[2]["x"], got[2]["y"]) == (100.0, 25.0) and not got[4]["moved"] and not got[5]["moved"]
    assert {r["id"] for r in G.off_line(p, s, 250.0, "own").collect()} == {1, 4}
    sq = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],)], "r array<struct<x:double,y:double>>")
    assert sq.select(G.ring_area("r")).first()[0] == 8 and tuple(sq.select(G.ring_centroid(F.col("r"))).first()[0]) == (2.0, 1.0)


def test_concave_hull():
    rnd = np.random.default_rng(4)
    a = rnd.uniform(0, 1, (400, 2)) * 100
    u = a[(a[:, 0] < 30) | (a[:, 1] < 30)]  # an L
    convex, hull = G.polygon_area(G._hull(u)), G.polygon_area(G.concave_hull(u, 0.1))
    assert 0 < hull < 0.8 * convex and math.isclose(G.polygon_area(G.concave_hull(u, 1.0)), convex)


def test_catchments_and_gaps(spark):
    rnd = random.Random(0)
    reached = [(1, rnd.uniform(-400, 400), rnd.uniform(-400, 400)) for _ in range(80)] + [(2, 0.0, 0.0), (2, 1.0, 1.0)] + [(3, float(i), 0.0) for i in range(9)]
    got = {r["id"]: r for r in G.catchments(spark.createDataFrame(reached, "id int, x double, y double"), 800.0).collect()}
    assert 0.1 < got[1]["pnr"] < 0.33 and got[2]["network_area_m2"] == got[3]["network_area_m2"] == pytest.approx(math.pi * 2500)
    cells = spark.createDataFrame([(r, c, c * 100.0, r * 100.0, 50.0 if (r, c) not in ((0, 2),) else 1.0) for r in range(2) for c in range(6)], "row int, col int, x double, y double, value double")
    st = spark.createDataFrame([(1, 300.0, 0.0)], "id int, x double, y double")
    gaps = sorted((r["cells"], r["total"], r["area_m2"]) for r in G.coverage_gaps(st, cells, 50.0, 100.0, 10.0, 10000.0).collect())
    assert gaps == [(10, 500.0, 100000.0)]
    assert {r["id"]: r["total"] for r in G.zonal_sum(st, cells, 100.0).collect()} == {1: 151.0}


def test_order_along_a_line(spark):
    p = spark.createDataFrame([("L", i, 100.0 * i, 30.0 * i + (i % 2)) for i in random.Random(2).sample(range(20), 20)], "line string, id int, x double, y double")
    pos = [r["id"] for r in G.ordered_along(p, "line").orderBy("pos").collect()]
    assert pos in (list(range(20)), list(range(19, -1, -1)))
    assert G.consecutive(G.ordered_along(p, "line"), p, "line").count() == 19


def _edges(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), float(rnd.randint(1, 9))) for _ in range(m)]


def test_components(spark):
    e = _edges(3, 200, 120) + [(i, i + 1, 1.0) for i in range(1000, 1200)] + [(None, 5, 1.0), (7, 7, 1.0)]
    parent = {i: i for a, b, _ in e for i in (a, b) if a is not None and b is not None} | {i: i for i in range(300)}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b, _ in e:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = N.components(spark.createDataFrame(e, "src int, dst int, weight double"), spark.range(300).select(F.col("id").cast("int")))
    assert {r["id"]: r["component"] for r in got.collect()} == {k: find(k) for k in range(300)}
    none = spark.createDataFrame([], "src int, dst int, weight double")
    assert N.components(none).count() == 0 and N.spanning_forest(none).count() == 0


def test_bounded_distances(spark):
    e = _edges(5, 60, 200)
    adj = {}
    for a, b, w in e:
        adj.setdefault(a, []).append((b, w))
    want = {}
    for s in (0, 1, 2):
        dist, q = {}, [(0.0, s)]
        while q:
            d, v = heapq.heappop(q)
            if v not in dist:
                dist[v] = d
                for b, w in adj.get(v, ()):
                    if d + w <= 12:
                        heapq.heappush(q, (d + w, b))
        want |= {(s, v): d for v, d in dist.items()}
    src = spark.createDataFrame([(i, i) for i in (0, 1, 2)], "source int, id int")
    got = N.bounded_distances(src, spark.createDataFrame(e, "src int, dst int, weight double"), 12.0)
    assert {(r["source"], r["id"]): r["distance"] for r in got.collect()} == want


def test_spanning_forest_and_centrality(spark):
    e = _edges(8, 40, 90)
    df = spark.createDataFrame(e, "src int, dst int, weight double")
    tree = N.spanning_forest(df).collect()
    parent = list(range(40))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    total = n = 0
    for w, a, b in sorted((w, *sorted((a, b))) for a, b, w in e):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, n = total + w, n + 1
    assert sum(r["weight"] for r in tree) == total and len(tree) == n
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    got = {r["id"]: r for r in N.centrality(path).collect()}
    assert got["a"]["betweenness"] == 0 and got["b"]["betweenness"] == pytest.approx(2 / 3) and got["a"]["closeness"] == pytest.approx(3 / 8)
    assert {r["id"]: r["degree"] for r in N.degree(path, spark.createDataFrame([("z",), ("a",)], "id string")).collect()} == {"a": 1, "z": 0}


def _train(spark, n=200):
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(0, 1, n), rnd.normal(0, 2, n)
    y = np.expm1(5 + 0.5 * a - 0.2 * b + rnd.normal(0, 0.1, n))
    return pd.DataFrame({"id": range(n), "a": a, "b": b, "twin": a + rnd.normal(0, 0.01, n), "flat": 1.0, "y": y})


def test_leave_one_out_is_refitting(spark):
    t = _train(spark, 40)
    got = {r["id"]: r["predicted"] for r in L.leave_one_out(spark.createDataFrame(t), ["a", "b"], "y").collect()}
    for i in (0, 7, 39):
        rest = t[t.id != i]
        x = np.column_stack([np.ones(len(rest)), rest.a, rest.b])
        beta = np.linalg.lstsq(x, np.log1p(rest.y), rcond=None)[0]
        assert got[i] == pytest.approx(np.expm1(beta @ [1, t.a[i], t.b[i]]), rel=1e-6)


def test_screening_and_models(spark):
    t = spark.createDataFrame(_train(spark))
    kept = L.screen(t, ["a", "b", "twin", "flat"], "y", ["a"])
    assert kept == ["a", "b"]
    assert L.screen(t, ["flat"], "y") == []
    for kind in ("linear", "random_forest"):
        m = T.fit_metrics(L.cross_validated(t, "id", ["a", "b"], "y", kind, 3, **({"trees": 20} if kind != "linear" else {})), "y", "predicted").first()
        assert m["n"] == 200 and m["r2"] > 0.6
    iv = L.bootstrap_intervals(t, "y", ["a", "b"], t, "id", 60).join(t, "id")
    assert iv.where("lower > upper").count() == 0 and 0 < iv.where("upper - lower > 0").count() == 200
    base = L.fitted(t, ["a", "b"], "y", "linear")
    up = L.simulate(base, t, {"a": ("add", 1.0)}).agg(F.avg("predicted")).first()[0] / L.predicted(base, t).agg(F.avg("predicted")).first()[0]
    assert up == pytest.approx(math.exp(0.5), rel=0.05)
    with pytest.raises(ValueError):
        L.simulate(base, t, {"a": ("power", 2)})


def test_negative_binomial(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(3, 2, 3000)
    mu = np.exp(1 + 0.4 * (x - x.mean()) / x.std())
    y = rnd.negative_binomial(2, 2 / (2 + mu))
    beta, alpha = L.negative_binomial(spark.createDataFrame(pd.DataFrame({"x": x, "y": y.astype(float)})), ["x"], "y")
    assert beta["x"] == pytest.approx(0.4, abs=0.05) and beta["const"] == pytest.approx(1.0, abs=0.06) and 0.3 < alpha < 0.8


def test_the_store_survives_late_files_and_reruns(spark, tmp_path, rows):
    schema = "k string, v int, is_partial boolean, stamp int"
    src, path = tmp_path / "in", str(tmp_path / "store")
    put = lambda data, n: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src))
    put([("a", 1, True, 1), ("b", 5, False, 1)], 0)
    store = X.Store(spark, path, schema, "k")

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        X.upsert_stream(s, store, ["k"], "is_partial", "stamp", str(tmp_path / "cp")).awaitTermination()

    run()
    put([("a", 2, False, 2)], 1)
    put([("a", 3, True, 3), ("c", 9, True, 1)], 2)
    run()
    want = [("a", 2), ("b", 5), ("c", 9)]
    assert rows(store.read().select("k", "v")) == want
    n = store.versions()
    run()
    assert store.versions() == n and rows(store.read().select("k", "v")) == want
    store.merge(spark.createDataFrame([("c", 9, True, 1)], schema), n[-1], ["k"], "is_partial", "stamp")  # a batch run again
    assert rows(store.read().select("k", "v")) == want
    before = {p.name for p in (tmp_path / "store").glob("v*/part=b")}
    for i in range(4):
        store.merge(spark.createDataFrame([("a", 10 + i, False, 9 + i), (None, i, False, i)], schema), n[-1] + 1 + i, ["k"], "is_partial", "stamp")
    assert rows(store.read().select("k", "v")) == sorted([("a", 13), ("b", 5), ("c", 9), (None, 3)], key=repr)
    assert {p.name for p in (tmp_path / "store").glob("v*/part=b")} == before  # what a batch doesn't touch isn't written
    assert all(len(held) <= 2 for held in store.parts().values())


def test_readiness(spark):
    import datetime as dt

    days = spark.createDataFrame([(dt.date(2025, 9, 1), False), (dt.date(2025, 9, 1), False), (dt.date(2025, 9, 3), False), (dt.date(2025, 9, 6), False), (dt.date(2025, 9, 7), True), (None, False)], "d date, p boolean")
    on = lambda *x: F.lit(dt.date(2025, *x))
    assert tuple(X.readiness(days, "d", "p", 2, on(9, 8)).first()) == (2, 1, 0, True, dt.date(2025, 9, 6), 3, dt.date(2025, 9, 7), 1, False)
    late = X.readiness(days, "d", "p", 10, on(9, 9)).first()
    assert (late["ready"], late["weekdays_needed"], late["days_old"], late["is_stale"]) == (False, 8, 2, True)
    assert X.readiness(days.limit(0), "d", "p").select("weekdays", "ready", "newest", "is_stale").first() == (0, False, None, False)


def test_station_features(spark):
    from quaymill.operators import features as S

    nodes = spark.createDataFrame([(r * 10 + c, c * 100.0, r * 100.0) for r in range(9) for c in range(9)], "id int, x double, y double")
    pairs = [(r * 10 + c, r * 10 + c + 1) for r in range(9) for c in range(8)] + [(r * 10 + c, r * 10 + c + 10) for r in range(8) for c in range(9)]
    edges = spark.createDataFrame([(a, b, 110.0) for a, b in pairs] + [(b, a, 110.0) for a, b in pairs], "src int, dst int, length double")
    st = spark.createDataFrame([(1, 400.0, 400.0), (2, 9000.0, 9000.0)], "id int, x double, y double")
    got = {r["id"]: r for r in S.design_features(st, nodes, edges, 150.0).collect()}
    assert got[1]["intersections"] == 9 and got[1]["circuity"] == pytest.approx(1.1) and got[2]["intersections"] == 0 and got[2]["street_density"] == 0
    km2 = 32 * math.sin(2 * math.pi / 64) * 150**2 / 1e6
    assert got[1]["intersection_density"] == pytest.approx(9 / km2) and got[1]["street_density"] == pytest.approx(24 * 2 * 0.11 / km2)
    c = S.network_catchments(st, nodes, edges, 350.0, 200.0).collect()
    assert len(c) == 1 and c[0]["nodes"] == 25 and 0.4 < c[0]["pnr"] <= 0.47 and c[0]["snap_m"] == 0
    pois = spark.createDataFrame([(1, 410.0, 400.0, "shop"), (2, 400.0, 420.0, "bank"), (3, 400.0, 900.0, "shop")], "id int, x double, y double, kind string")
    p = {r["id"]: r for r in S.poi_features(st, pois, 150.0, {"retail": ["shop"], "office": ["bank", "desk"]}).collect()}
    assert (p[1]["poi_retail"], p[1]["poi_office"], p[1]["poi_total"], p[2]["poi_total"]) == (1, 1, 2, 0)
    park = pois.select("id", "x", "y", F.lit(50.0).alias("area_m2"))
    f = {r["id"]: r for r in S.feeder_features(st, pois, park, pois, 150.0, 600.0, 50.0).collect()}
    assert (f[1]["bus_stops"], f[1]["parking_area_m2"], f[1]["is_intermodal_hub"], f[2]["parking_area_m2"]) == (2, 150.0, 1, 0.0)
    cells = spark.createDataFrame([(0, 0, 400.0, 400.0, 500.0), (0, 1, 450.0, 400.0, 300.0)], "row int, col int, x double, y double, value double")
    d = {r["id"]: r for r in S.density_features(st, cells, 150.0).collect()}
    assert d[1]["population"] == 800 and d[1]["density_km2"] == pytest.approx(800 / km2) and d[2]["population"] is None
    e = {r["id"]: r["landuse_entropy"] for r in S.landuse_features(st, cells, 150.0).collect()}
    assert e == {1: pytest.approx(1.0)}
    a = S.assembled(st, S.design_features(st, nodes, edges, 150.0), ranked=("intersections",))
    assert {r["id"]: r["intersections_pctl"] for r in a.collect()} == {1: 1.0, 2: 0.5}


def test_a_whole_model_run(spark):
    t = _train(spark)
    t.loc[3, "a"] = np.nan
    df = spark.createDataFrame(t)
    metrics, out = L.run(df.where("id < 150"), df.where("id >= 150"), "id", ["a", "b", "flat"], "y", kinds=("linear", "random_forest"), folds=2, replicates=40, trees=10)
    assert metrics.where("chosen").count() == 1 and metrics.where("model = 'linear'").first()["r2"] > 0.8
    assert out.count() == 50 and out.where("lower > upper or predicted is null").count() == 0
    check = L.transfer_check(out, df, "id", "predicted", "y").first()
    assert check["n"] == 50 and check["r2"] > 0.7 and check["in_band"]
    assert L.transfer_check(out.limit(2), df, "id", "predicted", "y").first()["r2"] is None


def test_every_unmatched_name_is_diagnosed(spark):
    left = spark.createDataFrame([("Alandur", 1), ("Guindy", 2), ("Qqqq", 3), ("", 4)], "name string, pos bigint")
    right = spark.createDataFrame([("Alandur", 1), ("Gunddi", 2)], "name string, pos bigint")
    got = {r["l"]: (r["r"], r["score"]) for r in M.nearest_failures(left, right, M.match_names(left, right, 0.95)).collect()}
    assert set(got) == {"Guindy", "Qqqq", ""} and got["Guindy"][0] == "Gunddi" and got["Qqqq"] == got[""] == (None, None)


def test_fuzzy_failures_are_those_of_the_match(spark):
    from quaymill.plans import modelling

    d = "/root/testdata/sf0.001"
    match = {r["l"] for r in modelling.q_fuzzy_match(spark, d).where("r is null").collect()}
    got = [r["l"] for r in modelling.q_fuzzy_failures(spark, d).collect()]
    assert match and sorted(got) == sorted(match)


def test_line_merge(spark):
    seg = lambda line, part, a, b: (line, part, *map(float, a), *map(float, b))
    L1 = [seg("A", i, p, q) for i, (p, q) in enumerate([((0, 0), (1, 0)), ((2, 0), (1, 0)), ((2, 0), (3, 1)), ((1, 0), (0, 0)), ((9, 9), (8, 9))])]
    ring = [seg("B", i, p, q) for i, (p, q) in enumerate([((0, 0), (1, 0)), ((1, 1), (1, 0)), ((1, 1), (0, 0))])]
    fork = [seg("C", i, p, q) for i, (p, q) in enumerate([((0, 0), (1, 0)), ((1, 0), (2, 0)), ((1, 0), (1, 5)), ((1, 5), (1, 6))])]
    df = spark.createDataFrame([*L1, *ring, *fork, ("D", 0, 1.0, 1.0, 1.0, 1.0)], "line string, part int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in sorted(G.merged_lines(df).collect(), key=lambda r: (r["line"], r["path"], r["part"])):
        got.setdefault((r["line"], r["path"]), [(r["x1"], r["y1"])]).append((r["x2"], r["y2"]))
    assert got["A", 0] == [(0, 0), (1, 0), (2, 0), (3, 1)] and got["A", 1] == [(8, 9), (9, 9)]
    assert got["B", 0] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert sorted(got["C", i] for i in range(3)) == [[(0, 0), (1, 0)], [(1, 0), (1, 5), (1, 6)], [(1, 0), (2, 0)]] and len(got) == 6


def test_projection_guards(spark):
    assert G.city_zone("Chennai") == 44
    with pytest.raises(ValueError, match="no projection"):
        G.city_zone("Atlantis")
    deg = spark.createDataFrame([(1, 80.2, 13.0)], "id int, x double, y double")
    with pytest.raises(ValueError, match="degrees"):
        G.catchment_circles(deg, [400.0])
    out = G.catchment_circles(deg.withColumn("x", F.col("x") * 1e4), [400.0, 800.0]).collect()
    assert sorted(r["radius_m"] for r in out) == [400.0, 800.0] and out[0]["buffer_area_m2"] == pytest.approx(32 * math.sin(math.pi / 32) * out[0]["radius_m"] ** 2)
    assert G.catchment_circles(deg.limit(0), [400.0]).count() == 0


def test_long_segments_ask_few_cells(spark):
    segs = spark.createDataFrame([("L", 0, 0.0, 0.0, 50000.0, 50000.0)], "line string, part int, x1 double, y1 double, x2 double, y2 double")
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(0, 50000), rnd.uniform(0, 50000)) for i in range(3000)]
    want = {i for i, x, y in pts if abs(x - y) / 2**0.5 <= 50}
    got = G.near_segments(spark.createDataFrame(pts, "id int, x double, y double"), segs, 50.0)
    assert {r["id"] for r in got.collect()} == want and want


def test_canonical_names(spark, rows):
    one = lambda x: spark.createDataFrame(list(zip(x, range(len(x)))), "name string, pos bigint")
    explicit = spark.createDataFrame([("CMBT", "Puratchi Terminus"), ("Fort", "Not Listed")], "name string, station string")
    got = B.canonical_names(one(["CMBT", "Guindi", "Fort", "Puratchi Terminus"]), one(["Puratchi Terminus", "Guindy", "Port"]), explicit)
    assert rows(got) == sorted([("CMBT", "Puratchi Terminus", "explicit"), ("Guindi", "Guindy", "likeness"), ("Fort", "Port", "likeness"), ("Puratchi Terminus", None, None)], key=repr)


def test_station_build(spark):
    wanted = spark.createDataFrame([("Alpha", "L", 0), ("Beta", "L", 1), ("Gamma Depot", "L", 2), ("Delta", "M", 3), ("Nowhere", "L", 4), ("Epsilon II", "L", 5), ("Zeta", "L", 6)], "name string, line string, pos bigint")
    mapped = spark.createDataFrame([("Alpha Metro", 100.0, 5.0, 0), ("Beta", 100.0, 9000.0, 1), ("Delta", 0.0, 9000.0, 2)], "name string, x double, y double, pos bigint")
    lines = spark.createDataFrame([("L", 0, 0.0, 0.0, 20000.0, 0.0)], "line string, part int, x1 double, y1 double, x2 double, y2 double")
    articles = spark.createDataFrame([("Beta", 5000.0, 20.0)], "name string, x double, y double")
    gazetteer = spark.createDataFrame([("Gamma", 8000.0, 500.0), ("Epsilon", 8100.0, 600.0), ("Zeta", 15000.0, 2600.0), ("Alpha", 1.0, 1.0)], "name string, x double, y double")
    got = {r["name"]: tuple(r)[2:] for r in B.positioned(wanted, mapped, lines, articles, gazetteer).collect()}
    assert got["Alpha"] == (100.0, 5.0, "osm", "high") and got["Beta"] == (5000.0, 20.0, "wikipedia", "high")  # the map's Beta lies off its line
    assert got["Gamma Depot"] == (8000.0, 500.0, "nominatim_stem", "low") and got["Delta"] == (0.0, 9000.0, "osm", "high") and got["Nowhere"] == (None, None, None, None)
    assert got["Zeta"][2:] == ("nominatim", "low")
    running = spark.createDataFrame([("Omega", "L", 50.0, 0.0, "osm", "high"), ("Lost", "L", None, None, "osm", "high")], "name string, line string, x double, y double, source string, confidence string")
    out = {r["name"]: r for r in B.combined(running, B.positioned(wanted, mapped, lines, articles, gazetteer), lines).collect()}
    assert set(out) == {"Omega", "Alpha", "Beta", "Gamma Depot", "Delta", "Epsilon II", "Zeta"} and out["Omega"]["station_id"] == "MAA000" and out["Alpha"]["station_id"] == "MAA001"
    assert (out["Gamma Depot"]["y"], out["Gamma Depot"]["moved_m"], out["Gamma Depot"]["confidence"]) == (0.0, 500.0, "low")  # 100 m from the next one
    assert out["Zeta"]["y"] == 2600.0 and out["Zeta"]["confidence"] == "low" and out["Delta"]["phase"] == "phase2"


def test_metro_network(spark):
    cols = "id int, x double, y double, line string, name string"
    st = [(i, 1000.0 * i, 0.0, "A", f"a{i}") for i in range(5)] + [(10 + i, 2000.0, 900.0 + 1000.0 * i, "B", f"b{i}") for i in range(3)] + [(20, 9e5, 0.0, "C", "a4"), (21, None, 0.0, "A", "x"), (22, 5e5, 0.0, None, "y")]
    df = spark.createDataFrame(st, cols)
    e = {(r["src"], r["dst"]): (round(r["weight"], 6), r["kind"]) for r in B.metro_edges(df).collect()}
    assert e[0, 1] == (1000.0, "track") and e[2, 10] == (900.0, "transfer") and e[4, 20] == (1.0, "same name") and len(e) == 4 + 2 + 1 + 1
    got = {r["id"]: r for r in B.network_position(df).collect()}
    assert got[2]["is_interchange"] == 1 and got[0]["is_terminal"] == 1 and got[22]["metro_degree"] == 0 and got[22]["metro_betweenness"] is None and 21 not in got
    assert got[2]["metro_betweenness"] == max(r["metro_betweenness"] for r in got.values() if r["metro_betweenness"] is not None)
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(0, 9000), rnd.uniform(0, 9000), None, None) for i in range(20)] + [(99, 40000.0, 40000.0, None, None)]
    tree = B.metro_edges(spark.createDataFrame(pts, cols)).collect()
    parent = {p[0]: p[0] for p in pts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    total = 0.0
    for d, a, b in sorted((math.dist(p[1:3], q[1:3]), p[0], q[0]) for p in pts for q in pts if p[0] < q[0]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += d
    assert len(tree) == 20 and sum(r["weight"] for r in tree) == pytest.approx(total) and {r["kind"] for r in tree} == {"forest"}


def test_bootstrap_of_each_kind(spark):
    t = spark.createDataFrame(_train(spark, 60))
    wide = {k: L.bootstrap_intervals(t, "y", ["a", "b"], t, "id", n, kind=k, **how).agg(F.avg(F.col("upper") - F.col("lower"))).first()[0] for k, n, how in (("linear", 200, {}), ("elastic_net", 200, {"penalty": (0.01, 0.5)}), ("random_forest", 4, {"trees": 5}))}
    assert all(v > 0 for v in wide.values()) and wide["elastic_net"] == pytest.approx(wide["linear"], rel=0.3)
    many = t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(16)))).withColumn("id", F.col("id") * 100 + F.col("copy"))
    narrow = L.bootstrap_intervals(many, "y", ["a", "b"], t, "id", 200).agg(F.avg(F.col("upper") - F.col("lower"))).first()[0]
    assert narrow == pytest.approx(wide["linear"] / 4, rel=0.35)  # sixteen times the rows: a quarter of the width
    draws = L.poisson_draws(np.arange(4000), np.arange(50))
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03


def test_leave_one_out_of_any_kind(spark):
    t = spark.createDataFrame(_train(spark, 12))
    a = L.cross_validated(t, "id", ["a", "b"], "y", "linear", None).select("id", F.col("predicted").alias("p"))
    b = L.leave_one_out(t, ["a", "b"], "y")
    assert a.join(b, "id").agg(F.max(F.abs(F.col("p") - F.col("predicted")) / F.col("predicted"))).first()[0] < 1e-6 and a.count() == 12


def test_calibration_and_target(spark):
    cell = lambda v: spark.createDataFrame([(v,)], "v double")
    got = L.calibration(cell(110.0), [("stations", cell(None), False), ("series", cell(200.0), True), ("guess", cell(1.0), True)], coverage=0.5).first()
    assert (got["predicted"], got["observed"], got["source"], round(got["ratio"], 6), got["direction"], got["in_band"]) == (220.0, 200.0, "series", 1.1, "over", True)
    assert L.calibration(cell(110.0), [("stations", cell(50.0), False)]).first()["in_band"] is False
    none = L.calibration(cell(110.0), [("stations", cell(None), False)]).first()
    assert none["source"] is None and none["ratio"] is None and none["in_band"] is None
    frame = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id int, name string")
    target = spark.createDataFrame([("A", 5.0, True), ("A", 4.0, True), (None, 9.0, True)], "station string, y double, is_mature boolean")
    assert sorted(tuple(r) for r in L.with_target(frame, "name", target, "station", ["y", "is_mature"], "y").select("id", "y").collect()) == [(1, 5.0), (2, None), (3, None)]
    with pytest.raises(ValueError, match="no name"):
        L.with_target(frame, "name", target.where("station is null"), "station", ["y", "is_mature"], "y")


def test_written_steps_are_deleted(spark):
    from pathlib import Path

    from quaymill.session import cut, shared_dir, steps

    folder = Path(shared_dir(spark).removeprefix("file:")) / "quaymill"
    outer = cut(spark.range(3), "outer")
    before = {p.name for p in folder.iterdir()}
    with steps(spark):
        assert cut(spark.range(5), "inner").count() == 5 and len({p.name for p in folder.iterdir()}) == len(before) + 1
    assert {p.name for p in folder.iterdir()} == before and outer.count() == 3


def test_elastic_net(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(0, 1, (150, 4))
    y = np.expm1(4 + 0.8 * x[:, 0] + 0.3 * x[:, 1] + rnd.normal(0, 0.2, 150))
    t = spark.createDataFrame(pd.DataFrame({"id": range(150), **{f"x{i}": x[:, i] for i in range(4)}, "y": y}))
    cols = [f"x{i}" for i in range(4)]
    a = np.column_stack([np.ones(150), x, np.log1p(y)])
    g = a.T @ a
    assert np.allclose(L._shrunk(g, 0.0, 0.5, 5000), np.linalg.lstsq(a[:, :-1], a[:, -1], rcond=None)[0], atol=1e-6)  # no penalty: least squares
    z = (x - x.mean(0)) / x.std(0)
    v = a[:, -1] - a[:, -1].mean()
    b = L._shrunk(g, 0.2, 0.5)[1:] * x.std(0)
    slope = z.T @ (v - z @ b) / 150 - 0.2 * 0.5 * b  # the gradient is the penalty's where a coefficient lives, and within it elsewhere
    assert np.allclose(slope[b != 0], 0.1 * np.sign(b[b != 0]), atol=1e-6) and np.all(np.abs(slope[b == 0]) <= 0.1 + 1e-9)
    m = L.elastic_net(t, cols, "y")
    assert m.beta[1] == pytest.approx(0.8, abs=0.1) and abs(m.beta[3]) < 0.06 and m.penalty[0] < 1
    out = {r["id"]: r["predicted"] for r in L.net_left_out(t, "id", cols, "y").collect()}
    i = 17
    rest = np.delete(a, i, 0)
    assert out[i] == pytest.approx(np.expm1(a[i, :-1] @ L._shrunk(rest.T @ rest, *m.penalty)), rel=1e-6) and len(out) == 150


def test_left_out_trees(spark):
    """All folds in a few jobs, whatever the rounds; fits that don't see the row, and learn what is there."""
    from quaymill.operators import trees

    rnd = np.random.default_rng(4)
    a, b = rnd.uniform(0, 10, 400), rnd.uniform(0, 10, 400)
    y = np.expm1(3 + np.where(a > 4, 1.0, 0.0) + 0.1 * b + rnd.normal(0, 0.05, 400))
    t = spark.createDataFrame(pd.DataFrame({"id": range(400), "a": a, "b": b, "y": y}))
    spark.sparkContext.setJobGroup("left-out", "")
    got = {k: {r["id"]: r["predicted"] for r in L.cross_validated(t, "id", ["a", "b"], "y", k, 3, trees=60).collect()} for k in ("boosting", "random_forest")}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("left-out")) < 60
    spark.sparkContext.setJobGroup("", "")
    for p in got.values():
        assert len(p) == 400 and 1 - sum((p[i] - y[i]) ** 2 for i in range(400)) / (400 * y.var()) > 0.8
    other = t.withColumn("y", F.when(F.col("id") == 5, 1e6).otherwise(F.col("y")))
    assert {r["id"]: r["predicted"] for r in L.cross_validated(other, "id", ["a", "b"], "y", "boosting", 3, trees=60).collect()}[5] == pytest.approx(got["boosting"][5])
    x, v, w = rnd.integers(0, 9, (2, 80)).astype(np.uint8), rnd.normal(0, 1, 80), rnd.integers(0, 3, 80).astype(float)
    mean = lambda on: (w * v)[on].sum() / w[on].sum()
    loss = {(j, c): sum((w[on] * (v[on] - mean(on)) ** 2).sum() for on in (x[j] <= c, x[j] > c)) for j in range(2) for c in range(8) if min(w[x[j] <= c].sum(), w[x[j] > c].sum()) >= 3}
    feature, bins, value = trees.grow(x, v, w, 1, 3, 2, rnd)
    j, c = min(loss, key=loss.get)
    assert loss[feature[0], bins[0]] == pytest.approx(loss[j, c]) and value[1] == pytest.approx(mean(x[feature[0]] <= bins[0]))


def test_trees_sum_only_what_they_draw(monkeypatch):
    """At most the drawn features of each node's rows, once a level; of two children of a parent that is known, the smaller one. Splits are still the best ones."""
    from quaymill.operators import trees

    rnd = np.random.default_rng(5)
    x, v, w = rnd.integers(0, 200, (6, 3000)).astype(np.uint8), rnd.normal(0, 1, 3000), rnd.integers(0, 4, 3000).astype(float)
    v += np.where(x[2] > 90, 1.0, 0.0) + np.where(x[4] > 150, 0.5, 0.0)
    seen, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, *r, **k: (seen.append(len(a)), real(a, *r, **k))[1])
    for depth, tried, weight in ((6, 3, w), (2, 6, w > 0), (3, 6, w)):
        seen.clear()
        feature, bins, value = tree = trees.grow(x, v, weight, depth, 3, tried, np.random.default_rng(1))
        assert sum(seen) / 2 / (w > 0).sum() <= (3 * depth if tried == 3 else 6 + 3 * (depth - 1))
        at = np.zeros(3000, int)
        for _ in range(depth):
            for node in np.unique(at[feature[at] >= 0]):
                on = at == node
                loss = lambda j, c: sum((weight[s] * (v[s] - np.average(v[s], weights=weight[s])) ** 2).sum() for s in (on & (x[j] <= c), on & (x[j] > c)))  # noqa: B023, E731
                if tried == 6:
                    cuts = [(j, c) for j in range(6) for c in np.unique(x[j][on])[:-1] if min(weight[on & (x[j] <= c)].sum(), weight[on & (x[j] > c)].sum()) >= 3]
                    assert loss(feature[node], bins[node]) == pytest.approx(min(loss(*c) for c in cuts))
            at = np.where(feature[at] < 0, at, 2 * at + 1 + (x[feature[at], np.arange(3000)] > bins[at]))
        assert all(value[node] == pytest.approx(np.average(v[at == node], weights=weight[at == node])) for node in np.unique(at[weight > 0]))
        assert np.array_equal(trees.reach(x, tree, depth), value[at])


def test_many_nets_are_those_of_one_at_a_time():
    rnd = np.random.default_rng(3)
    x = np.column_stack([np.ones(30), rnd.normal(0, 1, (30, 3)), np.full(30, 2.0), rnd.normal(0, 1, 30)])
    x[:, 2] += x[:, 1]
    x[:, -1] += x[:, 1]
    many = (x.T @ x)[None] - x[:, :, None] * x[:, None, :]
    for penalty in ((0.001, 0.1), (0.1, 0.5), (1.0, 1.0)):
        assert np.allclose(L._shrunk_many(many, *penalty), [L._shrunk(g, *penalty) for g in many], rtol=1e-9, atol=1e-9)


def _betweenness_by_definition(n, e):
    """Of each node the share of the shortest paths between others that it is on, and its scaled closeness, from all pairs."""
    d, k = np.full((n, n), np.inf), np.zeros((n, n))
    np.fill_diagonal(d, 0)
    near = {}
    for a, b, w in e:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
        d[a, b] = d[b, a] = w
    for m in range(n):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1])
    for s in range(n):
        k[s, s] = 1
        for t in np.argsort(d[s]):
            if t != s and np.isfinite(d[s, t]):
                k[s, t] = sum(k[s, p] for p, w in near[t] if abs(d[s, p] + w - d[s, t]) < 1e-9)
    out = {v: sum(k[s, v] * k[v, t] / k[s, t] for s in range(n) for t in range(n) if len({s, v, t}) == 3 and np.isfinite(d[s, t]) and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9) / ((n - 1) * (n - 2)) for v in range(n)}
    far = {v: d[v][np.isfinite(d[v])] for v in range(n)}
    return out, {v: (len(f) - 1) ** 2 / f.sum() / (n - 1) for v, f in far.items()}


@pytest.mark.parametrize("seed", range(8))
def test_centrality_of_long_lines(spark, seed):
    """Only nodes where paths branch or end are searched from, and the result is that of all pairs: also with ties, rings and side lines."""
    rnd = random.Random(seed)
    n = 24
    e = {(i, i + 1): float(rnd.randint(1, 4)) if seed % 2 else rnd.uniform(0.5, 3) for i in range(n - 1) if i != 15 or seed > 3}
    for _ in range(seed // 2):
        e.setdefault(tuple(sorted(rnd.sample(range(n), 2))), float(rnd.randint(1, 3)))
    if seed == 7:
        e[0, n - 1] = 2.0
    edges = [(a, b, w) for (a, b), w in e.items()]
    between, close = _betweenness_by_definition(n, edges)
    assert len(N._core(edges)[1]) < n
    got = {r["id"]: r for r in N.centrality(spark.createDataFrame(edges, "src int, dst int, weight double")).collect()}
    assert len(got) == n and all(got[v]["betweenness"] == pytest.approx(between[v], abs=1e-9) and got[v]["closeness"] == pytest.approx(close[v]) for v in range(n))
