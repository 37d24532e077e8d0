"""Orphans, Bloom filter, proximity, imputation and the regular grid."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymill.functions.missing import no_number, no_text
from quaymill.operators import bloom
from quaymill.operators.impute import Field, filled_cases, impute
from quaymill.operators.orphans import orphan_references
from quaymill.operators.proximity import EARTH_M, inside, located, near_pairs
from quaymill.operators.regrid import daily_grid, regular_grid, smooth

D = dt.date


@pytest.mark.parametrize("text,missing", [(None, True), ("", True), ("   ", True), ("-", True), ("N/A", True), ("unknown line", True), ("TBD", True), (" nan ", True), ("Line", True), ("Blue Line 1", False), ("Nandanam", False), ("நீல வழி", False)])
def test_no_text(spark, text, missing):
    assert spark.createDataFrame([(text,)], "c string").select(no_text(F.col("c"))).first()[0] is missing


def test_no_number(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (-999.0,), (9999999.0,), (0.0,), (12.5,), (float("inf"),)], "c double")
    assert [r[0] for r in df.select(no_number(F.col("c"), 1e6)).collect()] == [True, True, True, True, True, False, False, True]


def test_bloom_never_misses_and_stays_small(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    words = bloom.words_for(5000)
    assert bloom.build(keys, "k", words).count() <= words / bloom.BLOCK
    tried = bloom.probe(spark.range(70000).select(F.col("id").alias("k")), "k", keys, "k", words, "hit")
    assert tried.where("k % 7 = 0 and k < 35000 and not hit").count() == 0
    assert tried.where("hit").count() < 5000 + 0.01 * 65000


def test_bloom_at_many_keys(spark):
    """The words a key has at 33 and at 42 million keys, and no filter where none would help."""
    assert bloom.words_for(33_000_000) == bloom.words_for(bloom.MOST_KEYS) == bloom.MAX_WORDS and bloom.words_for(bloom.MOST_KEYS + 1) == 0
    for millions, passed in ((33, 0.006), (42, 0.012)):
        words = 1 << 10
        keys = spark.range(millions * 1_000_000 * words // bloom.MAX_WORDS).select(F.col("id").alias("own"))
        tried = bloom.probe(spark.range(1_000_000, 1_200_000).select(F.col("id").alias("k")), "k", keys, "own", words, "hit")
        assert tried.where("hit").count() < passed * 200_000
    assert bloom.probe(spark.range(9), "id", spark.range(0).select(F.col("id").alias("own")), "own", 0, "hit").where("hit").count() == 9


def test_orphans(spark, rows):
    child = spark.createDataFrame(
        [(1, "a", D(2025, 1, 5), 0), (2, "x", D(2025, 1, 5), 0), (3, None, D(2025, 1, 5), 0), (4, "a", D(2024, 1, 1), 0), (5, "b", D(2025, 6, 1), 0), (6, "b", D(2025, 5, 31), 0), (7, "x", None, 0), (8, "A", D(2025, 1, 5), 0), (2, "x", D(2025, 1, 5), 0), (9, "", D(2025, 2, 5), 0)],
        "rid bigint, k string, d date, kind int",
    )
    parent = spark.createDataFrame([("a", D(2025, 1, 1), None), ("a", D(2024, 6, 1), None), ("b", D(2020, 1, 1), D(2025, 6, 1)), (None, D(2020, 1, 1), None)], "k string, lo date, hi date")
    got = rows(orphan_references(child, "k", "rid", "d", parent, "k", "lo", "hi"))
    assert got == sorted(
        [("2025-01", 2, "missing"), ("2025-01", 2, "missing"), ("2024-01", 4, "later"), ("2025-06", 5, "deleted"), (None, 7, "missing"), ("2025-01", 8, "missing"), ("2025-02", 9, "missing")], key=repr
    )
    assert orphan_references(child.limit(0), "k", "rid", "d", parent, "k", "lo", "hi").count() == 0
    assert orphan_references(child, "k", "rid", "d", parent.limit(0), "k", "lo", "hi").count() == 9


def test_orphans_of_a_hot_key(spark):
    child = spark.range(20000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(D(2025, 1, 1)).alias("d"))
    parent = child.where("rid % 2 = 0").select("k")
    got = orphan_references(child, "k", "rid", "d", parent, "k")
    want = child.join(parent.distinct(), "k", "left_anti")
    assert got.count() == want.count()


def test_located_repairs_only_what_leaves_no_doubt(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame(
        [("ok", 12.5, 80.1), ("swap", 80.1, 12.5), ("sign", 12.5, -80.1), ("micro", 12.5e6, 80.1e6), ("zero", 0.0, 0.0), ("nan", nan, 80.1), ("null", None, 80.1), ("both", nan, nan), ("twice", None, None), ("twice", 12.5, 80.1), ("off", 40.0, 80.0), (None, 12.5, 80.1)],
        "station_id string, latitude double, longitude double",
    )
    got = located(df, "station_id", "latitude", "longitude", (8.0, 23.0, 72.0, 88.0))
    assert {r[0] for r in rows(got)} == {"ok", "swap", "sign", "micro", "twice"}
    assert all(math.isclose(r[1], 12.5) and math.isclose(r[2], 80.1) for r in rows(got))


def _metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize("lat0,lon0,size", [(13.0, 80.2, 0.02), (0.0, 179.995, 0.01), (-89.99, 10.0, 0.01), (60.0, -180.0, 0.02)])
def test_near_pairs_against_all_pairs(spark, lat0, lon0, size):
    rnd = random.Random(5)
    pts = [(f"s{i:03d}", lat0 + rnd.uniform(0, size), (lon0 + rnd.uniform(0, size * 2) + 180) % 360 - 180) for i in range(150)]
    pts += [("s900", *pts[0][1:]), ("s901", *pts[0][1:])]  # the same place
    df = spark.createDataFrame([*pts, ("sx", None, 80.0), ("sy", float("nan"), 80.0)], "id string, lat double, lon double")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and _metres(a, b) <= 250}
    assert {(r[0], r[1]) for r in near_pairs(df, 250.0).collect()} == want and want
    assert near_pairs(df.limit(0), 250.0).count() == 0


def test_inside(spark, rows):
    square = [("sq", 0.0, 0.0, 0.0, 4.0), ("sq", 0.0, 4.0, 4.0, 4.0), ("sq", 4.0, 4.0, 4.0, 0.0), ("sq", 4.0, 0.0, 0.0, 0.0)]
    tri = [("tri", 0.0, 0.0, 3.0, 5.0), ("tri", 3.0, 5.0, 3.0, 0.0), ("tri", 3.0, 0.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square + tri, "region string, lat1 double, lon1 double, lat2 double, lon2 double")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.9, 4.5), (3, 5.0, 5.0), (4, None, 1.0), (5, 2.0, 1.0)], "id int, lat double, lon double")
    assert rows(inside(pts, edges, 0.5)) == sorted([(1, "sq"), (1, "tri"), (2, "tri"), (5, "sq"), (5, "tri")], key=repr)


FIELDS = [Field("a", True, lambda c: no_number(c, 1e6), 1e6), Field("n", True, lambda c: no_number(c, 5000), 5000, whole=True), Field("line", False, no_text)]


def _stations(spark, n=600):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        g = i % 3
        h = rnd.gauss(10 * g, 1)
        a, c, line = 1000 + 50 * h + rnd.gauss(0, 5), max(0, int(5 + g * 3 + rnd.gauss(0, 1))), f"L{g}"
        if i % 11 == 0:
            a = [None, float("nan"), -1.0, 9999999.0][i % 4]
        if i % 13 == 0:
            c = [None, -1, 9999][i % 3]
        if i % 17 == 0:
            line = [None, " ", "TBD", "unknown line"][i % 4]
        out.append((f"k{i}", a, c, line, h, "p1", i))
    return spark.createDataFrame(out, "id string, a double, n int, line string, h double, phase string, a_missing int")


def test_imputation(spark):
    df = _stations(spark)
    got = {r["id"]: r for r in impute(df.union(df), "id", FIELDS, ["h"], ["phase"]).collect()}
    assert len(got) == 600
    for r in df.collect():
        o = got[r["id"]]
        i = r["a_missing"]
        assert o["a_missing"] == (i % 11 == 0) == o["a_filled"] and o["n_missing"] == (i % 13 == 0) and o["line_missing"] == (i % 17 == 0)
        assert o["a"] is not None and o["n"] is not None and o["line"] in ("L0", "L1", "L2")
        if not o["a_missing"]:
            assert o["a"] == r["a"]
    gaps = [(r, got[r["id"]]) for r in df.collect() if r["a_missing"] % 11 == 0]
    assert np.corrcoef([1000 + 50 * r["h"] for r, _ in gaps], [o["a"] for _, o in gaps])[0, 1] > 0.98
    assert len({round(o["a"] - 50 * r["h"], 3) for r, o in gaps}) > len(gaps) / 2  # residual variation
    lines = [(f"L{r['a_missing'] % 3}", got[r["id"]]["line"]) for r in df.collect() if r["a_missing"] % 17 == 0]
    assert sum(a == b for a, b in lines) > 0.6 * len(lines)
    again = {r["id"]: tuple(r) for r in impute(df, "id", FIELDS, ["h"], ["phase"]).collect()}
    assert again == {k: tuple(v) for k, v in got.items()}
    cases = filled_cases(impute(df, "id", FIELDS, ["h"], ["phase"]), "id", ["a", "n", "line"])
    assert cases.where("field = 'a'").count() == len(gaps)


def test_imputation_draws_every_class_by_its_share(spark):
    """1,500 equal classes, and classes of one row beside one of thousands."""
    even = [(f"k{i}", 1.0, f"L{i % 1500:04}" if i < 6000 else None, "p1") for i in range(36000)]
    schema = "id string, a double, line string, phase string"
    got = impute(spark.createDataFrame(even, schema), "id", [FIELDS[0], FIELDS[2]], [], ["phase"], rounds=1)
    drawn = [r["count"] for r in got.where("line_filled").groupBy("line").count().collect()]
    assert got.where("line is null").count() == 0 and len(drawn) == 1500 and max(drawn) < 50
    sizes = {f"L{i:03}": 1 + i % 7 for i in range(300)} | {"L999": 3000}
    rows = [(f"d{line}{k}", 1.0, line, "p1") for line, n in sizes.items() for k in range(n)] + [(f"g{i}", 1.0, None, "p1") for i in range(20000)]
    got = impute(spark.createDataFrame(rows, schema), "id", [FIELDS[0], FIELDS[2]], [], ["phase"], rounds=1)
    drawn = {r["line"]: r["count"] for r in got.where("line_filled").groupBy("line").count().collect()}
    share = 20000 / sum(sizes.values())
    assert set(drawn) == set(sizes) and abs(drawn["L999"] - 3000 * share) < 300
    assert all(abs(drawn[x] - n * share) < 6 * (n * share) ** 0.5 for x, n in sizes.items() if x != "L999")


def test_imputation_takes_classes_of_the_same_block(spark):
    rows = [(f"k{i}", 1.0, f"{'AB'[i % 2]}{i % 10}", f"p{i % 2}") for i in range(400)] + [(f"g{i}", 1.0, None, f"p{i % 3}" if i % 4 else None) for i in range(300)]
    got = impute(spark.createDataFrame(rows, "id string, a double, line string, phase string"), "id", [FIELDS[0], FIELDS[2]], [], ["phase"])
    found = {(r["id"], r["line"][0]) for r in got.where("line_filled").collect()}
    of = {i: p for i, _, _, p in rows}
    assert len(found) == 300 and all(c == {"p0": "A", "p1": "B"}[of[i]] for i, c in found if of[i] in ("p0", "p1"))
    assert {c for i, c in found if of[i] not in ("p0", "p1")} == {"A", "B"}


def test_classes_in_several_passes(spark, monkeypatch):
    """More classes than a task holds at once: the best of the passes is that of one."""
    from quaymill.operators import impute as module

    df = _stations(spark)
    whole = {tuple(r) for r in impute(df, "id", FIELDS, ["h"], ["phase"]).collect()}
    monkeypatch.setattr(module, "BROADCAST_ROWS", 1)
    assert {tuple(r) for r in impute(df, "id", FIELDS, ["h"], ["phase"]).collect()} == whole


def test_imputation_beats_mean_and_mode(spark):
    """Values hidden from the operator: nearer than the mean, classes oftener right than the commonest, and draws as spread as the truth."""
    rnd = np.random.default_rng(5)
    n = 3000
    line = rnd.choice(8, n, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])
    h = rnd.normal(line * 0.8, 1.0)
    a = 1000 + 200 * h + 100 * (line % 3) + rnd.normal(0, 150, n)
    k = np.round(np.maximum(0, 10 + 2 * h - 0.002 * a + rnd.normal(0, 1.5, n)))
    hide = rnd.random((3, n)) < 0.1
    rows = [(f"k{i}", None if hide[0, i] else float(a[i]), None if hide[1, i] else int(k[i]), None if hide[2, i] else f"L{line[i]}", float(h[i]), "p1") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, a double, n int, line string, h double, phase string")
    best, drawn = ({r["id"]: r for r in impute(df, "id", FIELDS, ["h"], ["phase"], draw=d).collect()} for d in (False, True))
    for c, truth, m in (("a", a, hide[0]), ("n", k, hide[1])):
        guess, loose = (np.array([x[f"k{i}"][c] for i in np.flatnonzero(m)]) for x in (best, drawn))
        error, plain = np.sqrt(np.mean((guess - truth[m]) ** 2)), np.sqrt(np.mean((truth[~m].mean() - truth[m]) ** 2))
        assert error < 0.75 * plain and 0.85 < loose.std() / truth[m].std() < 1.15
    right = np.mean([best[f"k{i}"]["line"] == f"L{line[i]}" for i in np.flatnonzero(hide[2])])
    assert right > np.mean(line[hide[2]] == 0) + 0.08


def test_imputation_of_nothing_and_of_all(spark):
    df = _stations(spark, 30)
    assert impute(df.limit(0), "id", FIELDS, ["h"], ["phase"]).count() == 0
    none = impute(df.withColumn("a", F.lit(None).cast("double")), "id", FIELDS, ["h"], ["phase"])
    assert none.where("a is null and a_missing and not a_filled").count() == 30
    alone = impute(df, "id", FIELDS, [], [])
    assert alone.where("a is null or line is null").count() == 0


def test_smoother_finds_a_trend():
    t = np.arange(60.0)[None, :]
    y = 100 + 3 * t + np.random.default_rng(0).normal(0, 2, t.shape)
    y[0, 20:30] = np.nan
    mean, sd = smooth(np.ascontiguousarray(t), y, np.ones_like(y))
    assert np.abs(mean[0] - (100 + 3 * t[0])).max() < 6
    assert sd[0, 24] > sd[0, 10] > 0


def test_regular_grid(spark):
    r = [("a", 0.0, 5.0), ("a", 3.5, 8.0), ("a", 3.7, 10.0), ("b", 7.2, 1.0), (None, 1.0, 1.0), ("c", None, 1.0), ("c", 1.0, float("nan")), ("d", 1.0, 0.0), ("d", 4.0, 0.0)]
    got = {(x["source"], x["slot"]): x for x in regular_grid(spark.createDataFrame(r, "source string, t double, y double")).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 7), *(("d", i) for i in range(1, 5))}
    assert [got["a", i]["is_missing"] for i in range(4)] == [False, True, True, False]
    assert got["a", 3]["reading"] == 9.0 and got["a", 1]["reading"] is None and got["b", 7]["sd"] > 0
    assert abs(got["d", 2]["smoothed"]) < 1e-6
    assert regular_grid(spark.createDataFrame([], "source string, t double, y double")).count() == 0


def test_daily_grid_takes_the_latest_reading(spark):
    df = spark.createDataFrame(
        [("s", D(2025, 1, 1), 5, False, 1), ("s", D(2025, 1, 1), 7, False, 2), ("s", D(2025, 1, 3), 9, True, 3), ("s", D(2025, 1, 4), -3, False, 4), ("s", D(2025, 1, 5), 11, False, 5), ("s", D(1925, 1, 1), 1, True, 6), ("s", None, 4, False, 7), ("s", D(2025, 1, 6), None, False, 8)],
        "src string, date date, v bigint, is_partial boolean, value int",
    )
    usable = ~F.col("is_partial") & (F.col("v") >= 0)
    got = {x["day"]: x for x in daily_grid(df, "src", "date", "v", usable, ["value"]).collect()}
    assert sorted(got) == [D(2025, 1, i) for i in range(1, 6)] and got[D(2025, 1, 1)]["value"] == 7
    assert [got[D(2025, 1, i)]["is_missing"] for i in range(1, 6)] == [False, True, True, True, False]


def test_a_hot_source_stays_small(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), (F.col("id") % 40).cast("double").alias("t"), (F.col("id") % 7).cast("double").alias("y"))
    got = regular_grid(df)
    assert got.where("source = 'hot'").count() == 40
