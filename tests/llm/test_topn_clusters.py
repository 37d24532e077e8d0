from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymill.llm.clusters import cluster, describe
from quaymill.llm.topn import top_n_per_group


def _top(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(s, best[g].get(i, float("-inf")))
    return sorted(((g, k + 1, i, s) for g, items in best.items() for k, (s, i) in enumerate(sorted(((s, i) for i, s in items.items()), key=lambda x: (-x[0], x[1]))[:n]) for i, s in [(i, s)]), key=repr)


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n(spark, rows, n):
    rnd = random.Random(n)
    data = [(rnd.choice(["g1", "g2", "g3", None]), rnd.choice([f"i{k:03d}" for k in range(200)] + [None]), rnd.choice([None, float("nan"), 0.0, -5.0, float("inf"), float("-inf"), *(rnd.gauss(0, 1000) for _ in range(6))])) for _ in range(3000)]
    data += [("tied", f"t{k:04d}", 7.0) for k in range(2000)]  # one group of equal scores
    data += [("one", "x", 1.0)] * 50  # repeated rows
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "g string, i string, s double, rk int, __item int")
    assert rows(top_n_per_group(df, ["g"], "i", "s", n)) == _top(data, n)


def test_top_n_of_a_hot_group_drops_rows_before_the_sort(spark):
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), F.col("id").alias("i"), (F.col("id") * 7919 % 60000).cast("double").alias("s"))
    got = top_n_per_group(df, ["g"], "i", "s", 5)
    want = sorted((r["s"], r["i"]) for r in df.where("g = 'hot'").collect())[-5:]
    assert sorted((r["s"], r["i"]) for r in got.where("g = 'hot'").collect()) == want


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], "g string, h string, i string, s double")
    assert top_n_per_group(df, ["g", "h"], "i", "s", 3).columns == ["g", "h", "rk", "i", "s"]
    assert top_n_per_group(df, ["g", "h"], "i", "s", 3).count() == 0


LIMITS = {"a": 10.0, "b": 1.0}


def _classes(points):
    parent = {k: k for k, *_ in points}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a, b in points:
        for m, c, d in points:
            if abs(a - c) <= 10 and abs(b - d) <= 1:
                x, y = sorted((find(k), find(m)))
                parent[y] = x
    return sorted((k, find(k)) for k in parent)


def test_clusters_are_the_classes_of_a_transitive_likeness(spark):
    rnd = random.Random(3)
    points = []
    for c in range(60):
        a, b = (c % 8) * 25 + rnd.uniform(-1, 1), (c // 8) * 3 + rnd.uniform(-0.1, 0.1)
        points += [(f"k{c:02d}{j:03d}", a + rnd.uniform(-4.9, 4.9), b + rnd.uniform(-0.49, 0.49)) for j in range(rnd.choice([1, 2, 3, 30]))]
    points += [(f"z{j:04d}", 500.0, 50.0) for j in range(400)]  # copies: a third of all
    df = spark.createDataFrame([*points, *points[:50], ("n1", None, 1.0), ("n2", float("nan"), 1.0), (None, 1.0, 1.0)], "id string, a double, b double").withColumn("cluster", F.lit("clash"))
    members, _ = cluster(df, "id", LIMITS)
    assert sorted((r["key"], r["cluster"]) for r in members.collect()) == _classes(points)
    sizes = {r["cluster"]: r["size"] for r in describe(members, [10.0, 1.0]).collect()}
    assert sizes["z0000"] == 400 and min(sizes.values()) > 1


def _average_linkage(points, limits):
    """One merge at a time, by the mean similarity of all pairs."""
    sim = lambda x, y: max(0.0, 1 - 0.5 * max(abs(p - q) / t for p, q, t in zip(x[1:], y[1:], limits)) ** 2)
    groups = [[p] for p in points]
    while True:
        mean = {(i, j): sum(sim(x, y) for x in groups[i] for y in groups[j]) / (len(groups[i]) * len(groups[j])) for i in range(len(groups)) for j in range(i + 1, len(groups))}
        i, j = max(mean, key=mean.get, default=(0, 0))
        if not mean or mean[i, j] < 0.5:
            return sorted((p[0], min(q[0] for q in g)) for g in groups for p in g)
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("seed,spread", [(1, 60.0), (2, 25.0), (4, 120.0)])
def test_clusters_are_those_of_average_linkage(spark, seed, spread):
    """Where being alike isn't transitive, and wherever the grid starts."""
    rnd = random.Random(seed)
    points = [(f"k{i:03d}", rnd.uniform(0, spread), rnd.uniform(0, spread / 10)) for i in range(60)]
    points += [(f"z{i}", *points[3][1:]) for i in range(5)]
    want = _average_linkage(points, LIMITS.values())
    assert len({c for _, c in want}) > 1
    for off in (0.0, -1233.3):
        df = spark.createDataFrame([(k, a + off, b - off) for k, a, b in points], "id string, a double, b double")
        assert sorted((r["key"], r["cluster"]) for r in cluster(df, "id", LIMITS)[0].collect()) == want


@pytest.mark.parametrize("off", [0.0, 0.3, -7.01])
def test_clusters_do_not_depend_on_the_grid(spark, off):
    df = spark.createDataFrame([("a", off), ("b", 0.98 + off), ("c", 1.02 + off)], "id string, x double")
    assert {r["key"]: r["cluster"] for r in cluster(df, "id", {"x": 1.0})[0].collect()} == {"a": "a", "b": "b", "c": "b"}


def test_crowded_chains_of_records(spark):
    """More different records in a cell than are compared one by one, and no clear end."""
    df = spark.range(3000).select(F.format_string("k%05d", "id").alias("id"), (F.col("id") * 0.01).alias("a"), F.lit(0.0).alias("b"))
    members, _ = cluster(df, "id", LIMITS)
    spans = [r["w"] for r in members.groupBy("cluster").agg((F.max("x0") - F.min("x0")).alias("w")).collect()]
    assert members.count() == 3000 and max(spans) < 20 and 2 <= len(spans) <= 6


def _linkage_of_many(points, limits):
    """``_average_linkage`` on a matrix of sums."""
    x = np.array([p[1:] for p in points]) / np.array(list(limits))
    w = np.maximum(0, 1 - 0.5 * np.abs(x[:, None] - x[None]).max(2) ** 2)
    np.fill_diagonal(w, -1)
    n, least, live = np.ones(len(x)), [p[0] for p in points], np.arange(len(x))
    groups = {i: [i] for i in live}
    while len(live) > 1:
        mean = w[np.ix_(live, live)] / np.outer(n[live], n[live])
        i, j = live[list(np.unravel_index(mean.argmax(), mean.shape))]
        if mean.max() < 0.5:
            break
        w[i] += w[j]
        w[:, i] = w[i]
        w[i, i] = -1e9
        n[i] += n[j]
        groups[i] += groups.pop(j)
        live = live[live != j]
    return sorted((least[k], min(least[m] for m in g)) for g in groups.values() for k in g)


@pytest.mark.parametrize("n", [200, 600])
def test_clusters_are_exact_however_crowded_a_cell_is(spark, n):
    rnd = random.Random(n)
    points = [(f"k{i:04d}", rnd.uniform(0, 9.99), rnd.uniform(0, 0.99)) for i in range(n)] + [(f"m{i:03d}", rnd.uniform(10, 26), rnd.uniform(-1, 2)) for i in range(60)]
    want = _linkage_of_many(points, LIMITS.values())
    assert len({c for _, c in want}) > 2
    df = spark.createDataFrame(points, "id string, a double, b double")
    assert sorted((r["key"], r["cluster"]) for r in cluster(df, "id", LIMITS)[0].collect()) == want


def test_clusters_broadcast_no_side_beyond_the_limit(spark, monkeypatch):
    """Not even where the files of a step are small."""
    from quaymill.llm import clusters

    monkeypatch.setattr(clusters, "SIDE_ROWS", 0, raising=False)
    monkeypatch.setattr(clusters, "cut", lambda df, name="step", real=clusters.cut: (plans.append((name, df._jdf.queryExecution().executedPlan().toString(), df)), real(df, name))[1])
    plans: list = []
    rnd = random.Random(5)
    df = spark.createDataFrame([(f"k{i:03d}", rnd.uniform(0, 300), rnd.uniform(0, 9)) for i in range(200)], "id string, a double, b double")
    members, _ = cluster(df, "id", LIMITS)
    assert members.count() == 200
    wide = [name for name, plan, _ in plans if "BroadcastExchange" in plan]
    assert not wide and "BroadcastExchange" not in members._jdf.queryExecution().executedPlan().toString()


def test_clusters_of_nothing(spark):
    members, _ = cluster(spark.createDataFrame([], "id string, a double, b double"), "id", LIMITS)
    assert members.count() == 0 and describe(members, [10.0, 1.0]).count() == 0


def test_describe_ties(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0), ("y", 2.0, 0.0), ("w", 1.0, 0.0)], "id string, a double, b double")
    got = sorted((r["cluster"], r["size"], r["rk"], r["key"]) for r in describe(cluster(df, "id", LIMITS)[0], [10.0, 1.0], 2).collect())
    assert got == [("w", 3, 1, "w"), ("w", 3, 2, "x")]
