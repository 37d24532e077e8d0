from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymill.llm.mixing import budgets, mix
from quaymill.llm.packing import best_fit_decreasing, bins_needed, pack, packing_report
from quaymill.llm.tokens import VOCABULARY, encoding, with_tokens


def _fewest(sizes, capacity):
    """The fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] >= sizes[i]:
                go(i + 1, [*bins[:j], bins[j] - sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_fit(sizes):
    fewest = _fewest(sizes, 20) if sizes else 0
    assert bins_needed(np.bincount(sizes or [0], minlength=21) * (np.arange(max(21, 21)) > 0), 20) <= fewest
    bins = best_fit_decreasing(np.array(sizes, np.int64), 20)
    used = len(set(bins.tolist()))
    assert fewest <= used <= max(fewest * 1.5, fewest + 1)
    assert all(sum(s for s, b in zip(sizes, bins) if b == k) <= 20 for k in set(bins.tolist()))


CAPS = [("small", 10), ("large", 64)]


@pytest.mark.parametrize("items", [7, 100000])
def test_pack(spark, items):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 1, 3, 5, 7, 9, 10, 11, 25, 64, 130, None])) for i in range(500)]
    df = spark.createDataFrame(sizes, "id bigint, tokens int").withColumn("bin", F.lit("clash"))
    caps = spark.createDataFrame([*CAPS, (None, 5), ("zero", 0)], "container string, capacity int")
    got = pack(df, caps, items=items).collect()
    for name, c in CAPS:
        mine = [r for r in got if r["container"] == name]
        fill, pieces = {}, {}
        for r in mine:
            if r["bin_id"] is None:
                assert r["tokens"] == 0
                continue
            fill[r["bin_id"]] = fill.get(r["bin_id"], 0) + r["tokens"]
            pieces.setdefault(r["id"], []).append((r["piece"], r["tokens"]))
        assert max(fill.values()) <= c
        for i, t in sizes:
            if t:
                p = sorted(pieces[i])
                assert sum(x for _, x in p) == t and [k for k, _ in p] == list(range(-(-t // c)))
                assert all(x == c for _, x in p[:-1])
        assert {r["id"] for r in mine} == {i for i, _ in sizes}
        total = sum(t or 0 for _, t in sizes)
        report = {r["container"]: r for r in packing_report(pack(df, caps, items=items), caps).collect()}[name]
        assert report["bins"] == len(fill) >= report["bins_needed"] >= -(-total // c) and report["tokens"] == total
        if items > 7:
            assert report["bins"] - report["bins_needed"] <= 2


def test_exchange_never_needs_more_bins(spark):
    df = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(60)) + 1).cast("int").alias("tokens"))
    caps = spark.createDataFrame([("c", 100)], "container string, capacity int")
    bins = [pack(df, caps, items=40, exchanges=k).select("bin_id").distinct().count() for k in (0, 1, 3)]
    assert bins[0] >= bins[1] >= bins[2]
    ids = pack(df, caps, items=40, exchanges=3).groupBy("id").agg(F.sum("tokens").alias("t")).join(df, "id").where("t <> tokens")
    assert ids.count() == 0


def test_pack_nothing(spark):
    caps = spark.createDataFrame(CAPS, "container string, capacity int")
    assert pack(spark.createDataFrame([], "id bigint, tokens int"), caps).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], "id bigint, tokens int"), caps.limit(0)).count() == 0


def test_tokens(spark):
    texts = [None, "", "Hello world", "வண்ணாரப்பேட்டை " * 50, "<|endoftext|>", "a" * 40000, "  \n\t ", "\U0001f687 metro"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    e = encoding(VOCABULARY)
    got = {r["id"]: r["tokens"] for r in with_tokens(df, "text", ["id"]).collect()}
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for t in texts:
        assert not t or e.decode(e.encode_ordinary(t)) == t


def test_budgets():
    s = [{"source": "a", "share": 0.5, "cap": 100}, {"source": "b", "share": 0.3, "cap": 1000}, {"source": "c", "share": 0.2, "cap": 0}]
    b = budgets(s, None)
    assert b["a"] == pytest.approx(100) and b["b"] == pytest.approx(60) and b["c"] == 0
    b = budgets(s, 500)
    assert b["a"] == 100 and b["b"] == pytest.approx(400)
    assert budgets(s, 5000) == {"a": 100, "b": 1000, "c": 0}
    assert budgets([], None) == {} and budgets([s[2]], None) == {"c": 0.0}


def _records(spark):
    rnd = random.Random(4)
    rows = [(i, s, rnd.randint(1, 200), rnd.choice([0.1, 1.0, 5.0, None, float("nan"), -1.0])) for i in range(3000) for s in [("a" if i % 3 == 0 else rnd.choice(["b", "c", None, "other"]))]]
    rows += [(9000, "a", 0, 1.0), (None, "a", 10, 1.0), (9001, "b", None, 1.0)]
    return spark.createDataFrame(rows, "id bigint, source string, tokens int, weight double"), rows


def test_mix(spark):
    df, rows = _records(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("none", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df.withColumn("copies", F.lit("clash")), targets)
    got, rep = chosen.collect(), {r["source"]: r for r in report.collect()}
    most = {"a": 1, "b": 3, "c": 2}
    assert len(got) == len({r["id"] for r in got}) and all(1 <= r["copies"] <= most[r["source"]] for r in got)
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"]["selected_tokens"] == 0
    for s in "abc":
        tokens = sum(r["tokens"] * r["copies"] for r in got if r["source"] == s)
        assert tokens == rep[s]["selected_tokens"] and abs(tokens - rep[s]["budget_tokens"]) <= 101
        assert rep[s]["actual_share"] == pytest.approx({"a": 0.2, "b": 0.5, "c": 0.2}[s] / 0.9, abs=0.003)
        assert max(r["copies"] for r in got if r["source"] == s) - min([r["copies"] for r in got if r["source"] == s]) <= 1
        if rep[s]["budget_tokens"] >= rep[s]["available_tokens"]:  # complete epochs come first
            assert {r["id"] for r in got if r["source"] == s} == {r[0] for r in rows if r[1] == s and r[0] is not None and r[2]}


def test_the_fraction_is_what_sorting_gives(spark):
    """The histogram finds the records that a sort by exponential key and a prefix sum would."""
    df, _ = _records(spark)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mix(df, targets, total=20000.0)
    u = (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    w = F.coalesce(F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")), F.lit(1e-9))
    left, want = 20000.0, set()
    for r in sorted(df.where("source = 'a' and id is not null and tokens > 0").withColumn("key", -F.log(u) / w).collect(), key=lambda r: (r["key"], r["id"])):
        if left - r["tokens"] / 2 < 0:
            break
        want.add(r["id"])
        left -= r["tokens"]
    assert {r["id"] for r in chosen.collect()} == want


def test_heavier_records_come_first(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("source"), F.lit(10).alias("tokens"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(1.0).alias("weight"))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, _ = mix(df, targets, total=4000.0)
    share = chosen.where("id % 2 = 0").count() / chosen.count()
    assert share == pytest.approx(5 / 6, abs=0.06)


def test_mix_nothing(spark):
    df, _ = _records(spark)
    targets = spark.createDataFrame([("a", 0.2, 1)], "source string, target_share double, max_repeats int")
    for x, y in ((df.limit(0), targets), (df, targets.limit(0)), (df, targets.withColumn("max_repeats", F.lit(0)))):
        chosen, report = mix(x, y)
        assert chosen.count() == 0 and report.count() == y.count()


def test_prose_weighs_more_than_markup(spark):
    prose = " ".join(f"The guard {w} told riders near platform {i} that {w}ing trains would be late because of {w} works." for i, w in enumerate("north signal water power track cable tunnel bridge market depot".split()))
    texts = {"prose": prose, "tamil": " ".join(f"வண்ணாரப்பேட்டை {c}{d} நிலையம் கிண்டி{d}{c}" for c in "கசடதபற" for d in "அஆஇஈஉ"), "digits": "12 455 | 88 " * 60, "loop": "All aboard now please\n" * 90, "short": "Fine station", "glued": "x" * 4000, "tags": "<td><b>//</b></td> " * 50, "empty": "", "blank": " \n\u00a0\t", "null": None}
    df = spark.createDataFrame(list(texts.items()), "k string, text string")
    got = {r["k"]: r["weight"] for r in with_tokens(df, "text", ["k"], weight=True).collect()}
    assert got["prose"] > 0.8 and got["tamil"] > 0.5, got
    assert all(0.02 <= w <= 1 for w in got.values())
    assert all(got[k] < 0.3 * got["prose"] for k in texts if k not in ("prose", "tamil")), got
    assert got["empty"] == got["null"] == 0.02 >= got["blank"] - 0.01
