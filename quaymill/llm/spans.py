"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.operators.bloom import may_hold
from quaymill.session import attach, cut

#: Characters of a unit, and unit starts of which at least one is kept: a run of UNIT + WINDOW - 1 characters holds a kept unit.
UNIT, WINDOW = 75, 76
MIN_RUN = UNIT + WINDOW - 1
#: Places of an anchor up to which its texts are compared in pairs for the shares.
CROWD = 32
#: Characters of a text that are hashed at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


_made: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = CHUNK + MIN_RUN
    if n not in _made:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _made[n] = np.cumprod(up), np.cumprod(down)
    return _made[n]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over each ``w`` neighbours."""
    span = 1
    while span * 2 <= w:
        x, span = f(x[:-span], x[span:]), span * 2
    return f(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def units(text: str, unit: int = UNIT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Digests and offsets (in code points) of the kept units: those with the least digest of some ``window`` neighbouring starts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    digests, offsets = [], []
    step = CHUNK - (unit + window)
    for at in range(0, max(1, len(points) - (unit + window - 2)), step):
        c = points[at : at + CHUNK]
        n = len(c) - unit + 1
        if n < window:
            break
        up, down = _powers()
        total = np.cumsum((c + np.uint64(1)) * up[: len(c)])
        h = total[unit - 1 :].copy()
        h[1:] -= total[: n - 1]
        h *= down[:n]
        for s, m in ((32, 0xD6E8FEB86659FD93), (29, 0xD6E8FEB86659FD93)):
            h ^= h >> np.uint64(s)
            h *= np.uint64(m)
        h ^= h >> np.uint64(32)
        low = _slide(h, window, np.minimum)
        edge = np.zeros(window - 1, np.uint64)
        kept = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), window, np.maximum) == h)
        digests.append(h[kept])
        offsets.append(kept + at)
    if not digests:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h, p = np.concatenate(digests), np.concatenate(offsets)
    order = np.lexsort((p, h))
    h, p = h[order], p[order]
    # in a passage that repeats itself equal units overlap, in chains of one period. All within ``deep`` of a chain's ends are kept, farther in
    # one in each half window: there a whole run around a unit repeats itself, so that a kept unit a window from the ends finds it as well
    first = np.r_[True, (h[1:] != h[:-1]) | (p[1:] != p[:-1])] if len(h) else np.empty(0, bool)
    h, p = h[first], p[first]
    follows = np.r_[False, (h[1:] == h[:-1]) & (p[1:] - p[:-1] <= unit // 2)] if len(h) else first[:0]
    begins = np.flatnonzero(~follows)
    chain, deep = np.cumsum(~follows) - 1, window - 1 + unit // 2
    since = p - p[begins][chain]
    until = p[np.r_[begins[1:] - 1, len(p) - 1]][chain] - p if len(p) else since
    step = since // (window // 2)
    keep = ~((np.minimum(since, until) > deep) & np.r_[False, step[1:] == step[:-1]]) if len(p) else first
    return h[keep].view(np.int64), p[keep].astype(np.int32)


def _unit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, hs, ps = [], [], []
        for i, text in zip(b["doc"], b["text"]):
            h, p = units(text)
            ids.append(np.full(len(h), i, np.int64))
            hs.append(h)
            ps.append(p)
        yield pd.DataFrame({"doc": np.concatenate(ids or [np.empty(0, np.int64)]), "digest": np.concatenate(hs or [np.empty(0, np.int64)]), "pos": np.concatenate(ps or [np.empty(0, np.int32)])})


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (m, hi) if a[:m] == b[:m] else (lo, m)
    return lo


def _extent(left_a: pd.Series, left_b: pd.Series, right_a: pd.Series, right_b: pd.Series) -> pd.DataFrame:
    """Equal characters before a unit, and from its start on."""
    out = [(_common(la[::-1], lb[::-1]), _common(ra, rb)) for la, lb, ra, rb in zip(left_a, left_b, right_a, right_b)]
    return pd.DataFrame(out, columns=["back", "ahead"], dtype="int32")


def anchors(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Units found in two different texts, and exact copies.

    anchors ``(doc, digest, pos, left, right)``: offset of the unit, up to ``WINDOW - 1`` characters before
    it, up to ``MIN_RUN`` from its start on. Any run of ``MIN_RUN`` characters that two texts share holds a
    unit that is an anchor of both. copies ``(doc, rep)``: the texts of at least ``MIN_RUN`` characters that
    occur more than once, all their keys and the smallest one; only that one has anchors.

    A run may begin anywhere in a line, so units are cut by content, not at line ends: of all units of
    ``UNIT`` characters those with the least digest in a sliding window are kept, the same ones wherever
    the text stands. Digests are grouped globally. Null, empty and shorter texts have none. Keys must be
    unique and integer; whole texts of any length are used.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= MIN_RUN))
    marked = cut(rows.select("doc", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2")), "digests")
    classes = marked.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = cut(marked.join(classes, ["k1", "k2"]).select("doc", "rep"), "copies")
    extra = copies.where("doc <> rep").select("doc")
    own = rows.join(attach(extra), "doc", "left_anti")
    kept = cut(own.mapInPandas(_unit_batches, "doc bigint, digest bigint, pos int"), "units")
    shared = cut(kept.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("digest"), "shared")
    found = cut(may_hold(kept, "digest", shared).join(shared, "digest").select("doc", "digest", "pos"), "anchors")
    spots = found.groupBy("doc").agg(F.collect_list(F.struct("digest", "pos")).alias("spots"))  # at most a text's units
    around = (
        may_hold(own, "doc", cut(found.select("doc").distinct(), "with-anchors")).join(spots, "doc")
        .select("doc", "text", F.explode("spots").alias("s"))
        .select(
            "doc",
            "s.digest",
            "s.pos",
            F.substring("text", F.greatest(F.col("s.pos") - (WINDOW - 2), F.lit(1)), F.least(F.col("s.pos"), F.lit(WINDOW - 1))).alias("left"),
            F.substring("text", F.col("s.pos") + 1, F.lit(MIN_RUN)).alias("right"),
        )
    )
    return cut(around, "around"), copies


def shared_runs(around: DataFrame) -> DataFrame:
    """``(a, b, a_from, a_to, b_from, b_to)``, a < b: for two texts with a common anchor, the stretch around it, of at
    least ``MIN_RUN`` code points, that both have letter for letter; offsets from 0. Longer runs come in overlapping parts."""
    a, b = (around.select("digest", *(F.col(c).alias(f"{c}_{p}") for c in ("doc", "pos", "left", "right"))) for p in "ab")
    extent = F.pandas_udf(_extent, "struct<back:int,ahead:int>")
    pairs = a.join(b, "digest").where("doc_a < doc_b").withColumn("e", extent("left_a", "left_b", "right_a", "right_b"))
    pairs = pairs.where(f"e.ahead >= {UNIT} and e.back + e.ahead >= {MIN_RUN}")
    return pairs.select(
        F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), (F.col("pos_a") - F.col("e.back")).alias("a_from"), (F.col("pos_a") + F.col("e.ahead")).alias("a_to"),
        (F.col("pos_b") - F.col("e.back")).alias("b_from"), (F.col("pos_b") + F.col("e.ahead")).alias("b_to"),
    )


def shared_pairs(runs: DataFrame, copies: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: all pairs of keys whose texts share a run, copies with each other and with their text's partners."""
    pairs = cut(runs.select("a", "b").distinct(), "pairs")
    x, y = (copies.select(F.col("rep").alias(c), F.col("doc").alias(f"{c}_doc")) for c in "ab")
    wide = pairs.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("a_doc", "a").alias("a"), F.coalesce("b_doc", "b").alias("b"))
    same = copies.select("rep", F.col("doc").alias("a")).join(copies.select("rep", F.col("doc").alias("b")), "rep").where("a < b").select("a", "b")
    return wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same)


def shared_share(docs: DataFrame, key: str, text: str, around: DataFrame, copies: DataFrame) -> DataFrame:
    """``(doc, chars, shared_chars, share)`` for each key: characters inside runs of at least ``MIN_RUN`` that occur in another record too.

    Texts with a common anchor are compared in pairs as long as at most ``CROWD`` places have it. Of an
    anchor found more often no pair is formed: every stretch of ``MIN_RUN`` characters that holds it is
    hashed, and those that occur in two texts count; their union is the union of all shared runs. So a
    passage in a third of all records costs some rows per record and place, not pairs of records. Copies
    are shared as a whole. A null text has 0.
    """
    crowds = cut(around.groupBy("digest").count().where(F.col("count") > CROWD).select("digest"), "crowds")
    n = crowds.count()
    runs = cut(shared_runs(around.join(attach(crowds, n), "digest", "left_anti")), "runs")
    parts = runs.select(F.col("a").alias("doc"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).union(runs.select("b", "b_from", "b_to"))
    start = F.col("j")
    stretch = F.concat(F.substring("left", F.length("left") - start + 1, start), F.substring("right", F.lit(1), MIN_RUN - start))
    tried = around.join(attach(crowds, n), "digest", "left_semi").select("doc", "pos", "left", "right", F.explode(F.sequence(F.lit(0), F.least(F.length("left"), F.lit(MIN_RUN - UNIT)))).alias("j"))
    tried = tried.select("doc", (F.col("pos") - start).alias("lo"), stretch.alias("s")).where(F.length("s") == MIN_RUN)
    tried = cut(tried.select("doc", "lo", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit("second"), "s").alias("k2")), "stretches")
    several = tried.groupBy("k1", "k2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("k1", "k2")
    parts = parts.union(tried.join(several, ["k1", "k2"]).select("doc", "lo", F.col("lo") + MIN_RUN)).distinct()
    # parts overlap: of each only what lies beyond the furthest end before it is counted
    before = W.partitionBy("doc").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(before), F.lit(0))))
    covered = parts.withColumn("new", fresh).groupBy("doc").agg(F.sum("new").alias("covered"))
    sizes = docs.select(F.col(key).cast("bigint").alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("chars")).where("doc is not null")
    whole = copies.select("doc", F.lit(True).alias("copy"))
    found = sizes.join(whole, "doc", "left").join(covered, "doc", "left")
    return found.select("doc", "chars", F.when(F.col("copy"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars")).withColumn(
        "share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0))
    )


def _line_starts(texts: pd.Series) -> pd.Series:
    """Offset of each line, in one walk through the text."""

    def one(text: str) -> np.ndarray:
        sizes = np.array([len(x) + 1 for x in text.split("\n")], np.int64)
        return (np.cumsum(sizes) - sizes).astype(np.int32)

    return texts.map(one)


def repeated_units(docs: DataFrame, key: str, text: str, order: list[str], least: int = 40) -> DataFrame:
    """``(doc, unit, offset, chars, first_doc, kept)``: the lines of at least ``least`` characters that occur more than once.

    Lines are compared after lower-casing and reducing blanks. The earliest by (``order``, key, offset)
    is kept, the rest are marked for removal, with their offsets in the text as delivered.
    """
    rank = F.struct(*(F.col(c).isNull().alias(f"n{i}") for i, c in enumerate(order)), *order)
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), rank.alias("rank"), F.col(text).alias("text")).where("doc is not null and text is not null")
    lines = F.arrays_zip(F.split("text", "\n", -1).alias("line"), F.pandas_udf(_line_starts, "array<int>")("text").alias("at"))
    flat = rows.select("doc", "rank", F.posexplode(lines).alias("unit", "u")).select("doc", "rank", "unit", "u.line", "u.at")
    plain = F.trim(F.regexp_replace(F.lower("line"), r"(?U)\s+", " "))
    hashed = flat.where(F.length(plain) >= least).select("doc", "rank", "unit", "at", F.length("line").alias("chars"), F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit("second"), plain).alias("k2"))
    groups = hashed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("rank", "doc", "at")).alias("first")).where("n > 1").select("k1", "k2", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at"))
    return hashed.join(groups, ["k1", "k2"]).select("doc", "unit", F.col("at").alias("offset"), "chars", "first_doc", ((F.col("doc") == F.col("first_doc")) & (F.col("at") == F.col("first_at"))).alias("kept"))
