"""Forests and boosting on binned columns, all fits of a comparison in one pass over the rows.

A library fit costs several jobs a tree level or boosting round. Here each task receives every row once, a byte a feature, and makes its share
of all trees of all folds; what it holds is the binned table, some 25 bytes a row with six features, and copies of it for the fold and tree at hand. Draws go by the rows' keys and rows are
sorted by them, so that a fit doesn't depend on how rows are spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bins of a feature, between quantiles; all values of up to so many rows.
BINS = 256
FOREST_DEPTH, FOREST_LEAST = 6, 3
BOOST_DEPTH, BOOST_STEP, BOOST_SHARE = 2, 0.05, 0.8
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def cut_points(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last, by quantiles of all rows: no target is looked at."""
    probs = [i / BINS for i in range(BINS + 1)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), probs, 20_000).alias(f"f{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(v if v is not None else [0.0], float))[:-1] for v in row]


def _draws(keys: np.ndarray, turn: int) -> np.ndarray:
    """A fixed draw of each 64-bit key in a turn, even over the whole numbers below 2 ** 53."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    part = np.empty_like(z)
    for shift, factor in _MIX:
        z ^= np.right_shift(z, np.uint64(shift), out=part)
        z *= np.uint64(factor)
    z ^= np.right_shift(z, np.uint64(31), out=part)
    z >>= np.uint64(11)
    return z


#: A Poisson draw of mean 1 is the number of these below an even one.
_STEPS = [np.uint64(int(s * (1 << 53))) for s in np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])]


def _poisson(keys: np.ndarray, turn: int) -> np.ndarray:
    z, out = _draws(keys, turn), np.zeros(len(keys), np.uint8)
    for s in _STEPS:
        out += z > s
    return out


def by_row(codes: np.ndarray) -> np.ndarray:
    """``codes`` (features x rows) as rows of whole words, with at least one free byte at the end: a row is then copied at once."""
    out = np.zeros((codes.shape[1], (len(codes) // 8 + 1) * 8), np.uint8)
    out[:, : len(codes)] = codes.T
    return out


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: float, tried: int, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree ``(feature, bin, value)`` by node, children of ``i`` at ``2 i + 1`` and ``2 i + 2``; feature -1 ends.

    ``codes`` is features x rows, ``w`` how often each row counts, a small whole number. Each node takes the split of ``tried`` drawn
    features that leaves the least squares, with a weight of at least ``least`` on both sides; codes up to ``bin`` go left.
    """
    return _grow(by_row(codes), len(codes), y, w, depth, least, tried, rnd)


def _grow(rows: np.ndarray, k: int, y: np.ndarray, w: np.ndarray, depth: int, least: float, tried: int, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grow`` on the ``k`` features of ``by_row``. A node sums only features that it has drawn, over its own rows; of two children the larger is
    what the smaller leaves of their parent, where the parent has been summed."""
    size = 2 ** (depth + 1) - 1
    feature, bins, value = np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)
    here = np.flatnonzero(w)
    rows, often, tried = rows.take(here, axis=0), w.take(here).astype(np.uint8), min(tried, k)
    y = y.take(here) * often
    once, total = often.max(initial=1) == 1, float(often.sum(dtype=np.int64))
    rows[:, -1] = often
    value[0] = float(y.sum()) / total if total else 0.0

    def sums(features, rows: np.ndarray, y: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each bin of the features, the weight and the weighted sum of the target, which ``y`` has times the weight."""
        weight = None if once else rows[:, -1].astype(float)
        codes = {j: rows[:, j].astype(np.intp) for j in features}
        return {j: (np.bincount(c, weight, BINS).astype(float, copy=False), np.bincount(c, y, BINS)) for j, c in codes.items()}

    level = [(None, [(0, rows, y)])] if len(here) else []  # sums of a parent, then its children from the smaller on
    for deep in range(depth):
        if not level:
            break
        n, first = 2**deep, 2**deep - 1
        ranks = rnd.random((k, n)).argsort(0).argsort(0) if tried < k else np.zeros((k, n))
        nodes, known, drawn = [], [], []
        for parent, children in level:
            own = [np.flatnonzero(ranks[:, node - first] < tried).tolist() for node, _, _ in children]
            found = [sums({*own[0]} | {j for j in own[-1] if parent and j in parent}, *children[0][1:])]
            if parent is not None:
                rest = {j: (parent[j][0] - s[0], parent[j][1] - s[1]) for j, s in found[0].items() if j in parent}
                for s in rest.values():
                    s[1][s[0] == 0] = 0.0  # no rows, no sum
                found.append(rest | sums([j for j in own[1] if j not in rest], *children[1][1:]))
            nodes, known, drawn = nodes + children, known + found, drawn + own
        level = []
        cw, cs = np.array([[s[j] for j in own] for s, own in zip(known, drawn)]).cumsum(3).transpose(2, 0, 1, 3)
        tw, ts = cw[..., -1:], cs[..., -1:]
        rw, rs = tw - cw, ts - cs
        ok = (cw >= max(least, 1e-9)) & (rw >= max(least, 1e-9))
        g = np.where(ok, cs**2 / np.where(ok, cw, 1) + rs**2 / np.where(ok, rw, 1) - ts**2 / np.maximum(tw, 1e-300), -np.inf)
        where = g.argmax(2)
        gain = np.take_along_axis(g, where[..., None], 2)[..., 0]
        for i, (node, rows, y) in enumerate(nodes):
            c = gain[i].argmax()
            if not gain[i, c] > 1e-12:
                continue
            j, b = drawn[i][c], where[i, c]
            lw, ls = cw[i, c, b], cs[i, c, b]
            feature[node], bins[node] = j, b
            value[2 * node + 1], value[2 * node + 2] = ls / lw, (ts[i, c, 0] - ls) / (tw[i, c, 0] - lw)
            if deep + 1 < depth:
                over = rows[:, j] > b
                sides = [(2 * node + 1, np.flatnonzero(~over)), (2 * node + 2, np.flatnonzero(over))]
                level.append((known[i], [(at, rows.take(of, axis=0), y.take(of)) for at, of in sorted(sides, key=lambda side: len(side[1]))]))
    return feature, bins, value


#: The place of the first bit of a byte that is set.
_FIRST_BIT = np.array([max(0, (i & -i).bit_length() - 1) for i in range(256)])


def reach(codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """The tree's value for each row of ``codes`` (features x rows), for a ``depth`` of at most 6.

    Each feature's code tells which leaves it rules out, as bits; the first leaf that none rules out is the row's.
    """
    feature, bins, value = tree
    kind, leaves = (np.uint8, 2**depth) if depth <= 3 else (np.uint64, 2**depth)
    full, last = (1 << leaves) - 1, np.zeros(leaves)
    open_: dict[int, np.ndarray] = {}
    todo = [(0, 0, leaves)]
    while todo:
        node, at, wide = todo.pop()
        if wide == 1 or feature[node] < 0:
            last[at : at + wide] = value[node]
            continue
        masks = open_.setdefault(int(feature[node]), np.full(BINS, full, kind))
        masks[bins[node] + 1 :] &= kind(full & ~(((1 << wide // 2) - 1) << at))
        todo += [(2 * node + 1, at, wide // 2), (2 * node + 2, at + wide // 2, wide // 2)]
    if not open_:
        return np.full(codes.shape[1], value[0])
    left = None
    for j, masks in open_.items():
        m = masks.take(codes[j])
        left = m if left is None else np.bitwise_and(left, m, out=left)
    if kind is np.uint8:
        return last.take(_FIRST_BIT % leaves).take(left)
    left &= ~left + np.uint64(1)
    return last.take((left.astype(float).view(np.int64) >> 52) - 1023)  # a power of two's exponent


def _forest_part(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, keys: np.ndarray, folds: np.ndarray, trees: int, turn: int, turns: int, seed: int) -> np.ndarray:
    """Sums over this turn's share of the trees, for the rows that a fold leaves out."""
    tried = max(1, math.ceil(len(codes) ** 0.5))
    out = np.zeros(len(y))
    for i, f in enumerate(folds):
        mine = [n for n in range(i * trees, (i + 1) * trees) if n % turns == turn]
        if not mine:
            continue
        out_rows, rows = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        held, seen, target, own = codes.take(out_rows, axis=1), by_row(codes.take(rows, axis=1)), y.take(rows), keys.take(rows)
        found = np.zeros(len(out_rows))
        for n in mine:
            w = _poisson(own, n)  # as often as drawn with replacement
            found += reach(held, _grow(seen, len(codes), target, w, FOREST_DEPTH, FOREST_LEAST, tried, np.random.default_rng([seed, n])), FOREST_DEPTH)
        out[out_rows] = found / trees
    return out


def _boost_part(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, keys: np.ndarray, folds: np.ndarray, rounds: int, turn: int, turns: int, seed: int) -> np.ndarray:
    """Predictions of this turn's folds for the rows that they leave out: from the mean, a small step towards the residuals a round."""
    out = np.zeros(len(y))
    rnd, share = np.random.default_rng(seed), np.uint64(int(BOOST_SHARE * (1 << 53)))
    for i, f in enumerate(folds):
        if i % turns != turn:
            continue
        out_rows, rows = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        held, seen, rest, own = codes.take(out_rows, axis=1), codes.take(rows, axis=1), y.take(rows), keys.take(rows)
        by = by_row(seen)
        start = rest.mean() if len(rows) else 0.0
        rest -= start
        found = np.full(len(out_rows), start)
        for r in range(rounds):
            made = _grow(by, len(codes), rest, _draws(own, i * rounds + r) < share, BOOST_DEPTH, 1, len(codes), rnd)
            rest -= BOOST_STEP * reach(seen, made, BOOST_DEPTH)
            found += BOOST_STEP * reach(held, made, BOOST_DEPTH)
        out[out_rows] = found
    return out


def left_out(df: DataFrame, key: str, features: list[str], y, fold: str, kind: str, trees: int, seed: int) -> DataFrame:
    """``(key, prediction)`` of each row, from the 'random_forest' or 'boosting' of ``y`` that was fitted on all rows of other ``fold`` values.

    The forest has ``trees`` trees of depth 6 with 3 rows at least in a leaf, each split among the root of the number of features; boosting
    three fifths as many rounds of depth 2 on four fifths of the rows, by steps of 0.05. Features must be without gaps, ``key`` tells the rows apart.
    """
    spark = df.sparkSession
    cuts = cut_points(df, features)
    turns = max(1, spark.sparkContext.defaultParallelism)
    if kind == "boosting":
        turns = min(turns, max(1, df.select(fold).distinct().count()))
    part, amount = (_forest_part, trees) if kind == "random_forest" else (_boost_part, max(1, trees * 3 // 5))
    names = [f"f{i}" for i in range(len(features))]
    cols = [F.col(key).alias("key"), F.col(fold).cast("bigint").alias("fold"), F.xxhash64(F.col(key), F.lit(seed)).alias("draw"), y.cast("double").alias("y")]
    kind_of_key = dict(df.dtypes)[key]

    def binned(batches):
        for b in batches:
            codes = np.stack([np.searchsorted(c, b[f].to_numpy(float), side="left") for f, c in zip(names, cuts)], 1).astype(np.uint8)
            yield pd.DataFrame({"key": b["key"], "fold": b["fold"], "draw": b["draw"], "y": b["y"], "codes": [c.tobytes() for c in codes]})

    def fit(batches):
        parts = [(b["turn"].iat[0], b["fold"].to_numpy(), b["draw"].to_numpy(), b["y"].to_numpy(), np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1), b["key"].to_numpy()) for b in batches if len(b)]
        if not parts:
            return
        turn = int(parts[0][0])
        fold_, draw, value, codes, keys = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        del parts
        order = np.argsort(draw, kind="stable")
        fold_, draw, value, keys = fold_[order], draw[order], value[order], keys[order]
        codes = np.ascontiguousarray(codes[order].T)
        found = part(codes, value, fold_, draw, np.unique(fold_), amount, turn, turns, seed)
        for i in range(0, len(keys), 100_000):
            yield pd.DataFrame({"key": keys[i : i + 100_000], "part": found[i : i + 100_000]})

    rows = df.select(*cols, *(F.col(c).cast("double").alias(n) for c, n in zip(features, names))).mapInPandas(binned, f"key {kind_of_key}, fold bigint, draw bigint, y double, codes binary")
    each = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).repartitionById(turns, F.col("turn"))
    found = each.mapInPandas(fit, f"key {kind_of_key}, part double")
    return found.groupBy("key").agg(F.sum("part").alias("prediction")).withColumnRenamed("key", key)
