"""Filling missing values from similar records, by chained equations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymill.session import BROADCAST_ROWS, attach, cut

#: Rows at the overall mean that each class's mean is mixed with.
SHRINK = 5.0
RIDGE = 1e-6
#: Scores of classes that a task holds at once.
SCORES = 2_000_000


@dataclass(frozen=True)
class Field:
    """A field to fill. missing: SQL-free test of a column; whole and most: the shape of a number."""

    name: str
    numeric: bool
    missing: object
    most: float = float("inf")
    whole: bool = False


def _uniform(*keys: object) -> Column:
    """A fixed number in (0, 1) of the keys."""
    return (F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _normal(*keys: object) -> Column:
    return F.sqrt(-2 * F.log(_uniform(*keys, "radius"))) * F.cos(2 * np.pi * _uniform(*keys, "angle"))


def _steady(x: np.ndarray) -> np.ndarray:
    """Eight digits: the order in which tasks add up doesn't show."""
    return np.array([float(f"{v:.8g}") for v in np.ravel(x)]).reshape(np.shape(x))


def product_sums(rows: DataFrame, fits: dict[str, tuple[str, list[str]]]) -> dict[str, np.ndarray]:
    """For each name of ``fits`` the sums of products of its columns, a constant before them, over the rows where its flag holds.

    One pass for all of them: each task multiplies its batches and sends one row of sums per name.
    """
    needed = list(dict.fromkeys(c for flag, cols in fits.values() for c in (flag, *cols)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((len(cols) + 1, len(cols) + 1)) for k, (_, cols) in fits.items()}
        for b in batches:
            values = {c: b[c].to_numpy(float) for c in needed}
            for k, (flag, cols) in fits.items():
                on = values[flag] > 0
                a = np.column_stack([np.ones(int(on.sum())), *(values[c][on] for c in cols)])
                total[k] += a.T @ a
        yield pd.DataFrame({"name": list(total), "sums": [t.ravel().tolist() for t in total.values()]})

    parts = rows.select(*(F.col(c).cast("double").alias(c) for c in needed)).mapInPandas(partial, "name string, sums array<double>")
    sums = parts.select("name", F.posexplode("sums").alias("pos", "s")).groupBy("name", "pos").agg(F.sum("s").alias("s")).collect()  # settings squared
    out = {k: np.zeros((len(cols) + 1) ** 2) for k, (_, cols) in fits.items()}
    for r in sums:
        out[r["name"]][r["pos"]] = r["s"]
    return {k: v.reshape(len(fits[k][1]) + 1, -1) for k, v in out.items()}


def _solved(g: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of the last column on the others and the residual deviation, from their sums of products."""
    n = max(g[0, 0], 1.0)
    a = g[:-1, :-1] / n
    beta = np.linalg.solve(a + RIDGE * np.diag(np.maximum(np.diag(a), 1e-12)), g[:-1, -1] / n)
    left = g[-1, -1] - 2 * beta @ g[:-1, -1] + beta @ g[:-1, :-1] @ beta
    return _steady(beta), float(_steady(np.sqrt(max(left, 0.0) / max(n - len(beta), 1.0))))


@dataclass(frozen=True)
class Classes:
    """What a task needs to score classes: per (block, class) its weight and the linear score of the features."""

    block: np.ndarray
    label: np.ndarray
    code: np.ndarray
    slope: np.ndarray
    base: np.ndarray

    def best(self, x: np.ndarray, seeds: np.ndarray, block: str | None, draw: bool) -> tuple[np.ndarray, np.ndarray]:
        """The best score of each row and its class; ``block`` None takes those of all blocks."""
        own = np.arange(len(self.label)) if block is None else np.flatnonzero(self.block == block)
        top, names = np.full(len(x), -np.inf), np.full(len(x), None, object)
        if not len(own):
            return top, names
        step = max(1, SCORES // len(own))
        for at in range(0, len(x), step):
            score = x[at : at + step] @ self.slope[own].T + self.base[own]
            if draw:  # the largest of score plus Gumbel noise is a draw by the classes' probabilities
                z = seeds[at : at + step, None] ^ self.code[own][None, :]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float)
                score = score - np.log(-np.log((u + 0.5) / float(1 << 53)))
            pick = score.argmax(1)
            top[at : at + step] = score[np.arange(len(pick)), pick]
            names[at : at + step] = self.label[own[pick]]
        return top, names


def draw_classes(gaps: DataFrame, stats: DataFrame, features: list[str], scatter: np.ndarray, means: list[float], seed: Column, draw: bool, rows: int | None = None) -> DataFrame:
    """``gaps (..., __block, features)`` with ``__class``, drawn from the discriminant that ``stats`` and ``scatter`` fit; the likeliest one if not ``draw``.

    ``stats (__block, __class, n, s0, s1, ...)`` are the observed rows of each class and the sums of their features, and
    ``scatter`` the sums of products of the features of all of them. Classes share one covariance; their means are drawn
    towards ``means`` as rare classes need it. A class weighs its rows in the gap's block; a block without observed rows
    takes those of all. Tasks hold ``BROADCAST_ROWS`` classes at a time: of more, several passes keep the best so far,
    which gives what one pass would give.
    """
    spark = gaps.sparkSession
    n = stats.count() if rows is None else rows
    d = len(features)
    parts = max(1, -(-n // BROADCAST_ROWS))
    within = scatter[1:, 1:] - _between(stats, d) if d else np.zeros((0, 0))
    total = max(scatter[0, 0] - n, 1.0)
    precision = _steady(np.linalg.inv(within / total + np.diag(np.maximum(np.diag(within) / total * 1e-3, 1e-6)))) if d else within
    known = attach(stats.select("__block").distinct().withColumn("__in", F.lit(True)))
    kept = [c for c in gaps.columns if c != "__class"]
    best = gaps.select(*kept).join(known, "__block", "left").withColumns({"__use": F.when(F.col("__in"), F.col("__block")), "__seed": seed, "__score": F.lit(float("-inf")), "__class": F.lit(None).cast("string")}).drop("__in")
    kinds = ", ".join(f"`{c}` {t}" for c, t in best.dtypes)
    for part in range(parts):
        rows_ = stats.where(F.pmod(F.xxhash64("__class"), F.lit(parts)) == part).select("__block", "__class", F.xxhash64("__block", "__class").alias("code"), "n", *(f"s{i}" for i in range(d))).collect()  # at most BROADCAST_ROWS on average
        size = np.array([r["n"] for r in rows_], float)
        sums = np.array([[r[f"s{i}"] for i in range(d)] for r in rows_], float).reshape(len(rows_), d)
        mean = np.round((sums + SHRINK * np.array(means)) / (size + SHRINK)[:, None], 9) if d else sums
        slope = mean @ precision
        held = spark.sparkContext.broadcast(Classes(
            np.array([r["__block"] for r in rows_], object), np.array([r["__class"] for r in rows_], object), np.array([r["code"] for r in rows_], np.int64).view(np.uint64), slope,
            np.log(np.maximum(size, 1.0)) - 0.5 * (slope * mean).sum(1),
        ))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x, seeds = b[features].to_numpy(float), b["__seed"].to_numpy(np.int64).view(np.uint64)
                    score, label = b["__score"].to_numpy(float).copy(), b["__class"].to_numpy(object).copy()
                    use = b["__use"].where(b["__use"].notna(), None).to_numpy(object)
                    for block in {*use}:
                        at = np.flatnonzero(pd.isna(use) if block is None else use == block)
                        s, c = held.value.best(x[at], seeds[at], block, draw)
                        win = s > score[at]
                        score[at[win]], label[at[win]] = s[win], c[win]
                    b = b.assign(__score=score, __class=label)
                yield b

        best = best.mapInPandas(run, kinds)
    return best.select(*kept, "__class")


def _between(stats: DataFrame, d: int) -> np.ndarray:
    """Sums of products of the class means, each as often as the class has rows."""
    row = stats.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d))).first()
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = row[f"p{i}_{j}"] or 0.0
    return out


def impute(df: DataFrame, key: str, fields: list[Field], helpers: list[str], blocks: list[str], rounds: int = 2, seed: int = 7, draw: bool = True) -> DataFrame:
    """``df``'s one row per ``key`` as ``key, <field>, <field>_missing, <field>_filled ...``.

    Chained equations. Numbers start at their mean, classes at none; in each of ``rounds`` every field is fitted on the
    rows where it was delivered from all others as they stand, and its gaps are drawn anew. One pass over the rows gathers
    what all fits of a round need. A number is fitted by least squares on the other numbers, the ``helpers`` (numeric
    columns, with a flag where they are missing) and the mean of its class, from which the row's own value is left out;
    its gaps get the fit plus a residual of the fit's own spread. A class is fitted by a discriminant on all numbers and
    helpers, weighed by the classes' rows with the same ``blocks``, and drawn by the probabilities that gives: every
    class that was delivered can be drawn, however many there are. A helper missing in most gaps of a number isn't used for it. Draws
    depend on key, field and ``seed`` only. Without ``draw`` gaps get the fit itself and the likeliest class.

    ``<field>_missing`` marks what was not delivered, ``<field>_filled`` what was given a value; the two differ only where
    a field was delivered in no row at all, which stays null. Delivered values are never changed. Rows with a null key are
    left out; of rows with one key the largest by (key, values) counts. Columns that are not named are not read. An empty
    table gives an empty one.
    """
    cols = list(dict.fromkeys([*(f.name for f in fields), *helpers, *blocks]))
    rows = df.select(F.col(key).alias("__key"), *(F.col(c) for c in cols)).where(F.col("__key").isNotNull())
    rows = rows.groupBy("__key").agg(F.max(F.struct(*cols)).alias("__r")).select("__key", "__r.*")
    numbers, classes = [f for f in fields if f.numeric], [f for f in fields if not f.numeric]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    block = F.to_json(F.array(*(F.col(b).cast("string") for b in blocks))) if blocks else F.lit("[]")
    state = rows.select(
        "__key", block.alias("__block"), *(f.missing(F.col(f.name)).alias(f"__m_{f.name}") for f in fields),
        *(F.when(~f.missing(F.col(f.name)), F.col(f.name).cast("double") if f.numeric else F.col(f.name).cast("string")).alias(f"__o_{f.name}") for f in fields), *(number(h).alias(f"__h_{h}") for h in helpers),
    )
    state = cut(state, "delivered")

    known = [f"__o_{f.name}" for f in numbers] + [f"__h_{h}" for h in helpers]
    facts = state.agg(
        F.count("*").alias("all"), *(x for i, c in enumerate(known) for x in (F.avg(c).alias(f"mean{i}"), F.stddev_pop(c).alias(f"sd{i}"), F.count(c).alias(f"n{i}"))), *(F.count_if(f"__m_{f.name}").alias(f"gaps_{f.name}") for f in fields),
        *(F.count(F.when(F.col(f"__m_{f.name}"), F.col(f"__h_{h}"))).alias(f"there_{f.name}_{h}") for f in numbers for h in helpers),
    ).first()
    mean = {c: float(_steady(facts[f"mean{i}"])) for i, c in enumerate(known) if facts[f"mean{i}"] is not None}
    sd = {c: float(_steady(facts[f"sd{i}"] or 0.0)) or 1.0 for i, c in enumerate(known) if c in mean}
    numbers_in = [f for f in numbers if f"__o_{f.name}" in mean]
    usable = [h for h in helpers if f"__h_{h}" in mean]
    patchy = [h for h in usable if facts[f"n{known.index(f'__h_{h}')}"] < facts["all"]]
    scaled = lambda c: (F.col(c) - mean[c]) / sd[c]
    # in what follows numbers are in deviations from their mean; a gap starts at 0
    state = state.select(
        "__key", "__block", *(f"__m_{f.name}" for f in fields), *(f"__o_{f.name}" for f in classes),
        *(F.col(f"__o_{f.name}").alias(f"__d_{f.name}") for f in numbers), *(scaled(f"__o_{f.name}").alias(f"__o_{f.name}") for f in numbers_in), *(F.coalesce(scaled(f"__o_{f.name}"), F.lit(0.0)).alias(f"__v_{f.name}") for f in numbers_in),
        *(F.coalesce(scaled(f"__h_{h}"), F.lit(0.0)).alias(f"__h_{h}") for h in usable), *(F.col(f"__h_{h}").isNull().cast("double").alias(f"__n_{h}") for h in patchy), *(F.col(f"__o_{f.name}").alias(f"__v_{f.name}") for f in classes),
    )
    features = [f"__v_{f.name}" for f in numbers_in] + [f"__h_{h}" for h in usable]

    for turn in range(rounds):
        tables, sizes = {}, {}
        for f in classes:
            o = f"__o_{f.name}"
            tables[f.name] = cut(
                state.where(F.col(o).isNotNull()).groupBy("__block", F.col(o).alias("__class"))
                .agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(features)), *(x for i, g in enumerate(numbers_in) for x in (F.sum(f"__o_{g.name}").alias(f"t{i}"), F.count(f"__o_{g.name}").alias(f"k{i}")))),
                "classes",
            )
            sizes[f.name] = tables[f.name].count()
        now = state
        for k, f in enumerate(classes):  # each number's mean in the row's class, without the row itself
            own = tables[f.name].select("__block", F.col("__class").alias(f"__v_{f.name}"), *(F.col(f"{a}{i}").alias(f"__{a}{i}") for i in range(len(numbers_in)) for a in "tk"))
            now = now.join(attach(own, sizes[f.name]), ["__block", f"__v_{f.name}"], "left")
            for i, g in enumerate(numbers_in):
                o = F.col(f"__o_{g.name}")
                mine = F.when(F.col(f"__o_{f.name}").isNotNull() & o.isNotNull(), 1.0).otherwise(0.0)
                total = F.coalesce(F.col(f"__t{i}"), F.lit(0.0)) - mine * F.coalesce(o, F.lit(0.0))
                count = F.coalesce(F.col(f"__k{i}"), F.lit(0)) - mine
                now = now.withColumn(f"__e{k}_{g.name}", F.round(total / (count + SHRINK), 9))
            now = now.drop(*(f"__{a}{i}" for i in range(len(numbers_in)) for a in "tk"))
        # a helper that is itself missing in most of the gaps was derived from the field and can't tell its value
        tells = {f.name: [h for h in usable if 2 * facts[f"there_{f.name}_{h}"] >= facts[f"gaps_{f.name}"]] for f in numbers_in}
        causes = {
            f.name: [f"__v_{g.name}" for g in numbers_in if g is not f] + [f"__h_{h}" for h in tells[f.name]] + [f"__n_{h}" for h in patchy if h in tells[f.name]] + [f"__e{k}_{f.name}" for k in range(len(classes))]
            for f in numbers_in
        }
        flags = now.withColumns({f"__on_{f.name}": F.col(f"__o_{f.name}").isNotNull() for f in [*numbers_in, *classes]} | {f"__y_{f.name}": F.coalesce(f"__o_{f.name}", F.lit(0.0)) for f in numbers_in})
        fits = {f.name: (f"__on_{f.name}", [*causes[f.name], f"__y_{f.name}"]) for f in numbers_in} | {f.name: (f"__on_{f.name}", features) for f in classes}
        sums = product_sums(flags, fits) if fits else {}
        new = {}
        for f in numbers_in:
            beta, spread = _solved(sums[f.name])
            value = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], causes[f.name])), F.lit(float(beta[0])))
            value = value + spread * _normal(F.col("__key"), f.name, seed, turn) if draw else value
            o = f"__o_{f.name}"
            lowest, highest = (0.0 - mean[o]) / sd[o], (f.most - mean[o]) / sd[o]
            new[f"__v_{f.name}"] = F.coalesce(o, F.least(F.greatest(value, F.lit(lowest)), F.lit(highest)))
        kept = state.columns
        state = now.withColumns(new).select(*kept) if new else state
        for f in classes:
            m, v = f"__m_{f.name}", f"__v_{f.name}"
            if not sizes[f.name]:
                continue
            lot = F.xxhash64("__key", F.lit(f.name), F.lit(seed), F.lit(turn))
            gaps = draw_classes(state.where(m).drop(v), tables[f.name], features, sums[f.name], [0.0] * len(features), lot, draw, sizes[f.name])
            state = state.where(~F.col(m)).unionByName(gaps.withColumnRenamed("__class", v))
        state = cut(state, f"round{turn}")

    out = [F.col("__key").alias(key)]
    for f in fields:
        m = F.col(f"__m_{f.name}")
        if f.numeric:
            c = f"__o_{f.name}"
            filled = F.lit(None).cast("double") if c not in mean else F.least(F.greatest(F.col(f"__v_{f.name}") * sd[c] + mean[c], F.lit(0.0)), F.lit(f.most))
            filled = F.round(filled) if f.whole else filled
            v = F.coalesce(F.col(f"__d_{f.name}"), filled)
        else:
            v = F.col(f"__v_{f.name}")
        out += [(v.cast("bigint") if f.whole else v).alias(f.name), m.alias(f"{f.name}_missing"), (m & v.isNotNull()).alias(f"{f.name}_filled")]
    return state.select(*out)


def filled_cases(imputed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field)`` of every value that was not delivered and has been given one."""
    return imputed.select(
        F.col(key), F.explode(F.filter(F.array(*(F.when(F.col(f"{f}_filled"), F.lit(f)) for f in fields)), lambda x: x.isNotNull())).alias("field")
    )
