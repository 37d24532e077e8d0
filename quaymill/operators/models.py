"""Demand models: linear algebra from one aggregation per fit, trees and clusters from the ML library."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymill.operators import trees as tree
from quaymill.operators.tables import adjusted_skewness, fit_metrics, row_numbers
from quaymill.session import cut


def clean(df: DataFrame, features: list[str], medians: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``df`` with infinities and gaps of ``features`` replaced by their medians, or by those given, and the medians. A column without values gets 0."""
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in features}
    if medians is None:
        row = df.agg(*(F.median(finite[c]).alias(c) for c in features)).first()
        medians = {c: row[c] if row[c] is not None else 0.0 for c in features}
    return df.withColumns({c: F.coalesce(finite[c], F.lit(float(medians[c]))) for c in features}), medians


def gram(df: DataFrame, columns: list[Column], weight: Column | None = None) -> np.ndarray:
    """Sums of products of the columns, in one pass; small, whatever the rows."""
    k, w = len(columns), F.lit(1.0) if weight is None else weight
    row = df.agg(*(F.sum(w * columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    return g


def _solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(g, b, rcond=1e-12)[0]


def least_squares(df: DataFrame, features: list[str], y: Column) -> np.ndarray:
    """Intercept and coefficients on the raw scale."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    g = gram(df, [*cols, y])
    d = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
    return _solve(g[:-1, :-1] / np.outer(d, d), g[:-1, -1] / d) / d


def linear(beta: np.ndarray, features: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], features)), F.lit(float(beta[0])))


def leave_one_out(df: DataFrame, features: list[str], target: str, log_target: bool = True) -> DataFrame:
    """``df`` with ``predicted``, each row's value from the least-squares fit of all others, by its leverage: one fit in place of one per row."""
    y = F.log1p(F.col(target)) if log_target else F.col(target).cast("double")
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    g = gram(df, [*cols, y])
    d = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
    inv = np.linalg.pinv(g[:-1, :-1] / np.outer(d, d), rcond=1e-12) / np.outer(d, d)
    beta = inv @ g[:-1, -1]
    k = len(cols)
    h = sum((F.lit(float(inv[i, j] * (1 if i == j else 2))) * cols[i] * cols[j] for i in range(k) for j in range(i, k)), F.lit(0.0))
    fitted = linear(beta, features)
    out = y - (y - fitted) / F.greatest(F.lit(1e-12), 1 - h)
    return df.withColumn("predicted", F.greatest(F.lit(0.0), F.expm1(out)) if log_target else out)


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation matrix of gap-free columns in one pass."""
    k = len(columns)
    row = df.agg(*(F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i in range(k) for j in range(i + 1, k))).first()
    r = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            v = row[f"r{i}_{j}"]
            r[i, j] = r[j, i] = 0.0 if v is None or math.isnan(v) else v
    return r


def variance_inflation(r: np.ndarray) -> np.ndarray:
    """Of each column on all others with an intercept: the diagonal of the inverse correlations."""
    return np.diag(np.linalg.pinv(r, rcond=1e-10))


def screen(df: DataFrame, features: list[str], target: str, core: list[str] = (), most_corr: float = 0.85, most_vif: float = 10.0, most: int = 8) -> list[str]:
    """The features to model with: not mostly missing, not constant, no near twins, no combination of others, at most ``most``.

    Of the most correlated pair the one less correlated with the target goes, again and again; then the worst variance
    inflation; then the weakest. ``core`` features always stay. Two passes over the data; the rest is on their small matrix.
    """
    vals = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    facts = df.agg(F.count("*").alias("n"), *(F.count(v).alias(f"k_{c}") for c, v in vals.items()), *(F.stddev(v).alias(f"s_{c}") for c, v in vals.items())).first()
    kept = [c for c in features if facts[f"k_{c}"] > 0.5 * facts["n"] and (facts[f"s_{c}"] or 0) > 0]
    if not kept:
        return []
    filled, _ = clean(df, kept)
    r = correlations(filled, [*kept, target])
    at = {c: i for i, c in enumerate(kept)}
    strength = {c: abs(r[at[c], -1]) for c in kept}
    core = [c for c in core if c in kept]

    while len(kept) > 1:
        value, a, b = max((abs(r[at[a], at[b]]), a, b) for i, a in enumerate(kept) for b in kept[i + 1 :])
        loose = [c for c in (a, b) if c not in core]
        if value <= most_corr or not loose:
            break
        kept.remove(min(loose, key=lambda c: strength[c]))
    while len(kept) > 1:
        ix = [at[c] for c in kept]
        worst = max(((v, c) for v, c in zip(variance_inflation(r[np.ix_(ix, ix)]), kept) if c not in core), default=(0, None))
        if worst[0] <= most_vif:
            break
        kept.remove(worst[1])
    if len(kept) > most:
        rest = sorted((c for c in kept if c not in core), key=lambda c: -strength[c])
        kept = core + rest[: max(0, most - len(core))]
    return kept


def log_skewed(df: DataFrame, features: list[str], limit: float = 1.5, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with log1p of the features that are skewed to the right, never negative and not flags; and which. ``columns`` applies a choice made before."""
    if columns is None:
        row = df.agg(*(f.alias(f"{n}_{c}") for c in features for n, f in (("skew", adjusted_skewness(c)), ("low", F.min(c)), ("kinds", F.approx_count_distinct(c))))).first()
        ok = lambda c: row[f"low_{c}"] is not None and row[f"low_{c}"] >= 0 and row[f"kinds_{c}"] > 2 and (row[f"skew_{c}"] or 0) > limit
        columns = [c for c in features if ok(c)]
    return df.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in columns}), columns


def _glm(df: DataFrame, cols: list[Column], y: Column, alpha: float, rounds: int = 50) -> np.ndarray:
    """Log-link fit by reweighted least squares, one aggregation a round; alpha 0 is Poisson."""
    start = df.agg(F.avg(y)).first()[0] or 0.0
    beta = np.zeros(len(cols))
    beta[0] = math.log(max(start, 1e-9))
    for _ in range(rounds):
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))
        mu = F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), eta)))
        g = gram(df, [*cols, eta + (y - mu) / mu], mu / (1 + alpha * mu))
        new = _solve(g[:-1, :-1], g[:-1, -1])
        if not np.isfinite(new).all():
            return new
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    return beta


def negative_binomial(df: DataFrame, features: list[str], target: str) -> tuple[dict[str, float], float]:
    """Coefficients per standard deviation (``const`` first) and the dispersion alpha: Poisson first, alpha from its Pearson statistic,
    then the negative binomial at that alpha; the Poisson fit if that isn't finite."""
    stats = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    cols = [F.lit(1.0), *((F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in features)]
    y = F.bround(F.col(target).cast("double"))
    p = _glm(df, cols, y, 0.0)
    mu = F.exp(sum((F.lit(float(b)) * c for b, c in zip(p, cols)), F.lit(0.0)))
    fit = df.agg(F.sum(F.pow(y - mu, 2) / mu).alias("chi"), F.avg(mu).alias("mu")).first()
    alpha = max((fit["chi"] / max(stats["n"] - len(cols), 1) - 1) / max(fit["mu"], 1e-9), 1e-6)
    beta = _glm(df, cols, y, alpha)
    beta = beta if np.isfinite(beta).all() else p
    return dict(zip(["const", *features], map(float, beta))), float(alpha)


def regressor(kind: str, seed: int = 42, trees: int = 500, weight: str | None = None):
    """'linear', 'random_forest' or 'boosting' on a vector column ``features`` and ``label``; the trees take weighted rows."""
    weighed = {"weightCol": weight} if weight else {}
    if kind == "random_forest":
        return RandomForestRegressor(numTrees=trees, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=seed, **weighed)
    if kind == "boosting":
        return GBTRegressor(maxIter=max(1, trees * 3 // 5), stepSize=0.05, maxDepth=2, subsamplingRate=0.8, seed=seed, **weighed)
    if kind == "linear":
        return LinearRegression(solver="normal")
    raise ValueError(f"unknown kind of model: {kind}")


@dataclass(frozen=True)
class NetModel:
    """An elastic net: coefficients on the raw scale (intercept first) and the penalty that was chosen."""

    features: list[str]
    beta: np.ndarray
    penalty: tuple[float, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", linear(self.beta, self.features))


#: Strengths and shares of absolute values that are tried.
NET_STRENGTHS, NET_SHARES = (0.001, 0.01, 0.1, 1.0), (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)


def fold_sums(df: DataFrame, features: list[str], target: str, folds: int, seed: int = 42) -> np.ndarray:
    """Sums of products (a constant first, log1p of the target last) of the rows of each fold, in one pass. Equal rows share a fold, so that
    none is judged by its copy."""
    k = len(features) + 2

    def partial(batches):
        total = np.zeros((folds, k, k))
        for b in batches:
            a = np.column_stack([np.ones(len(b)), b.drop(columns="fold").to_numpy(float)])
            for f in range(folds):
                part = a[(b["fold"] == f).to_numpy()]
                total[f] += part.T @ part
        yield pd.DataFrame({"fold": range(folds), "sums": [t.ravel().tolist() for t in total]})

    cols = [*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.log1p(F.col(target).cast("double")).alias("y")]
    rows = df.select(*cols).withColumn("fold", F.pmod(F.xxhash64(*(f"f{i}" for i in range(len(features))), "y", F.lit(seed)), F.lit(folds)).cast("int"))
    sums = rows.mapInPandas(partial, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("pos", "s")).groupBy("fold", "pos").agg(F.sum("s").alias("s")).collect()  # folds x features squared
    out = np.zeros((folds, k * k))
    for r in sums:
        out[r["fold"], r["pos"]] = r["s"]
    return out.reshape(folds, k, k)


def elastic_net(df: DataFrame, features: list[str], target: str, folds: int = 5, seed: int = 42) -> NetModel:
    """The elastic net on log1p of the target whose penalty predicts left-out folds best. One pass over the rows; all fits are on sums."""
    g = fold_sums(df, features, target, folds, seed)
    total = g.sum(0)
    used = [f for f in range(folds) if 0 < g[f, 0, 0] < total[0, 0]]

    def error(penalty: tuple[float, float]) -> float:
        out = 0.0
        for f in used:
            b = np.r_[_shrunk(total - g[f], *penalty), -1.0]
            out += float(b @ g[f] @ b)
        return out

    penalty = min(product(NET_STRENGTHS, NET_SHARES), key=error)
    return NetModel(features, _shrunk(total, *penalty), penalty)


def net_left_out(df: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """``df`` with ``predicted``, each row's value from the elastic net of all others, at the penalty chosen for all: two passes, the second
    refits for each row on the sums without it."""
    model = elastic_net(df, features, target)
    total = fold_sums(df, features, target, 1)[0]
    k = len(features)

    def refit(batches):
        for b in batches:
            x = np.column_stack([np.ones(len(b)), b[[f"f{i}" for i in range(k)] + ["y"]].to_numpy(float)])
            beta = _shrunk_many(total[None] - x[:, :, None] * x[:, None, :], *model.penalty)
            yield pd.DataFrame({"key": b["key"], "predicted": np.maximum(0.0, np.expm1((x[:, :-1] * beta).sum(1)))})

    rows = df.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.log1p(F.col(target).cast("double")).alias("y"))
    found = rows.mapInPandas(refit, f"key {dict(df.dtypes)[key]}, predicted double")
    return df.join(found.withColumnRenamed("key", key), key)


def fitted(df: DataFrame, features: list[str], target: str, kind: str, **how):
    """A model from raw features to ``prediction`` of log1p of the target: 'linear', 'elastic_net', 'random_forest' or 'boosting'."""
    if kind == "elastic_net":
        return elastic_net(df, features, target, **how)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), scaler, regressor(kind, **how)])
    return pipe.fit(df.withColumn("label", F.log1p(F.col(target))))


def predicted(model, df: DataFrame) -> DataFrame:
    """``df`` with ``predicted`` in the target's units, never negative."""
    return model.transform(df).withColumn("predicted", F.greatest(F.lit(0.0), F.expm1("prediction"))).drop("raw", "features", "prediction")


def cross_validated(df: DataFrame, key: str, features: list[str], target: str, kind: str, folds: int | None = 5, **how) -> DataFrame:
    """``df`` with ``predicted`` from the fold fits that didn't see the row. ``folds`` None leaves each row out once: as many fits
    as rows, for tables of training size. ``key`` must tell the rows apart. Forests and boosting are those of ``trees``, all folds in one pass."""
    if kind in ("random_forest", "boosting") and "weight" not in how:
        settings = {"seed": 42, "trees": 500} | how
        rows = row_numbers(df, [], [key], "fold") if folds is None else df.withColumn("fold", F.pmod(F.xxhash64(F.col(key)), F.lit(folds)))
        rows = cut(rows, "folds")
        p = cut(tree.left_out(rows, key, features, F.log1p(F.col(target).cast("double")), "fold", kind, **settings), "held_out")
        return rows.drop("fold").join(p, key).withColumn("predicted", F.greatest(F.lit(0.0), F.expm1("prediction"))).drop("prediction")
    if folds is None:
        rows = cut(row_numbers(df, [], [key], "fold"), "folds")
        turns = range(1, rows.count() + 1)
    else:
        rows = cut(df.withColumn("fold", F.pmod(F.xxhash64(F.col(key)), F.lit(folds))), "folds")
        turns = range(folds)
    parts = [predicted(fitted(rows.where(F.col("fold") != k), features, target, kind, **how), rows.where(F.col("fold") == k)) for k in turns]
    return reduce(DataFrame.unionByName, parts).drop("fold")


def model_table(df: DataFrame, key: str, features: list[str], target: str, kinds: list[str], folds: int | None = 5, **how) -> DataFrame:
    """Held-out metrics of each kind of model: ``model, n, r2, mae, rmse, mape, spearman``. ``folds`` None leaves each row out once
    for all kinds; the linear kind and the elastic net always do, from sums of products."""
    out: DataFrame | None = None
    for kind in kinds:
        if kind == "linear":
            p = leave_one_out(df, features, target)
        elif kind == "elastic_net":
            p = net_left_out(df, key, features, target)
        else:
            p = cross_validated(df, key, features, target, kind, folds, **how)
        m = fit_metrics(p, target, "predicted").select(F.lit(kind).alias("model"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def best_model(metrics: DataFrame, within: float = 0.05) -> DataFrame:
    """The row with the highest r2 among those whose rank correlation is within ``within`` of the best."""
    top = metrics.agg(F.max("spearman")).scalar()
    return metrics.where(F.col("spearman") >= top - within).orderBy(F.desc("r2"), "model").limit(1)


_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: A Poisson draw of mean 1 is the number of these below a uniform one.
_STEPS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])


def poisson_draws(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each row (64-bit key) counts in each replicate: a fixed Poisson draw of mean 1."""
    z = keys.astype(np.int64).view(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in _MIX:
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_STEPS, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53))


def _shrunk(g: np.ndarray, alpha: float, l1: float, rounds: int = 500) -> np.ndarray:
    """Elastic net by coordinate descent on sums of products (a constant first, the target last); penalties on standardised features."""
    n, k = g[0, 0], len(g) - 2
    mean = g[0] / n
    c = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    on = np.flatnonzero(sd[1 : k + 1] > 1e-12) + 1
    r, q, b = c[np.ix_(on, on)] / np.outer(sd[on], sd[on]), c[on, -1] / sd[on], np.zeros(len(on))
    for _ in range(rounds):
        last = b.copy()
        for j in range(len(on)):
            rho = q[j] - r[j] @ b + b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (1 + alpha * (1 - l1))
        if np.abs(b - last).max(initial=0) < 1e-9:
            break
    beta = np.zeros(k + 1)
    beta[on] = b / sd[on]
    beta[0] = mean[-1] - beta[1:] @ mean[1:-1]
    return beta


def _shrunk_many(g: np.ndarray, alpha: float, l1: float, rounds: int = 500) -> np.ndarray:
    """``_shrunk`` of each of many sums of products, step by step the same: each stops on its own."""
    n, k = g[:, 0, 0], g.shape[1] - 2
    mean = g[:, 0] / n[:, None]
    c = g / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2), 0))[:, 1 : k + 1]
    on = sd > 1e-12
    scale = np.where(on, sd, np.inf)
    r, q, out = c[:, 1:-1, 1:-1] / (scale[:, :, None] * scale[:, None, :]), c[:, 1:-1, -1] / scale, np.zeros((len(g), k))
    todo = np.arange(len(g))
    for _ in range(rounds):
        b = out[todo]
        last = b.copy()
        for j in range(k):
            rho = q[:, j] - (r[:, j] * b).sum(1) + b[:, j]
            b[:, j] = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1, 0) / (1 + alpha * (1 - l1))
        out[todo] = b
        going = np.abs(b - last).max(1, initial=0) >= 1e-9
        if not going.any():
            break
        todo, r, q = todo[going], r[going], q[going]
    beta = np.zeros((len(g), k + 1))
    beta[:, 1:] = out / scale
    beta[:, 0] = mean[:, -1] - (beta[:, 1:] * mean[:, 1:-1]).sum(1)
    return beta


def _least(g: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
    return _solve(g[:-1, :-1] / np.outer(d, d), g[:-1, -1] / d) / d


def replicate_fits(train: DataFrame, target: str, features: list[str], key: str, replicates: int, penalty: tuple[float, float] | None = None, seed: int = 5) -> np.ndarray:
    """Coefficients (replicates x intercept and features) of least squares, or of an elastic net with ``penalty (strength, share of
    absolute values)``, on log1p of the target: one pass over the rows. Each task multiplies its rows' products with their draws in
    all replicates, so that rows are never repeated."""
    k = len(features) + 2
    upper = np.triu_indices(k)
    numbers = np.arange(replicates)

    def partial(batches):
        total = np.zeros((replicates, len(upper[0])))
        for b in batches:
            a = np.column_stack([np.ones(len(b)), b.drop(columns="key").to_numpy(float)])
            total += poisson_draws(b["key"].to_numpy(), numbers).T @ (a[:, upper[0]] * a[:, upper[1]])
        yield pd.DataFrame({"rep": numbers, "sums": total.tolist()})

    rows = train.select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)), F.log1p(F.col(target).cast("double")).alias("y"))
    sums = rows.mapInPandas(partial, "rep int, sums array<double>").select("rep", F.posexplode("sums").alias("pos", "s")).groupBy("rep", "pos").agg(F.sum("s").alias("s"))
    sums = sums.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums"))

    def solve(batches):
        for b in batches:
            out = []
            for flat in b["sums"]:
                g = np.zeros((k, k))
                g[upper] = flat
                g = g + g.T - np.diag(np.diag(g))
                out.append((_least(g) if penalty is None else _shrunk(g, *penalty)).tolist())
            yield pd.DataFrame({"rep": b["rep"], "beta": out})

    return np.array([r["beta"] for r in sums.mapInPandas(solve, "rep int, beta array<double>").orderBy("rep").collect()])  # replicates x features


def bootstrap_intervals(
    train: DataFrame, target: str, features: list[str], rows: DataFrame, key: str, replicates: int = 1000, interval: float = 0.9, seed: int = 5, kind: str = "linear", penalty: tuple[float, float] = (0.1, 0.5), **how
) -> DataFrame:
    """``(key, prediction, lower, upper)``: mean and quantiles of the predictions of ``replicates`` fits on resampled ``train`` rows.

    In each replicate a row counts as often as a Poisson draw of mean 1 by its key says, so that equal rows draw apart and
    the draws don't depend on how rows are spread over tasks. ``key`` must tell the rows of both tables apart. The linear
    kinds gather all fits in one pass; ``penalty`` is that of the elastic net chosen before. Forests and boosting are
    fitted once per replicate with the draws as weights: as many jobs as replicates, for tables of training size.
    """
    low, high = (1 - interval) / 2, (1 + interval) / 2
    width = len(features)
    if kind in ("linear", "elastic_net"):
        betas = replicate_fits(train, target, features, key, replicates, penalty if kind == "elastic_net" else None, seed)

        def spread(batches):
            for b in batches:
                x = np.column_stack([np.ones(len(b)), b[[f"f{i}" for i in range(width)]].to_numpy(float)])
                p = np.maximum(np.expm1(x @ betas.T), 0)
                q = np.quantile(p, [low, high], axis=1)
                yield pd.DataFrame({"key": b["key"], "prediction": p.mean(1), "lower": q[0], "upper": q[1]})

        of = rows.select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)))
        return of.mapInPandas(spread, f"key {dict(rows.dtypes)[key]}, prediction double, lower double, upper double").withColumnRenamed("key", key)
    drawn = []
    for rep in range(replicates):
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(rep)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        weighed = train.withColumn("__w", sum(((u > float(s)).cast("double") for s in _STEPS), F.lit(0.0))).where("__w > 0")
        drawn.append(predicted(fitted(weighed, features, target, kind, weight="__w", **how), rows.select(key, *features)).select(key, "predicted"))
        if len(drawn) == 20:  # plans stay short
            drawn = [cut(reduce(DataFrame.unionByName, drawn), "drawn")]
    return reduce(DataFrame.unionByName, drawn).groupBy(key).agg(F.avg("predicted").alias("prediction"), F.percentile("predicted", low).alias("lower"), F.percentile("predicted", high).alias("upper"))


def typology(df: DataFrame, features: list[str], k: int = 5, seed: int = 42, starts: int = 10) -> DataFrame:
    """``df`` with ``typology``, the k-means cluster of its median-filled z-scores; of ``starts`` runs the one with the least cost."""
    names = [f"__{c}" for c in features]
    num = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, features)})
    prepare = Pipeline(stages=[
        Imputer(inputCols=names, outputCols=[f"{n}_f" for n in names], strategy="median"), VectorAssembler(inputCols=[f"{n}_f" for n in names], outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__z", withMean=True),
    ])
    ready = prepare.fit(num).transform(num)
    points = cut(ready.select("__z"), "points")
    tried = [KMeans(featuresCol="__z", predictionCol="typology", k=k, seed=seed + i, initSteps=4).fit(points) for i in range(starts)]
    best = min(tried, key=lambda m: m.summary.trainingCost)
    return best.transform(ready).drop("__v", "__z", *names, *(f"{n}_f" for n in names))


def simulate(model, df: DataFrame, changes: dict[str, float | tuple[str, float]]) -> DataFrame:
    """Predictions after changing features: a number multiplies, ('add', v) adds, ('set', v) sets."""
    new = {}
    for c, how in changes.items():
        op, v = how if isinstance(how, tuple) else ("multiply", how)
        if op not in ("multiply", "add", "set"):
            raise ValueError(f"unknown change: {op}")
        new[c] = F.lit(float(v)) if op == "set" else F.col(c) + v if op == "add" else F.col(c) * v
    return predicted(model, df.withColumns(new))


def candidate_features(df: DataFrame, deny: set[str], prefixes: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that aren't denied by name or prefix."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in deny and not c.startswith(prefixes or ("\0",))]


def run(train: DataFrame, rows: DataFrame, key: str, features: list[str], target: str, core: list[str] = (), kinds: tuple[str, ...] = ("linear", "elastic_net", "random_forest"), folds: int | None = 5, replicates: int = 200, **how) -> tuple[DataFrame, DataFrame]:
    """From raw tables to predictions: gaps filled with the training medians, skewed features logged, features screened,
    models compared on held-out rows, the best one applied.

    Returns the metrics ``(model, n, r2, mae, rmse, mape, spearman, chosen)`` and ``(key, predicted, lower, upper)`` of
    ``rows``, whose features get the medians and logarithms of the training table. The bounds are those of the chosen
    kind of model, refitted on resampled rows with the settings that it was chosen with.
    """
    home, medians = clean(train.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))), features)
    home, logged = log_skewed(cut(home, "train"), features)
    home = cut(home, "logged")
    kept = screen(home, features, target, list(core))
    metrics = cut(model_table(home, key, kept, target, list(kinds), folds, **how), "metrics")
    best = best_model(metrics).first()["model"]
    away = cut(log_skewed(clean(rows, features, medians)[0], features, columns=logged)[0], "rows")
    settings = {} if best in ("linear", "elastic_net") else how
    model = fitted(home, kept, target, best, **settings)
    if best == "elastic_net":
        settings = {"penalty": model.penalty}
    bounds = bootstrap_intervals(home, target, kept, away, key, replicates, kind=best, **settings).drop("prediction")
    out = predicted(model, away).select(key, "predicted").join(bounds, key)
    return metrics.withColumn("chosen", F.col("model") == best), out


def with_target(frame: DataFrame, name: str, targets: DataFrame, target_name: str, columns: list[str], target: str) -> DataFrame:
    """``frame`` with the target columns of the row of its name; every row of ``frame`` stays once. Of repeated target rows the largest
    by ``columns`` counts. A join that finds no target at all is an error: the names of the two sides don't fit."""
    one = targets.where(F.col(target_name).isNotNull()).groupBy(F.col(target_name).alias(name)).agg(F.max(F.struct(*columns)).alias("__t"))
    out = frame.drop(*columns).join(one, name, "left").select(*(c for c in frame.columns if c not in columns), *(F.col(f"__t.{c}").alias(c) for c in columns))
    if out.where(F.col(target).isNotNull()).isEmpty():
        raise ValueError(f"no {name} of the frame has a {target}")
    return out


def calibration(predicted_total: DataFrame, observed: list[tuple[str, DataFrame, bool]], coverage: float = 1.0, tolerance: float = 0.15) -> DataFrame:
    """One row ``predicted, observed, source, ratio, direction, in_band``: a predicted total (one cell) against the first of ``observed
    (source, one cell, of the whole system)`` that has a value. A source of the whole system compares with the prediction scaled up
    by its ``coverage``. Without any source the comparison is null."""
    sides = spark_row(predicted_total).select(F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("observed"), F.lit(None).cast("boolean").alias("whole"), F.lit(len(observed)).alias("turn"))
    for i, (source, value, whole) in enumerate(observed):
        sides = sides.unionByName(value.toDF("observed").select(F.lit(source).alias("source"), F.col("observed").cast("double").alias("observed"), F.lit(whole).alias("whole"), F.lit(i).alias("turn")))
    first = sides.where("turn = %d or (observed is not null and not isnan(observed))" % len(observed)).agg(F.min_by(F.struct("source", "observed", "whole"), "turn").alias("o")).select("o.*")
    p = F.lit(predicted_total.toDF("p").select(F.col("p").cast("double")).scalar())
    scaled = first.withColumn("predicted", F.when(F.col("whole"), F.try_divide(p, F.lit(float(coverage)))).otherwise(p))
    ratio = F.try_divide("predicted", "observed")
    out = scaled.select("predicted", "observed", "source", ratio.alias("ratio"))
    return out.withColumns({"direction": F.when(F.col("ratio") > 1, "over").when(F.col("ratio") < 1, "under").when(F.col("ratio") == 1, "equal"), "in_band": F.abs(F.col("ratio") - 1) <= tolerance})


def spark_row(df: DataFrame) -> DataFrame:
    """One row without a source."""
    return df.sparkSession.range(1)


def transfer_check(predictions: DataFrame, observed: DataFrame, key: str, predicted_col: str, observed_col: str, least: int = 5) -> DataFrame:
    """How predictions meet what was observed of the same keys: the fit metrics, the ratio of the totals and whether it lies
    within 15 percent; nulls in all of them below ``least`` pairs."""
    j = cut(predictions.select(key, F.col(predicted_col).alias("p")).join(observed.select(key, F.col(observed_col).alias("o")), key).where("p is not null and o is not null"), "pairs")
    m = fit_metrics(j, "o", "p").withColumn("ratio", j.agg(F.try_divide(F.sum("p"), F.sum("o"))).scalar())
    m = m.withColumn("in_band", F.col("ratio").between(0.85, 1.15))
    return m.select("n", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in m.columns if c != "n"))
