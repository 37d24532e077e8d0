"""Irregular readings onto a regular grid, by a Kalman smoother per source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variance of the level's steps against that of a reading, tried per source; the likeliest is kept.
RATIOS = (0.001, 0.02, 0.2, 2.0)
#: Variance of the trend's steps against that of the level's.
TREND = 0.001
#: Values of one block of sources that are smoothed together.
BLOCK = 2_000_000


def _steps(dt: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Noise that a local linear trend gathers over ``dt``."""
    s = q * TREND
    return q * dt + s * dt**3 / 3, s * dt**2 / 2, s * dt


def _filter(dt: np.ndarray, y: np.ndarray, n: np.ndarray, q: np.ndarray, keep: bool):
    """Forward pass over columns; y NaN where nothing was read. Reading variance is 1/n. Returns the concentrated log-likelihood, the scale, and the states."""
    f, e = y.shape
    m, b = np.zeros(f), np.zeros(f)
    p11, p12, p22 = np.full(f, 100.0), np.zeros(f), np.full(f, 1.0)
    logs, squares, count, states = np.zeros(f), np.zeros(f), np.zeros(f), []
    for i in range(e):
        d = dt[:, i]
        a11, a12, a22 = _steps(d, q)
        m = m + b * d
        p11, p12, p22 = p11 + 2 * d * p12 + d * d * p22 + a11, p12 + d * p22 + a12, p22 + a22
        if keep:
            before = (m, b, p11, p12, p22)
        got = ~np.isnan(y[:, i])
        s = p11 + 1 / n[:, i]
        v = np.where(got, y[:, i] - m, 0.0)
        k1, k2 = np.where(got, p11 / s, 0.0), np.where(got, p12 / s, 0.0)
        m, b = m + k1 * v, b + k2 * v
        p11, p12, p22 = p11 * (1 - k1), p12 * (1 - k1), p22 - k2 * p12
        if i:
            logs += np.where(got, np.log(s), 0.0)
            squares += v * v / s
            count += got
        if keep:
            states.append((*before, m, b, p11, p12, p22))
    scale = np.where(count > 1, squares / np.maximum(count, 1), 1.0)
    return -0.5 * (logs + count * np.log(np.maximum(scale, 1e-12))), scale, states


def smooth(times: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of a reading at each of ``times`` (sources x events, increasing); y is NaN where nothing was read."""
    dt = np.diff(times, axis=1, prepend=times[:, :1])
    centre, spread = np.nanmean(y, axis=1), np.nanstd(y, axis=1)
    spread = np.where(spread > 0, spread, 1.0)
    z = (y - centre[:, None]) / spread[:, None]
    fits = [_filter(dt, z, n, np.full(len(y), r), False)[0] for r in RATIOS]
    q = np.asarray(RATIOS)[np.argmax(fits, axis=0)]
    _, scale, states = _filter(dt, z, n, q, True)
    e = y.shape[1]
    mean, var = np.empty_like(y), np.empty_like(y)
    *_, m, b, p11, p12, p22 = states[-1]
    mean[:, -1], var[:, -1] = m, p11
    for i in range(e - 2, -1, -1):
        fm, fb, f11, f12, f22 = states[i][5:]
        qm, qb, q11, q12, q22 = states[i + 1][:5]
        d = dt[:, i + 1]
        det = np.maximum(q11 * q22 - q12 * q12, 1e-300)
        c11, c12 = f11 + d * f12, f12  # filtered covariance times the transposed transition
        c21, c22 = f12 + d * f22, f22
        g11, g12 = (c11 * q22 - c12 * q12) / det, (c12 * q11 - c11 * q12) / det
        g21, g22 = (c21 * q22 - c22 * q12) / det, (c22 * q11 - c21 * q12) / det
        x1, x2 = m - qm, b - qb
        e11, e12, e22 = p11 - q11, p12 - q12, p22 - q22
        m, b = fm + g11 * x1 + g12 * x2, fb + g21 * x1 + g22 * x2
        p11, p12, p22 = (
            f11 + g11 * (g11 * e11 + g12 * e12) + g12 * (g11 * e12 + g12 * e22),
            f12 + g21 * (g11 * e11 + g12 * e12) + g22 * (g11 * e12 + g12 * e22),
            f22 + g21 * (g21 * e11 + g22 * e12) + g22 * (g21 * e12 + g22 * e22),
        )
        mean[:, i], var[:, i] = m, p11
    sd = np.sqrt(np.maximum(var + 1, 0) * scale[:, None]) * spread[:, None]
    return mean * spread[:, None] + centre[:, None], sd


def _block(names: list, cells: list[np.ndarray]) -> pd.DataFrame:
    """cells: per source, rows of slot, position in the slot (0 to 1), mean reading, readings."""
    first = np.array([c[0, 0] for c in cells])
    length = np.array([int(c[-1, 0] - c[0, 0]) + 1 for c in cells])
    width, f = int(length.max()), len(cells)
    own = np.repeat(np.arange(f), [len(c) for c in cells])
    flat = np.concatenate(cells)
    at = (flat[:, 0] - first[own]).astype(int)
    off, y, n = np.zeros((f, width)), np.full((f, width), np.nan), np.ones((f, width))
    off[own, at], y[own, at], n[own, at] = flat[:, 1], flat[:, 2], np.maximum(flat[:, 3], 1)
    grid = np.broadcast_to(np.arange(width, dtype=float), (f, width))
    if off.any():  # readings lie between the grid's times: an event of the grid and one of the reading in each slot
        times, yy, nn = np.stack([grid, grid + off], 2).reshape(f, -1), np.full((f, width * 2), np.nan), np.ones((f, width * 2))
        yy[:, 1::2], nn[:, 1::2] = y, n
        mean, sd = (x[:, ::2] for x in smooth(times, yy, nn))
    else:
        mean, sd = smooth(np.ascontiguousarray(grid), y, n)
    inside = np.arange(width)[None, :] < length[:, None]
    slot = (first[:, None] + np.arange(width)[None, :]).astype(np.int64)
    return pd.DataFrame({
        "source": np.repeat(np.asarray(names, object), length),
        "slot": slot[inside],
        "reading": y[inside],
        "smoothed": mean[inside],
        "sd": sd[inside],
        "is_missing": np.isnan(y)[inside],
    })


def _smooth_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        items = [(s, np.column_stack([np.asarray(x, float) for x in (a, b, c, d)])) for s, a, b, c, d in batch.itertuples(index=False)]
        items.sort(key=lambda x: x[1][-1, 0] - x[1][0, 0])  # like lengths together: little padding
        while items:
            k, width = 0, 1
            while k < len(items) and (k + 1) * (w := items[k][1][-1, 0] - items[k][1][0, 0] + 1) <= BLOCK or k == 0:
                k, width = k + 1, w
            yield _block([s for s, _ in items[:k]], [c for _, c in items[:k]])
            items = items[k:]


def regular_grid(readings: DataFrame) -> DataFrame:
    """A value per source and slot from ``readings (source, t double, y double)``, t in slots.

    Result: ``source, slot bigint, reading, smoothed, sd double, is_missing boolean``, one row for
    every slot from the source's first to its last one with a reading. ``reading`` is the mean of the
    slot's readings or null; ``smoothed`` and ``sd`` are what a continuous-time local linear trend
    expects of a reading at the slot's begin. Readings are first combined per slot, with their number
    as weight, so that no source is larger than its span, however many readings it has.
    Null source, t or y, and NaN, take no part; a source with one slot gives one row.
    """
    slots = (
        readings.select("source", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
        .where("source is not null and t is not null and y is not null and not isnan(t) and not isnan(y)")
        .groupBy("source", F.floor("t").cast("bigint").alias("slot"))
        .agg(F.avg(F.col("t") - F.floor("t")).alias("off"), F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
    )
    return _smoothed(slots)


def _smoothed(slots: DataFrame) -> DataFrame:
    """``regular_grid`` of ``slots (source, slot, off, y, n)``, one row per source and slot."""
    series = slots.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("slot", "off", "y", "n"))).alias("s"))
    flat = series.select("source", *(F.col(f"s.{c}").alias(c) for c in ("slot", "off", "y", "n")))
    out = flat.mapInPandas(_smooth_batches, "source string, slot bigint, reading double, smoothed double, sd double, is_missing boolean")
    return out.withColumn("reading", F.when(~F.col("is_missing"), F.col("reading")))


def daily_grid(df: DataFrame, source: str, day: str, value: str, usable, latest: list[str]) -> DataFrame:
    """``regular_grid`` by calendar day of the rows where ``usable``; of several rows of a source and day the last by ``latest`` counts.

    Result: ``source, day date, value, smoothed, sd, is_missing``; ``value`` is the reading, or the
    smoothed value, not below 0, where there is none.
    """
    one = (
        df.where(usable & F.col(source).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(source).cast("string").alias("source"), F.col(day).cast("date").alias("day"))
        .agg(F.max_by(F.col(value).cast("double"), F.struct(*latest)).alias("y"))
        .where("y is not null and not isnan(y)")
        .select("source", F.unix_date("day").cast("bigint").alias("slot"), F.lit(0.0).alias("off"), "y", F.lit(1.0).alias("n"))
    )
    return _smoothed(one).select(
        "source",
        F.date_from_unix_date(F.col("slot").cast("int")).alias("day"),
        F.coalesce("reading", F.greatest(F.lit(0.0), F.col("smoothed"))).alias("value"),
        "smoothed",
        "sd",
        "is_missing",
    )
