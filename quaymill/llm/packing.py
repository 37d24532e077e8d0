"""Filling fixed-capacity containers, with certified bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymill.session import attach, cut

#: Items that one task packs.
ITEMS = 20_000
#: Exchanges of items between partitions whose bins exceed their bound, at most; they end before where one gains nothing.
EXCHANGES = 8


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each size, 1 to capacity: largest first, each into the fullest bin that takes it."""
    bins = np.empty(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    have, used = 0, 0  # the set of free rooms, as bits
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = have >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                have ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i] = b
        if room > s:
            free.setdefault(room - s, []).append(b)
            have |= 1 << (room - s)
    return bins


def bins_needed(counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for ``counts[s]`` items of each size s, by two families of dual feasible functions."""
    if not counts.sum():
        return 0
    s = np.arange(len(counts))
    total = int((counts * s).sum())
    best = -(-total // capacity)
    # small items up to k vanish, those over capacity - k are whole bins, the rest keep their size
    n, w = np.cumsum(counts), np.cumsum(counts * s)
    for k in np.unique(np.concatenate([[1], s[(counts > 0) & (s <= capacity // 2)]])):
        whole = int(n[-1] - n[capacity - k])
        kept = int(w[capacity - k] - w[k - 1])
        best = max(best, whole + -(-kept // capacity))
    # sizes rounded down to k-ths of a bin, exact multiples of 1/(k+1) kept
    for k in range(1, 25):
        x = (k + 1) * s
        value = np.where(x % capacity == 0, s * k, x // capacity * capacity)  # in units of 1/(k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """Packs one partition anew; what it had before stays if that needs no more bins."""
    capacity = int(group["capacity"].iloc[0])
    sizes = group["tokens"].to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    used = int(bins.max()) + 1
    low = bins_needed(np.bincount(sizes, minlength=capacity + 1), capacity)
    if (group["bin"] >= 0).all() and (before := group.groupby(["part", "bin"]).ngroups) <= used:
        return group.assign(low=low, bins=before)
    return group.assign(part=group["turn_part"], bin=bins, low=low, bins=used)


SCHEMA = "container string, capacity int, id bigint, piece int, tokens int, part bigint, bin bigint, turn_part bigint, low bigint, bins bigint"


def pack(sizes: DataFrame, capacities: DataFrame, items: int = ITEMS, exchanges: int = EXCHANGES) -> DataFrame:
    """``(container, id, piece, tokens, bin_id)`` for ``sizes (id bigint, tokens int)`` and ``capacities (container, capacity)``.

    An item larger than the capacity is split into full pieces and a rest, ``piece`` 0, 1, ... in
    order; all others stay whole. Items of size 0, or null, take no room: they come out with a null
    bin_id. Items go to partitions of about ``items`` by hash, so that all have the same mix of sizes;
    each is packed best-fit decreasing and its number of bins certified by the bound of
    ``bins_needed``. Bins with room left in partitions above their bound are then dealt into new
    partitions and packed again, until an exchange gains nothing or ``exchanges`` are done; an arrangement is only replaced by
    one with fewer bins. Capacities must be positive. Ties are dealt by id, so equal input gives equal output.
    """
    caps = [(r[0], r[1]) for r in capacities.select("container", F.col("capacity").cast("int")).where("container is not null and capacity > 0").distinct().collect()]  # a table of settings
    if not caps:
        return sizes.sparkSession.createDataFrame([], "container string, id bigint, piece int, tokens int, bin_id string")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("container"), F.lit(c).cast("int").alias("capacity")) for n, c in caps))).alias("c")
    base = sizes.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("tokens").cast("int"), F.lit(0)).alias("tokens"), each).select("id", "tokens", "c.*")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    rest = (F.col("tokens") % F.col("capacity")).cast("int")
    whole = base.where("tokens >= capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), full - 1)))
    whole = whole.select("container", "id", "piece", F.col("capacity").alias("tokens"), F.concat_ws(":", F.lit("w"), "id", "piece").alias("bin_id"))
    small = base.where(rest > 0).select("container", "capacity", "id", full.alias("piece"), rest.alias("tokens"))
    none = base.where("tokens <= 0").select("container", "id", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(None).cast("string").alias("bin_id"))

    counts = {r[0]: r[1] for r in small.groupBy("container").count().collect()}
    parts = F.lit(1)
    for n, k in counts.items():
        parts = F.when(F.col("container") == n, F.lit(max(1, math.ceil(k / items)))).otherwise(parts)
    dealt = small.withColumn("part", F.lit(-1).cast("bigint")).withColumn("bin", F.lit(-1).cast("bigint")).withColumn("turn_part", F.pmod(F.xxhash64("id", "piece"), parts).cast("bigint"))
    packed = cut(dealt.groupBy("container", "turn_part").applyInPandas(_pack, SCHEMA), "packed")
    done: list[DataFrame] = []
    for turn in range(exchanges):
        fill = packed.groupBy("container", "part", "bin").agg(F.sum("tokens").alias("fill"), F.first("capacity").alias("capacity"), F.max("bins").alias("bins"), F.max("low").alias("low"), F.count("*").alias("k"))
        loose = cut(fill.where("bins > low and fill < capacity").select("container", "part", "bin", "k"), "loose")
        again = {r[0]: (r[1], r[2]) for r in loose.groupBy("container").agg(F.sum("k"), F.count_distinct("part")).collect()}
        again = {n: k for n, (k, p) in again.items() if p > 1}
        if not again:
            break
        parts = F.lit(1)
        for n, k in again.items():
            parts = F.when(F.col("container") == n, F.lit(max(1, math.ceil(k / items)))).otherwise(parts)
        some = loose.where(F.col("container").isin(*again)).withColumn("__new", F.lit((turn + 1) << 40) + F.pmod(F.xxhash64("part", "bin", F.lit(turn)), parts)).drop("k")
        marked = packed.join(some, ["container", "part", "bin"], "left")
        done.append(marked.where("__new is null").select(*packed.columns))
        packed = cut(marked.where("__new is not null").withColumn("turn_part", F.col("__new")).select(*packed.columns).groupBy("container", "turn_part").applyInPandas(_pack, SCHEMA), "packed")
        if packed.where("part = turn_part").isEmpty():  # no arrangement was replaced
            break
    for old in done:
        packed = packed.unionByName(old)
    named = packed.select("container", "id", "piece", "tokens", F.concat_ws(":", F.lit("p"), "part", "bin").alias("bin_id"))
    return named.unionByName(whole).unionByName(none)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(container, capacity, items, tokens, bins, bins_needed, unused_share)``; bins_needed is a proven lower bound."""
    per = packed.where("bin_id is not null").groupBy("container", "tokens").agg(F.count("*").alias("k"))
    bins = packed.where("bin_id is not null").select("container", "bin_id").distinct().groupBy("container").agg(F.count("*").alias("bins"))
    caps = capacities.select("container", F.col("capacity").cast("int").alias("capacity")).distinct()

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        c = int(group["capacity"].iloc[0])
        counts = np.bincount(group["tokens"], weights=group["k"], minlength=c + 1).astype(np.int64)
        return pd.DataFrame({"container": [group["container"].iloc[0]], "capacity": [c], "items": [int(counts.sum())], "tokens": [int((counts * np.arange(len(counts))).sum())], "bins_needed": [bins_needed(counts, c)]})

    low = per.join(attach(caps), "container").groupBy("container").applyInPandas(bound, "container string, capacity int, items bigint, tokens bigint, bins_needed bigint")
    return low.join(bins, "container").select("container", "capacity", "items", "tokens", "bins", "bins_needed", (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused_share"))
