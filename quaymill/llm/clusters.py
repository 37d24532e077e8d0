"""Clusters of mutually similar records, by reciprocal-nearest-neighbour average linkage."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymill.llm.topn import top_n_per_group
from quaymill.session import attach, cut

#: Similarity of two records whose difference is the limit; clusters of a lower mean similarity stay apart.
THRESHOLD = 0.5
#: Most rows of a side that is broadcast; they have up to twenty columns, and some five such sides are held at a time.
SIDE_ROWS = 20_000
#: Rounds whose merges are applied to the records at once.
FOLD = 4
_SLACK = 1 + 1e-9


def _side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows were counted, as the smaller side of a join: broadcast up to ``SIDE_ROWS``, never beyond. Without a hint the planner
    goes by the size of the files, which neither tells what their rows are in memory nor what an explode makes of them."""
    return attach(df, rows, SIDE_ROWS) if rows <= SIDE_ROWS else df.hint("merge")


def _points(df: DataFrame, key: str, features: dict[str, float], usable) -> DataFrame:
    cols = [f"x{i}" for i in range(len(features))]
    rows = df.where(usable).select(F.col(key).alias("key"), *(F.col(c).cast("double").alias(a) for c, a in zip(features, cols)))
    ok = reduce(lambda p, c: p & F.col(c).isNotNull() & ~F.isnan(c), cols, F.col("key").isNotNull())
    rows = rows.where(ok).groupBy("key").agg(F.min(F.struct(*cols)).alias("x")).select("key", "x.*")
    return rows.withColumns({f"c{i}": F.floor(F.col(a) / t) for i, (a, t) in enumerate(zip(cols, features.values()))})


def _ahead(d: int) -> Column:
    """Steps to half of the neighbouring cells, so that each two meet once."""
    return F.array(*(F.struct(*(F.lit(v).cast("bigint").alias(f"o{i}") for i, v in enumerate(o))) for o in product((-1, 0, 1), repeat=d) if o > (0,) * d))


def _beside(rows: DataFrame, n: int, cell: list[str], carried: list[str], own: bool) -> DataFrame:
    """Rows ``a_<c>, b_<c>`` of each two of the ``n`` rows in neighbouring cells, in one cell too if ``own``."""
    moved = rows.select(*cell, *(F.col(c).alias(f"a_{c}") for c in carried)).withColumn("o", F.explode(_ahead(len(cell))))
    moved = moved.select(*(F.col(f"a_{c}") for c in carried), *((F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(cell)))
    there = _side(rows.select(*cell, *(F.col(c).alias(f"b_{c}") for c in carried)), n)
    out = moved.join(there, cell)
    if own:
        out = out.unionByName(rows.select(*cell, *(F.col(c).alias(f"a_{c}") for c in carried)).join(there, cell).where("a_id < b_id"))
    return out.drop(*cell)


def _similarity(d: int, limits: list[float], centre: str = "x") -> Column:
    """1 for equal records, THRESHOLD at the limit, falling to 0: 1 - (1 - THRESHOLD) * the square of the largest difference in limits."""
    steps = [F.abs(F.col(f"a_{centre}{i}") - F.col(f"b_{centre}{i}")) / t for i, t in enumerate(limits)]
    far = F.greatest(*steps) if d > 1 else steps[0]
    return F.greatest(F.lit(0.0), 1 - (1 - THRESHOLD) * far * far)


def _graph(points: DataFrame, limits: list[float]) -> tuple[DataFrame, DataFrame]:
    """The first nodes ``(key, id)`` of all records, and the edges ``(a, b, na, nb, w)``, a < b, w the sum of the similarities of their records."""
    d = len(limits)
    cell = [f"c{i}" for i in range(d)]
    box = [f(f"x{i}").alias(f"{a}{i}") for i in range(d) for a, f in (("lo", F.min), ("hi", F.max), ("s", F.sum))]
    box += [F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in range(d)]
    cells = cut(points.groupBy(*cell).agg(F.min("key").alias("id"), F.count("*").alias("n"), *box), "cells")
    n = cells.count()
    carried = ["id", "n", *(f"{a}{i}" for i in range(d) for a in ("lo", "hi", "s", "q"))]
    near = _beside(cells, n, cell, carried, False)
    gap = [F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) <= t * _SLACK for i, t in enumerate(limits)]
    links = cut(near.where(reduce(lambda p, c: p & c, gap)), "links")

    # a cell is clear if it and the cells that may hold alike records have the same such cells, all within the limits of each other: then all
    # their records are alike and no others are alike to them
    around = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)]
    ends = lambda p, q: links.select(F.col(f"{p}_id").alias("id"), F.col(f"{q}_id").alias("other"), *(F.col(f"{q}_{e}{i}").alias(f"{e}{i}") for i in range(d) for e in ("lo", "hi")))
    own = cells.select("id", F.col("id").alias("other"), *(f"{e}{i}" for i in range(d) for e in ("lo", "hi")))
    sets = ends("a", "b").union(ends("b", "a")).union(own).groupBy("id").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("other")).alias("h"), F.min("other").alias("least"), *around)
    fits = reduce(lambda p, c: p & c, (F.col(f"hi{i}") - F.col(f"lo{i}") <= t * _SLACK for i, t in enumerate(limits)))
    sets = cut(sets.select("id", F.struct("k", "h", "least").alias("set"), fits.alias("fits")), "sets")
    pairs = links.select("a_id", "b_id").join(_side(sets.select(F.col("id").alias("a_id"), F.col("set").alias("sa")), n), "a_id").join(_side(sets.select(F.col("id").alias("b_id"), F.col("set").alias("sb")), n), "b_id").where("sa <> sb")
    blurred = pairs.select(F.col("a_id").alias("id")).union(pairs.select("b_id")).union(sets.where("not fits").select("id")).distinct()
    clear = cut(sets.select("id").join(_side(blurred.withColumn("blurred", F.lit(True)), n), "id", "left").select("id", F.col("blurred").isNull().alias("clear")), "clear")

    cells = cells.join(_side(clear, n), "id")
    means = [(F.col(f"a_q{i}") / F.col("a_n") + F.col(f"b_q{i}") / F.col("b_n") - 2 * F.col(f"a_s{i}") * F.col(f"b_s{i}") / (F.col("a_n") * F.col("b_n"))) / (t * t) for i, t in enumerate(limits)]
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(*means) if d > 1 else means[0]))
    whole = links.join(_side(clear.where("clear").select(F.col("id").alias("a_id")), n), "a_id", "left_semi")
    whole = whole.select("a_id", "b_id", F.col("a_n").alias("na"), F.col("b_n").alias("nb"), (F.col("a_n") * F.col("b_n") * (1 - (1 - THRESHOLD) * mean)).alias("w"))

    placed = points.join(_side(cells.select(*cell, F.col("id").alias("cell_id"), "clear"), n), cell)
    rest = placed.where("not clear").select("key", *(f"x{i}" for i in range(d)))
    # each different place is a node, however many there are
    place = [f"x{i}" for i in range(d)]
    nodes = cut(rest.groupBy(*place).agg(F.min("key").alias("id"), F.count("*").alias("n")), "places")
    m = nodes.count()
    wide = nodes.withColumns({f"w{i}": F.floor(F.col(f"x{i}") / (t / (1 - THRESHOLD) ** 0.5 * _SLACK)) for i, t in enumerate(limits)})
    close = _beside(wide, m, [f"w{i}" for i in range(d)], ["id", "n", *place], True).withColumn("s", _similarity(d, limits)).where("s > 0")
    close = close.select("a_id", "b_id", F.col("a_n").alias("na"), F.col("b_n").alias("nb"), (F.col("s") * F.col("a_n") * F.col("b_n")).alias("w"))
    both = whole.unionByName(close)
    turn = F.col("a_id") > F.col("b_id")
    edges = both.select(
        F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), F.when(turn, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turn, F.col("na")).otherwise(F.col("nb")).alias("nb"), "w"
    )
    first = placed.where("clear").select("key", F.col("cell_id").alias("id")).unionByName(rest.join(_side(nodes.select(*place, "id"), m), place).select("key", "id"))
    return first, edges


def cluster(df: DataFrame, key: str, features: dict[str, float], usable=None) -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, cluster, x0, ...)`` and the points ``(key, x0, ...)`` of the rows where ``usable``.

    ``features`` gives each numeric column's largest difference between alike records. The similarity of two records is 1
    less half the square of their largest difference in these limits, never below 0: 1 for equal records, 0.5 at the
    limit. Clusters are those of average linkage: the two with the highest mean similarity over all pairs of their
    records merge, as long as it is at least 0.5. In each round all mutual best pairs merge in parallel, which gives what
    one merge at a time would give; a sparse graph holds the pairs of similarity above 0, and the sums of merged edges keep
    the means exact, as all other pairs add 0. Where being alike is transitive the clusters are its classes.

    Records of a grid cell of the limits' size start as one node where that can't change the result: if all records
    around that may be alike to them are within the limits of each other, and of no others, any order of merges ends with
    all of them together. So the result doesn't depend on where the grid starts. Elsewhere each different record is a
    node, whatever their number: the edges there grow with the pairs of different records within 1.41 limits.

    ``cluster`` is the smallest key of the members; records alike to none are their own. Rows with a null key or a null
    or NaN feature take no part; of rows with one key the smallest values count. Ties go by a hash of the two clusters' keys, as an order
    along the keys would merge a chain of equal steps one pair a round. An empty table gives no cluster. Infinite values are not expected.
    """
    d = len(features)
    points = cut(_points(df, key, features, F.lit(True) if usable is None else usable), "points")
    home, live = _graph(points, list(features.values()))
    home, live = cut(home, "home"), cut(live, "edges")
    pending: list[tuple[DataFrame, int]] = []

    def folded(start: DataFrame) -> DataFrame:
        for m, k in pending:
            start = start.join(_side(m.select("id", "to").where("id <> to"), k), "id", "left").withColumn("id", F.coalesce("to", "id")).drop("to")
        return start

    while True:
        mean = F.round(F.col("w") / (F.col("na") * F.col("nb")), 12)
        rank = F.struct((-mean).alias("s"), F.xxhash64("a", "b").alias("h"), "a", "b")
        able = live.where(mean >= THRESHOLD - 1e-9)
        best = able.select(F.col("a").alias("id"), rank.alias("e"), "na", "nb").union(able.select("b", rank, "na", "nb")).groupBy("id").agg(F.min(F.struct("e", "na", "nb")).alias("m"))
        mutual = best.groupBy("m").agg(F.count("*").alias("k")).where("k = 2").select(F.explode(F.array("m.e.a", "m.e.b")).alias("id"), F.col("m.e.a").alias("to"), (F.col("m.na") + F.col("m.nb")).alias("n"))
        merges = cut(mutual, "merges")
        n = merges.count()
        if not n:
            break
        pending.append((merges, n))
        if len(pending) == FOLD:
            home, pending = cut(folded(home), "home"), []
        a, b = (_side(merges.select(F.col("id").alias(e), F.col("to").alias(f"t{e}"), F.col("n").alias(f"m{e}")), n) for e in "ab")
        turned = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), F.coalesce("ma", "na").alias("na"), F.coalesce("mb", "nb").alias("nb"), "w").where("a <> b")
        swap = F.col("a") > F.col("b")
        turned = turned.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), "w")
        live = cut(turned.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("w").alias("w")), "edges")
    return points.join(folded(home).hint("merge"), "key").select("key", F.col("id").alias("cluster"), *(f"x{i}" for i in range(d))), points


def describe(members: DataFrame, limits: list[float], typical: int = 3) -> DataFrame:
    """``(cluster, size, rk, key)`` of clusters of two or more: their size and the ``typical`` members nearest to the mean."""
    d = len(limits)
    mean = members.groupBy("cluster").agg(F.count("*").alias("size"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(d))).where("size > 1")
    far = reduce(lambda a, b: a + b, (F.pow((F.col(f"x{i}") - F.col(f"m{i}")) / t, 2) for i, t in enumerate(limits)))
    near = members.join(mean, "cluster").withColumn("nearness", -F.round(far, 9))
    top = top_n_per_group(near, ["cluster"], "key", "nearness", typical)
    return top.join(mean.select("cluster", "size"), "cluster").select("cluster", "size", "rk", "key")
