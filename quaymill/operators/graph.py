"""Graph operators on edge tables ``(src, dst[, weight])``. Rounds end in a written table."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.session import attach, cut

#: Most edges of a graph that is handed whole to every task.
WHOLE_GRAPH = 200_000


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("src", "dst", *more).union(edges.select("dst", "src", *more))


def degree(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """``(id, degree)``. ``directed`` counts every edge at both its ends, a street in both directions twice;
    otherwise neighbours are counted. Nodes without an edge have 0 if ``nodes (id)`` is given."""
    ends = both_ways(edges).toDF("id", "other")
    d = ends.groupBy("id").agg((F.count("*") if directed else F.count_distinct("other")).alias("degree"))
    return d if nodes is None else nodes.select("id").distinct().join(d, "id", "left").fillna(0, ["degree"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: the smallest id that can be reached, over edges in either direction.

    Alternating large-star and small-star steps: every node points its larger neighbours, then its
    smaller ones, to the least of them, until nothing changes. The number of rounds follows the logarithm
    of the size, no step gathers a component, and edges never grow in number.
    """
    e = cut(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "pairs")
    before = None
    while True:
        near = e.union(e.select("v", "u"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
    if nodes is not None:
        out = nodes.select("id").where("id is not null").distinct().join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out


def bounded_distances(sources: DataFrame, edges: DataFrame, cutoff: float) -> DataFrame:
    """``(source, id, distance)``: shortest paths from ``sources (source, id)`` of at most ``cutoff``, along ``edges (src, dst, weight >= 0)``.

    All sources are relaxed together; a round extends only the distances that the round before improved.
    """
    start = sources.where("source is not null and id is not null").select("source", "id", F.lit(0.0).alias("distance")).distinct()
    known = cut(start.withColumn("new", F.lit(True)), "reach")
    e = cut(edges.where("src is not null and dst is not null and weight >= 0").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight")), "edges")
    while not known.where("new").isEmpty():
        step = known.where("new").join(e, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("d")).where(F.col("d") <= cutoff)
        both = known.select("source", "id", F.col("distance").alias("old"), F.lit(None).cast("double").alias("d")).union(step.select("source", "id", F.lit(None).cast("double"), "d"))
        best = both.groupBy("source", "id").agg(F.min("old").alias("old"), F.min("d").alias("d"))
        better = F.col("old").isNull() | (F.col("d") < F.col("old"))
        known = cut(best.select("source", "id", F.least("old", "d").alias("distance"), F.coalesce(better, F.lit(False)).alias("new")), "reach")
    return known.drop("new")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges ``(src, dst, weight)`` of a minimum spanning forest; equal weights go by (src, dst). Each round every tree takes its least edge outwards."""
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    live = cut(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select("*", F.col("src").alias("a"), F.col("dst").alias("b")), "live")
    taken: DataFrame | None = None
    while not live.isEmpty():
        key = F.struct("weight", "src", "dst").alias("k")
        best = live.select(F.col("a").alias("c"), key, "a", "b").union(live.select("b", key, "a", "b")).groupBy("c").agg(F.min(F.struct("k", "a", "b")).alias("m"))
        chosen = cut(best.select("m.k.src", "m.k.dst", "m.k.weight", F.col("m.a").alias("a"), F.col("m.b").alias("b")).distinct(), "chosen")
        tree = chosen.select("src", "dst", "weight")
        taken = tree if taken is None else taken.union(tree)
        label = components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for end in "ab":
            live = live.join(label.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        live = cut(live.where("a <> b"), "live")
    return (e.limit(0) if taken is None else taken).select("src", "dst", "weight")


def _core(edges: list[tuple]) -> tuple[list, list, list]:
    """The graph of the nodes that don't just continue a path: ``(nodes, adjacent, chains)``, the core nodes first. ``adjacent`` has ``(other, length, chain or -1)``
    of core nodes by index, ``chains`` ``(u, v, length, interior indices, their distances from u)``."""
    near = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    core = {x for x, e in near.items() if len(e) != 2 or min(e.values()) <= 0}
    seen, walks = set(), []

    def walk(u, x):
        inside, at, before = [], near[u][x], u
        offs = []
        while x not in core:
            inside.append(x)
            offs.append(at)
            seen.add(x)
            nxt = next(y for y in near[x] if y != before)
            at += near[x][nxt]
            before, x = x, nxt
        return u, x, at, inside, offs

    for x in near:  # rings have no node of their own in the core
        if x not in core and x not in seen:
            trail, y, before = [x], next(iter(near[x])), x
            while y not in core and y != x:
                trail.append(y)
                before, y = y, next(z for z in near[y] if z != before)
            if y == x:
                core.add(x)
            else:
                seen.update(trail)
    seen.clear()
    for u in list(core):
        for x in near[u]:
            if x in core:
                if repr(u) <= repr(x):
                    walks.append((u, x, near[u][x], [], []))
            elif x not in seen:
                walks.append(walk(u, x))
    taken, kept = set(), []
    for u, v, length, inside, offs in sorted(walks, key=lambda c: len(c[3])):  # loops and second ways between two nodes are taken apart
        if inside and (u == v or frozenset((u, v)) in taken):
            core.update(inside)
            path, at = [u, *inside, v], [0.0, *offs, length]
            kept += [(p, q, near[p][q], [], []) for p, q in zip(path, path[1:])]
        else:
            kept.append((u, v, length, inside, offs))
            taken.add(frozenset((u, v)))
    beside = defaultdict(list)  # neighbours over a chain follow each other, as their searches are used together
    for u, v, _, inside, _ in kept:
        beside[u].append((bool(inside), v))
        beside[v].append((bool(inside), u))
    ordered: dict = {}
    for x in sorted(core):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in ordered:
                ordered[y] = True
                todo += [z for _, z in sorted(beside[y]) if z not in ordered]
    nodes = [*ordered, *(x for c in kept for x in c[3])]
    index = {x: i for i, x in enumerate(nodes)}
    adjacent, chains = [[] for _ in core], []
    for u, v, length, inside, offs in kept:
        c = -1
        if inside:
            c = len(chains)
            chains.append((index[u], index[v], length, [index[x] for x in inside], offs))
        adjacent[index[u]].append((index[v], length, c))
        adjacent[index[v]].append((index[u], length, c))
    return nodes, adjacent, chains


def _shortest(adjacent: list, source: int) -> tuple[list, list, list, list]:
    """Distances from ``source``, numbers of shortest paths, what comes before each node on them as ``(node, chain)``, and the nodes by distance."""
    m = len(adjacent)
    best, paths, before, done, order = [math.inf] * m, [0.0] * m, [[] for _ in range(m)], [False] * m, []
    best[source], paths[source] = 0.0, 1.0
    queue = [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        if v != source:
            paths[v] = sum(paths[p] for p, _ in before[v])
        for w, length, c in adjacent[v]:
            if not done[w]:
                t = d + length
                if t < best[w]:
                    best[w], before[w] = t, [(v, c)]
                    heapq.heappush(queue, (t, w))
                elif t == best[w]:
                    before[w].append((v, c))
    return best, paths, before, order


class _Positions:
    """Betweenness and closeness by exits: a path from within a chain leaves it at one end, goes between core nodes, and enters the other chain at one end.
    So only core nodes are searched from; paths of the nodes in chains are counted at the ends by which they are shortest."""

    def __init__(self, edges: list[tuple]):
        self.nodes, self.adjacent, self.chains = _core(edges)
        self.n, self.m = len(self.nodes), len(self.adjacent)
        k = self.n - self.m
        self.ends = np.zeros((2, k), int)
        self.offs = np.zeros((2, k))
        self.of = [[] for _ in range(self.m)]
        for c, (u, v, length, inside, offs) in enumerate(self.chains):
            at = np.array(inside) - self.m
            self.ends[0, at], self.ends[1, at] = u, v
            self.offs[0, at], self.offs[1, at] = offs, length - np.array(offs)
            self.of[u].append(c)
            self.of[v].append(c)
        self.between, self.close = np.zeros(self.n), np.zeros(self.n)
        self.through, self.entered = np.zeros(len(self.chains)), np.zeros((2, k))
        self.cache: dict = {}

    def _from(self, e: int):
        if e not in self.cache:
            if len(self.cache) > 6:
                self.cache.pop(next(iter(self.cache)))
            best, paths, before, order = _shortest(self.adjacent, e)
            d, s = np.array(best), np.array(paths)
            way = d[self.ends] + self.offs
            least = way.min(0)
            parts = np.where(way <= least * (1 + 1e-12), s[self.ends], 0.0)
            total = parts.sum(0)
            self.cache[e] = np.r_[d, least], np.r_[s, total], parts / np.where(total > 0, total, 1), s, before, order
        return self.cache[e]

    def _closeness(self, x: int, dist: np.ndarray) -> None:
        ok = np.isfinite(dist)
        total, reached = dist[ok].sum(), ok.sum() - 1
        self.close[x] = (reached / total) * (reached / (self.n - 1)) if total > 0 else 0.0

    def add(self, e: int) -> None:
        """What the paths that leave their chain at ``e``, or start there, add."""
        dist, paths, share, sigma, before, order = self._from(e)
        m = self.m
        reachable = np.isfinite(dist)
        weight = reachable.astype(float)  # paths to each node whose first core node is e
        weight[e] = 0.0
        self._closeness(e, dist)
        inner = np.zeros(self.n)
        extra = np.zeros(m)
        for c in self.of[e]:
            u, v, length, inside, offs = self.chains[c]
            side = 0 if e == u else 1
            other = v if side == 0 else u
            far, far_paths = self._from(other)[:2]
            at = np.array(inside)
            a = self.offs[side, at - m]
            b = self.offs[1 - side, at - m]
            with np.errstate(invalid="ignore"):
                diff = np.where(reachable, far - dist, -np.inf)
            inside_mask = np.zeros(self.n, bool)
            inside_mask[at] = True
            for i, x in enumerate(inside):
                gap = a[i] - b[i]
                tie = np.abs(diff - gap) <= 1e-12 * (dist + a[i])
                f = np.where(tie, paths / np.maximum(paths + far_paths, 1), diff > gap)
                f[~reachable | inside_mask] = 0.0
                own = np.minimum(dist + a[i], far + b[i]) if side == 0 else None
                # within the chain: straight on, or round by the rest of the graph
                straight = np.abs(a - a[i])
                round_e, round_o = a[i] + dist[other] + b, b[i] + dist[other] + a
                least = np.minimum(np.minimum(straight, round_e), round_o)
                ways = [np.where(z <= least * (1 + 1e-12), k, 0.0) for z, k in ((straight, 1.0), (round_e, paths[other]), (round_o, paths[other]))]
                ways[0][i], ways[1][i], ways[2][i] = 1.0, 0.0, 0.0
                total = sum(ways)
                by_e = ways[1] / total
                extra[other] += by_e.sum()
                self.entered[1 - side, at - m] += by_e
                out = f.sum() + by_e.sum()
                self.between[at[a < a[i]]] += out  # between x and e
                inner += f
                self.between[e] += out - f[e]
                if side == 0:
                    own[at] = least
                    self._closeness(x, own)
                    for j in np.flatnonzero(ways[0] > 0):
                        if j != i:
                            lo, hi = min(a[i], a[j]), max(a[i], a[j])
                            self.between[at[(a > lo) & (a < hi)]] += ways[0][j] / total[j]
        weight += inner
        into = weight[m:] * share
        self.entered += into
        entering = np.bincount(self.ends[0], into[0], m) + np.bincount(self.ends[1], into[1], m) + extra
        # an end that is e itself is an inner node only for paths from within chains, which were counted above
        passed = entering.copy()
        passed[e] = 0.0
        self.between[:m] += passed
        load = (weight[:m] + entering).tolist()
        carried = [0.0] * m
        for w in reversed(order):
            for p, c in before[w]:
                flow = sigma[p] / sigma[w] * (load[w] + carried[w])
                carried[p] += flow
                if c >= 0:
                    self.through[c] += flow
        carried[e] = 0.0
        self.between[:m] += carried

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.between.copy()
        for c, (_, _, _, inside, _) in enumerate(self.chains):
            at = np.array(inside) - self.m
            first, last = self.entered[0, at], self.entered[1, at]
            out[inside] += self.through[c] + (first.sum() - first.cumsum()) + (last.cumsum() - last)
        return out / ((self.n - 1) * (self.n - 2)) if self.n > 2 else out * 0, self.close


def centrality(edges: DataFrame) -> DataFrame:
    """``(id, betweenness, closeness)`` of an undirected weighted graph of at most ``WHOLE_GRAPH`` edges.

    Betweenness is normalised by the pairs of other nodes; closeness is scaled by the reached share.
    Each task holds the graph, whose size is checked first, and searches from its share of the nodes at which paths branch or end; see ``_Positions``.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    e = cut(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "graph")
    if (m := e.count()) > WHOLE_GRAPH:
        raise ValueError(f"{m} edges: exact centrality is for graphs of up to {WHOLE_GRAPH}")
    spark = edges.sparkSession
    rows = sorted(tuple(r) for r in e.collect())
    whole = spark.sparkContext.broadcast(rows)
    kind = dict(e.dtypes)["src"]

    def run(batches):
        graph = None
        for batch in batches:
            graph = graph or _Positions(whole.value)
            for i in batch["id"]:
                graph.add(int(i))
        if graph:
            between, close = graph.result()
            yield pd.DataFrame({"id": graph.nodes, "betweenness": between, "closeness": close})

    branching = len(_core(rows)[1])
    parts = spark.range(0, branching, 1, 4 * spark.sparkContext.defaultParallelism).mapInPandas(run, f"id {kind}, betweenness double, closeness double")
    return parts.groupBy("id").agg(F.sum("betweenness").alias("betweenness"), F.sum("closeness").alias("closeness"))


def same_name_links(stations: DataFrame) -> DataFrame:
    """Edges of weight 1 between each two consecutive ``(id, name)`` of one name, by id: a transfer without a walk. Of one id and name one counts."""
    w = W.partitionBy("name").orderBy("id")
    chain = stations.where("name is not null and id is not null").select("id", "name").distinct().withColumn("dst", F.lead("id").over(w))
    return chain.where("dst is not null").select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
