"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.session import attach, cut

#: Classes of the sampling key in a source; only one of them is sorted.
CLASSES = 4096
#: Keys of so many means and more have classes of their own, this many for each doubling.
TAIL, TAIL_CLASSES = 8.0, 256


def budgets(sources: list[dict], total: float | None) -> dict[str, float]:
    """Tokens to take of each source: ``dict(source, share, cap)`` rows in, cap the most it can give.

    Without ``total`` it is the largest at which every source that has anything meets its share. A
    larger one fills sources to their caps and gives what they lack to the others by their shares.
    """
    live = [s for s in sources if s["cap"] > 0 and s["share"] > 0]
    out = {s["source"]: 0.0 for s in sources}
    if not live:
        return out
    weight = sum(s["share"] for s in live)
    left = min(s["cap"] * weight / s["share"] for s in live) if total is None else float(total)
    while live and left > 1e-9:
        weight = sum(s["share"] for s in live)
        full = [s for s in live if s["cap"] <= left * s["share"] / weight * (1 + 1e-12)]
        if not full:
            for s in live:
                out[s["source"]] = left * s["share"] / weight
            break
        for s in full:
            out[s["source"]] = float(s["cap"])
        left -= sum(s["cap"] for s in full)
        live = [s for s in live if s not in full]
    return out


def _class(x: Column) -> Column:
    """Grows with the key: of about equal size for keys near the mean, by the logarithm for those far beyond it, as records of very small weight have."""
    near = F.floor((1 - F.exp(-x)) * CLASSES)
    return F.when(x > TAIL, CLASSES + F.floor(F.log2(x / TAIL) * TAIL_CLASSES)).otherwise(near)


def mix(records: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """A selection ``(source, id, tokens, copies)`` and its report.

    ``records (id, source, tokens, weight)``; ``targets (source, target_share, max_repeats)``, a table
    of settings. A source whose budget exceeds what it holds gives whole epochs first, each record
    once per epoch; the fraction that remains is an Efraimidis-Spirakis sample: records by ascending
    exponential key, scaled by their weight, until the budget is met. The last record is taken if that
    comes nearer. No source is sorted: a histogram of its keys tells the class in which the budget
    ends, lower classes are taken whole, and only that class is ordered by (key, id).

    No record is used more than ``max_repeats`` times. Records of null or untargeted sources, without
    tokens or with a null id are not used; null or non-positive weights count as very small. Of
    repeated targets the first by (share, repeats) counts; target shares are taken relative to each
    other. The report has each target: ``source, target_share, available_tokens, budget_tokens,
    selected_tokens, actual_share, records, most_copies``.
    """
    goal = targets.where("source is not null").groupBy("source").agg(F.min(F.struct(F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))).alias("t"))
    goal = cut(goal.select("source", F.coalesce("t.share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("t.most", F.lit(0)), F.lit(0)).alias("most")), "targets")
    weight = F.coalesce(F.when((F.col("weight") > 0) & ~F.isnan("weight"), F.col("weight")), F.lit(1e-9))
    usable = records.where("id is not null and source is not null and tokens > 0").select("id", "source", F.col("tokens").cast("bigint").alias("tokens"), weight.alias("weight"))
    usable = usable.join(attach(goal.select("source")), "source", "left_semi")
    sums = usable.groupBy("source").agg(F.sum("tokens").alias("held"), F.avg("weight").alias("mean"))
    rows = goal.join(sums, "source", "left").collect()  # one row per target
    plan = budgets([{"source": r["source"], "share": r["share"], "cap": r["most"] * (r["held"] or 0)} for r in rows], total)
    steps = []
    for r in rows:
        held, budget = r["held"] or 0, plan[r["source"]]
        epochs = min(r["most"], int(budget // held)) if held else 0
        steps.append((r["source"], float(budget), epochs, float(budget - epochs * held) if epochs < r["most"] else 0.0, float(r["mean"] or 1.0), held))
    spark = records.sparkSession
    steps = spark.createDataFrame(steps, "source string, budget double, epochs int, part double, mean double, held bigint").coalesce(1)

    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / F.col("weight")
    keyed = usable.join(F.broadcast(steps), "source").withColumn("key", key).withColumn("class", _class(F.col("key") * F.col("mean")))
    by = W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, 0)
    bars = keyed.where("part > 0").groupBy("source", "class").agg(F.sum("tokens").alias("t"), F.first("part").alias("part")).withColumn("upto", F.sum("t").over(by))
    ends = cut(bars.where("upto >= part").groupBy("source").agg(F.min("class").alias("end"), F.min(F.struct("class", (F.col("upto") - F.col("t")).alias("before"))).alias("b")).select("source", "end", "b.before"), "ends")
    placed = keyed.join(attach(ends), "source", "left")
    lower = placed.where("part <= 0 or end is null or class <> end").withColumn("more", F.when(F.col("part") <= 0, 0).when(F.col("end").isNull() | (F.col("class") < F.col("end")), 1).otherwise(0))
    order = W.partitionBy("source").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)
    last = placed.where("part > 0 and class = end").withColumn("run", F.col("before") + F.sum("tokens").over(order)).withColumn("more", (F.col("run") - F.col("tokens") / 2 <= F.col("part")).cast("int")).drop("run")
    chosen = lower.unionByName(last).withColumn("copies", F.col("epochs") + F.col("more")).where("copies > 0").select("source", "id", "tokens", "copies")
    chosen = cut(chosen, "mix")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    none = F.lit(0).cast("bigint")
    report = goal.join(steps, "source").join(got, "source", "left")
    everything = F.sum(F.coalesce("selected", none)).over(W.partitionBy(F.lit(1)))
    report = report.select(
        "source", F.col("share").alias("target_share"), F.col("held").alias("available_tokens"), F.round("budget").cast("bigint").alias("budget_tokens"),
        F.coalesce("selected", none).alias("selected_tokens"), F.coalesce(F.col("selected") / everything, F.lit(0.0)).alias("actual_share"),
        F.coalesce("records", none).alias("records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return chosen, report
