"""The best items within every group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.session import BROADCAST_ROWS, cut

#: Score classes per doubling of the score.
PER_OCTAVE = 32
#: Items that one 64-bit sketch of a histogram bar can safely tell apart.
PER_LANE = 24
#: Parts in which a group is ranked before its parts are ranked together.
SALTS = 16


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """``(*groups, rk, item, score)``: the ``n`` highest-scoring items of each group, rk 1 to n, equal scores by item ascending.

    A histogram of scores per group, each bar with a sketch of its items, gives a score class that at
    least ``n`` distinct items reach; rows below it are dropped before anything is shuffled or sorted. The bars
    follow the logarithm of the score, so one pass builds them and their number doesn't depend on the
    rows. What is left is ranked within salted parts of a group and then across the parts, so that a
    group of equal scores, which no threshold can thin, stays distributed.

    An item counts once per group, with its highest score. Rows with a null group, item or score, or a
    NaN score, take no part; infinite scores do. Groups with fewer items give all. Empty in, empty out.
    Other columns aren't read.
    """
    g = [f"__g{i}" for i in range(len(groups))]
    s = F.col("__s")
    rows = df.select(*(F.col(c).alias(a) for c, a in zip(groups, g)), F.col(item).alias("__item"), F.col(score).cast("double").alias("__s"))
    rows = rows.where(s.isNotNull() & ~F.isnan(s)).dropna(subset=[*g, "__item"])
    rows = rows.withColumn("__bar", F.floor(F.signum(s) * F.log1p(F.abs(s)) * (PER_OCTAVE / math.log(2))))

    lanes = max(1, math.ceil(n / PER_LANE))
    h = F.pmod(F.xxhash64("__item"), F.lit(64 * lanes))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    sketches = [F.bit_or(F.when(F.floor(h / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"__k{i}") for i in range(lanes)]
    above = W.partitionBy(*g).orderBy(F.desc("__bar")).rowsBetween(W.unboundedPreceding, 0)
    surely = sum((F.bit_count(F.bit_or(f"__k{i}").over(above)) for i in range(lanes)), F.lit(0))
    bars = rows.groupBy(*g, "__bar").agg(F.count("*").alias("__c"), *sketches).withColumns({"__sure": surely, "__upto": F.sum("__c").over(above)})
    enough = F.col("__sure") >= n
    floors = bars.groupBy(*g).agg(F.max(F.when(enough, F.col("__bar"))).alias("__floor"), (F.sum("__c") - F.min(F.when(enough, F.col("__upto")))).alias("__below"))
    # the floors that drop the most rows, as many as may be broadcast; a group without one keeps all its rows, and its rank is the same
    floors = cut(floors.where("__below > 0").orderBy(F.desc("__below"), *g).limit(BROADCAST_ROWS), "floors")
    kept = rows.join(F.broadcast(floors), g, "left").where("__floor is null or __bar >= __floor").groupBy(*g, "__item").agg(F.max("__s").alias("__s"))

    order = [F.desc("__s"), F.asc("__item")]
    part = kept.withColumn("__salt", F.pmod(F.xxhash64("__item"), F.lit(SALTS)))
    part = part.withColumn("__r", F.row_number().over(W.partitionBy(*g, "__salt").orderBy(*order))).where(F.col("__r") <= n)
    top = part.withColumn("__r", F.row_number().over(W.partitionBy(*g).orderBy(*order))).where(F.col("__r") <= n)
    return top.select(*(F.col(a).alias(c) for c, a in zip(groups, g)), F.col("__r").alias("rk"), F.col("__item").alias(item), F.col("__s").alias(score))
