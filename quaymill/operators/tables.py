"""Relational building blocks: ordered statistics that stay distributed, latest-wins merges, reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.session import attach, cut


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys match null keys."""
    named = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)))
    return left.join(attach(named), on, how).drop(*(f"__r{i}" for i in range(len(keys))))


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over all rows of the group that sort before this one's ``order``.

    A window over a group would sort the whole group in one task. Here the rows are range-partitioned
    by (groups, order), so that equal rows share a partition; each partition is summed in place and
    the sums of the partitions before it are added. ``order`` is ascending, nulls first, and must tell
    the rows of a group apart.
    """
    ranged = cut(df.repartitionByRange(*groups, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    before = W.partitionBy(*groups).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(*groups, "__p").agg(F.sum(value).alias("__t"))
    offsets = offsets.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    joined = null_safe_join(ranged, offsets, [*groups, "__p"])
    within = W.partitionBy(*groups, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("__o") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__p", "__o")


def average_rank(df: DataFrame, groups: list[str], value: str, out: str, pct: bool = True) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group, as a share of the group's non-null values if ``pct``.

    Nulls and NaN have no rank and don't count. Neither ``percent_rank`` nor ``cume_dist`` gives it.
    Values are counted first and ranked once each.
    """
    v = F.col(value).cast("double")
    known = df.withColumn("__v", F.when(~F.isnan(v), v))
    counts = known.where("__v is not null").groupBy(*groups, "__v").agg(F.count("*").alias("__n"))
    ranked = running_sum(counts, groups, ["__v"], "__n", "__below")
    rank = F.col("__below") + (F.col("__n") + 1) / 2
    if pct:
        if groups:
            ranked = null_safe_join(ranked, counts.groupBy(*groups).agg(F.sum("__n").alias("__all")), groups)
        else:
            ranked = ranked.withColumn("__all", counts.agg(F.sum("__n")).scalar())
        rank = rank / F.col("__all")
    ranked = ranked.select(*groups, "__v", rank.alias(out)).where("__v is not null")
    return null_safe_join(known, ranked, [*groups, "__v"]).drop("__v")


def row_numbers(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with 1, 2, ... by ``order`` (ascending) in each group, without sorting a group in one task."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), groups, order, "__one", out).withColumn(out, F.col(out) + 1).drop("__one")


def quantile_bands(df: DataFrame, order: list[str], out: str, bands: int = 5) -> DataFrame:
    """``df`` with a band 1 to ``bands`` by rank: the rank-based quantile cut, whose group sizes differ from ``ntile``'s."""
    n = df.agg(F.count("*")).scalar()
    ranked = row_numbers(df, [], order, "__rn")
    return ranked.withColumn(out, F.greatest(F.ceil((F.col("__rn") - 1) * bands / F.greatest(n - 1, F.lit(1))), F.lit(1)).cast("int")).drop("__rn")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """``df`` with aggregates over all its rows as columns: scalar subqueries, not a window without partitions."""
    return df.withColumns({k: df.agg(c).scalar() for k, c in totals.items()})


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; keys compare null-safe. Only the best row of a key leaves a task."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(store: DataFrame, fresh: DataFrame, keys: list[str], partial: str, stamp: str) -> DataFrame:
    """``store`` and ``fresh`` merged to one row per key: complete rows before partial ones, then the latest ``stamp``; fresh rows win ties."""
    both = store.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return first_by(both, keys, F.coalesce(F.col(partial), F.lit(True)).asc(), F.col(stamp).desc_nulls_last(), F.desc("__new")).drop("__new")


def complete_days(df: DataFrame, keys: list[str], hour: str, hours: int, *aggs: Column) -> DataFrame:
    """Aggregates of the ``keys`` (station and day) that have all ``hours`` distinct hours: one pass, no semi-join."""
    return df.groupBy(*keys).agg(F.count_distinct(hour).alias("__h"), *aggs).where(F.col("__h") == hours).drop("__h")


def outer_fill(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer equi-join; the values of the missing side are 0."""
    return a.join(b, keys, "full_outer").fillna(0, subset=values)


def zero_filled(dimension: DataFrame, key: str, facts: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates of ``facts`` for every key of ``dimension``, 0 where it has none. Facts are aggregated before they are joined."""
    got = facts.groupBy(key).agg(*aggs)
    return dimension.select(key).distinct().join(got, key, "left").fillna(0)


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, str]) -> DataFrame:
    """Wide to long: ``ids, feature, value, dimension``; ``columns`` gives each feature's dimension. Nulls stay, columns that are absent are passed over."""
    there = [c for c in columns if c in df.columns]
    long = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in there)).unpivot(ids, there, "feature", "value")
    names = F.create_map(*(F.lit(x) for c in there for x in (c, columns[c])))
    return long.withColumn("dimension", names[F.col("feature")])


def calendar(df: DataFrame, day: str) -> DataFrame:
    """One row for each day from the first to the last of ``day``, with its parts; weeks are ISO weeks."""
    span = df.agg(F.min(day).cast("date").alias("lo"), F.max(day).cast("date").alias("hi"))
    d = F.col("date")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("date")).select(
        "date",
        F.year(d).alias("year"),
        F.date_format(d, "MMMM").alias("month"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.when(F.weekday(d) < 5, "Weekday").otherwise("Weekend").alias("day_type"),
        F.weekofyear(d).alias("iso_week"),
    )


def entropy(shares: Column, n: Column) -> Column:
    """Shannon entropy of an aggregated ``sum(-p ln p)`` over ``n`` classes, scaled to 0..1; one class has none."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(shares / F.log(n.cast("double")))


def mix_entropy(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``(key, kinds, entropy)``: how evenly a key's rows are spread over its kinds; null kinds don't count."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(key, kind).count()
    total = counts.groupBy(key).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log(F.col("count").cast("double"))).alias("s"), F.count("*").alias("kinds"))
    # -sum(p ln p) = ln n - sum(c ln c) / n
    return total.select(key, "kinds", entropy(F.log(F.col("n").cast("double")) - F.col("s") / F.col("n"), F.col("kinds")).alias("entropy"))


def adjusted_skewness(c: str) -> Column:
    """Bias-adjusted skewness."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def fit_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row ``n, r2, mae, rmse, mape, spearman`` of the rows where both are known. mape leaves out actual zeros."""
    a, p = F.col("a"), F.col("p")
    rows = cut(df.select(F.col(actual).cast("double").alias("a"), F.col(predicted).cast("double").alias("p")).where("a is not null and p is not null and not isnan(a) and not isnan(p)"), "pairs")
    ranks = average_rank(average_rank(rows, [], "a", "ra", False), [], "p", "rp", False)
    return ranks.agg(
        F.count("*").alias("n"),
        (1 - F.sum(F.pow(a - p, 2)) / (F.var_pop("a") * F.count("*"))).alias("r2"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"),
        (F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100).alias("mape"),
        F.corr("ra", "rp").alias("spearman"),
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, nulls)`` in one pass; NaN counts as null."""
    kinds = dict(df.dtypes)
    test = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns}
    one = df.agg(*(F.count_if(t).alias(c) for c, t in test.items()))
    return one.unpivot([], list(columns), "column", "nulls")
