"""Joins, aggregations, windows, top-k, sets and reshaping over the generic and the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.operators import geometry as G
from quaymill.operators import tables as T
from quaymill.plans.registry import Registry
from quaymill.session import table

R = Registry()
S = SparkSession


def _r(c, n: int = 4):
    return F.round(c, n)


def _stations(spark: S, d: str, *columns: str) -> DataFrame:
    """One row per station with a known score, other columns as asked; NaN is null."""
    t = table(spark, d, "chennai_powerbi_stations")
    known = {c for c, k in t.dtypes if k == "double"}
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c) if c in known else F.col(c)
    rows = t.where("station_id is not null and predicted_boardings is not null and not isnan(predicted_boardings)")
    return rows.select("station_id", F.col("predicted_boardings").alias("p"), *(clean(c) for c in columns)).distinct()


def _st(*columns: str, double: tuple[str, ...] = ()) -> str:
    cols = ", ".join([*columns, *(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in double)])
    return f"(SELECT DISTINCT station_id, predicted_boardings AS p{', ' + cols if cols else ''} FROM chennai_powerbi_stations WHERE station_id IS NOT NULL AND predicted_boardings IS NOT NULL AND NOT isnan(predicted_boardings))"


def _hourly(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("station"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value", "user_id", "event_id")


@R.query("""SELECT event_type AS station, ts::DATE AS day, round(sum(value), 4) AS boardings, count(*) AS n FROM events
GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) = 24""")
def q_complete_station_days(spark: S, d: str) -> DataFrame:
    return T.complete_days(_hourly(spark, d), ["station", "day"], "hour", 24, _r(F.sum("value")).alias("boardings"), F.count("*").alias("n"))


@R.query("""WITH a AS (SELECT user_id, ts::DATE AS day, hour(ts) AS hour, count(*) AS entries FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT user_id, ts::DATE AS day, hour(ts) AS hour, count(*) AS exits FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, day, hour, coalesce(entries, 0) AS entries, coalesce(exits, 0) AS exits, coalesce(entries, 0) + coalesce(exits, 0) AS throughput FROM a FULL JOIN b USING (user_id, day, hour)""")
def q_full_outer_hourly(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type")
    keys = ["user_id", "day", "hour"]
    a, b = (e.where(F.col("event_type") == t).groupBy(*keys).agg(F.count("*").alias(n)) for t, n in (("view", "entries"), ("purchase", "exits")))
    return T.outer_fill(a, b, keys, ["entries", "exits"]).withColumn("throughput", F.col("entries") + F.col("exits"))


_DAILY = "WITH day AS (SELECT event_type AS station, ts::DATE AS day, sum(value) AS b FROM events GROUP BY 1, 2)"


@R.query(_DAILY + """ SELECT station, round(avg(b), 6) AS all_mean, count(DISTINCT day) AS all_days, round(avg(b) FILTER (isodow(day) < 6), 6) AS weekday_mean,
count(*) FILTER (isodow(day) < 6) AS weekday_days, round(avg(b) FILTER (isodow(day) >= 6), 6) AS weekend_mean,
round(avg(b) FILTER (isodow(day) >= 6) / avg(b) FILTER (isodow(day) < 6), 4) AS weekend_ratio, round(stddev_samp(b), 4) AS sd FROM day GROUP BY 1""")
def q_station_target(spark: S, d: str) -> DataFrame:
    day = _hourly(spark, d).groupBy("station", "day").agg(F.sum("value").alias("b")).withColumn("w", F.weekday("day") < 5)
    week, end = F.when(F.col("w"), F.col("b")), F.when(~F.col("w"), F.col("b"))
    return day.groupBy("station").agg(
        _r(F.avg("b"), 6).alias("all_mean"), F.count_distinct("day").alias("all_days"), _r(F.avg(week), 6).alias("weekday_mean"), F.count(week).alias("weekday_days"),
        _r(F.avg(end), 6).alias("weekend_mean"), _r(F.try_divide(F.avg(end), F.avg(week))).alias("weekend_ratio"), _r(F.stddev_samp("b")).alias("sd"),
    )


@R.query("""WITH day AS (SELECT user_id, ts::DATE AS day, sum(value) AS b FROM events GROUP BY 1, 2), s AS (SELECT min(day) AS lo, max(day) AS hi FROM day)
SELECT user_id, min(day) AS first_active, count(*) AS active_days, round(avg(b) FILTER (day > hi - 14) / avg(b) FILTER (day < lo + 14), 4) AS growth_ratio,
coalesce(min(day) > lo + 14, false) AS opened_mid_window, NOT (coalesce(min(day) > lo + 14, false) OR count(*) < 0.25 * (hi - lo + 1)) AS is_mature FROM day, s GROUP BY user_id, lo, hi""")
def q_maturity_flags(spark: S, d: str) -> DataFrame:
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("b"))
    day = T.with_totals(day, lo=F.min("day"), hi=F.max("day"))
    late, early = (F.when(c, F.col("b")) for c in (F.col("day") > F.date_sub("hi", 14), F.col("day") < F.date_add("lo", 14)))
    opened = F.coalesce(F.min("day") > F.date_add(F.min("lo"), 14), F.lit(False))
    return day.groupBy("user_id").agg(
        F.min("day").alias("first_active"), F.count("*").alias("active_days"), _r(F.try_divide(F.avg(late), F.avg(early))).alias("growth_ratio"),
        opened.alias("opened_mid_window"), (~(opened | (F.count("*") < 0.25 * (F.datediff(F.max("hi"), F.max("lo")) + 1)))).alias("is_mature"),
    )


@R.query("""SELECT date AS day, is_partial, (sum(boardings) FILTER (boardings >= 0))::DOUBLE AS total, count(DISTINCT station_cmrl) AS stations, CASE WHEN is_partial THEN 'partial day' ELSE 'complete day' END AS kind FROM fact_observed WHERE date IS NOT NULL GROUP BY ALL""")
def q_daily_summary(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "fact_observed").where("date is not null").select(F.col("date").alias("day"), "is_partial", F.when(F.col("boardings") >= 0, F.col("boardings")).alias("b"), "station_cmrl")
    return o.groupBy("day", "is_partial").agg(F.sum("b").cast("double").alias("total"), F.count_distinct("station_cmrl").alias("stations")).withColumn("kind", F.when(F.col("is_partial"), "partial day").otherwise("complete day"))


@R.query("""WITH day AS (SELECT lpad(line, 2, '0') AS line, date, sum(boardings) AS t FROM fact_observed WHERE isodow(date) < 6 AND NOT is_partial AND boardings >= 0 AND line IS NOT NULL GROUP BY ALL)
SELECT line, round(avg(t), 2) AS weekday_mean FROM day GROUP BY 1""")
def q_weekday_mean(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "fact_observed").where((F.weekday("date") < 5) & ~F.col("is_partial") & (F.col("boardings") >= 0) & F.col("line").isNotNull())
    return o.groupBy(F.lpad("line", 2, "0").alias("line"), "date").agg(F.sum("boardings").alias("t")).groupBy("line").agg(F.round(F.avg("t"), 2).alias("weekday_mean"))


_OBS = "SELECT date, station_cmrl, boardings FROM fact_observed WHERE NOT is_partial AND boardings >= 0 AND date IS NOT NULL AND station_cmrl IS NOT NULL"


@R.query(f"""WITH o AS ({_OBS}), day AS (SELECT station_cmrl, date, isodow(date) < 6 AS w, sum(boardings) AS b FROM o GROUP BY ALL)
SELECT station_cmrl, CASE WHEN count(*) FILTER (w) > 0 THEN round(avg(b) FILTER (w), 4) ELSE round(avg(b), 4) END AS boardings_weekday,
CASE WHEN count(*) FILTER (w) > 0 THEN count(*) FILTER (w) ELSE count(*) END AS days_observed, round(CASE WHEN count(*) FILTER (w) > 0 THEN stddev_samp(b) FILTER (w) ELSE stddev_samp(b) END, 4) AS boardings_sd,
round(avg(b) FILTER (NOT w), 4) AS boardings_weekend FROM day GROUP BY 1""")
def q_two_level_target(spark: S, d: str) -> DataFrame:
    """Daily sums, then weekday statistics per feed; a feed without weekdays uses all its days."""
    o = table(spark, d, "fact_observed").where("not is_partial and boardings >= 0 and date is not null and station_cmrl is not null")
    day = o.groupBy("station_cmrl", "date").agg(F.sum("boardings").alias("b")).withColumn("w", F.weekday("date") < 5)
    week, end = F.when(F.col("w"), F.col("b")), F.when(~F.col("w"), F.col("b"))
    some = F.count(week) > 0
    return day.groupBy("station_cmrl").agg(
        _r(F.when(some, F.avg(week)).otherwise(F.avg("b"))).alias("boardings_weekday"), F.when(some, F.count(week)).otherwise(F.count("*")).alias("days_observed"),
        _r(F.when(some, F.stddev_samp(week)).otherwise(F.stddev_samp("b"))).alias("boardings_sd"), _r(F.avg(end)).alias("boardings_weekend"),
    )


@R.query("""WITH s AS (SELECT DISTINCT station_id, corridor_line, predicted_boardings AS p FROM chennai_powerbi_stations WHERE corridor_line IS NOT NULL AND NOT isnan(predicted_boardings))
SELECT corridor_line, count(*) AS stations, sum(p) AS total, round(avg(p), 4) AS mean, min(p) AS lo, max(p) AS hi, round(100 * sum(p) / (SELECT sum(p) FROM s), 6) AS share_pct FROM s GROUP BY 1""")
def q_corridor_rollup(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "chennai_powerbi_stations").where("corridor_line is not null and predicted_boardings is not null and not isnan(predicted_boardings)").select("station_id", "corridor_line", F.col("predicted_boardings").alias("p")).distinct()
    g = s.groupBy("corridor_line").agg(F.count("*").alias("stations"), F.sum("p").alias("total"), _r(F.avg("p")).alias("mean"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return T.with_totals(g, everything=F.sum("total")).withColumn("share_pct", F.round(100 * F.col("total") / F.col("everything"), 6)).drop("everything")


@R.query("""SELECT tod_quadrant, strategic_action, count(*) AS stations, round(avg(predicted_boardings) FILTER (NOT isnan(predicted_boardings)), 4) AS mean_boardings,
round(avg(access_index) FILTER (NOT isnan(access_index)), 6) AS mean_access FROM chennai_powerbi_stations GROUP BY 1, 2""")
def q_tod_matrix(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "chennai_powerbi_stations")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return s.groupBy("tod_quadrant", "strategic_action").agg(F.count("*").alias("stations"), _r(F.avg(known("predicted_boardings"))).alias("mean_boardings"), _r(F.avg(known("access_index")), 6).alias("mean_access"))


@R.query(f"""WITH g AS (SELECT corridor_line, count(*) AS stations, sum(p) AS demand, sum(CASE WHEN lower(layout_type) = 'underground' THEN 2.5 ELSE 1.0 END) AS weight FROM {_st('corridor_line', 'layout_type')} WHERE corridor_line IS NOT NULL GROUP BY 1)
SELECT corridor_line, stations, round(demand, 2) AS demand, weight, round(weight / sum(weight) OVER (), 8) AS cost_share, round(demand / weight, 4) AS per_weight,
row_number() OVER (ORDER BY round(demand / weight, 6) DESC, corridor_line) AS open_priority FROM g""")
def q_phasing(spark: S, d: str) -> DataFrame:
    """Lines by demand per weighted station, with their share of the weight and their order."""
    s = _stations(spark, d, "corridor_line", "layout_type").where("corridor_line is not null")
    g = s.groupBy("corridor_line").agg(F.count("*").alias("stations"), F.sum("p").alias("demand"), F.sum(F.when(F.lower("layout_type") == "underground", 2.5).otherwise(1.0)).alias("weight"))
    g = T.with_totals(g, everything=F.sum("weight")).withColumn("neg", -F.round(F.col("demand") / F.col("weight"), 6))
    g = T.row_numbers(g, [], ["neg", "corridor_line"], "open_priority")
    return g.select("corridor_line", "stations", F.round("demand", 2).alias("demand"), "weight", F.round(F.col("weight") / F.col("everything"), 8).alias("cost_share"), _r(F.col("demand") / F.col("weight")).alias("per_weight"), "open_priority")


@R.query("""SELECT typology_id, count(*) AS stations, round(median(distance_cbd_km) FILTER (NOT isnan(distance_cbd_km)), 6) AS distance, round(median(street_density_km_per_km2) FILTER (NOT isnan(street_density_km_per_km2)), 6) AS streets
FROM chennai_powerbi_stations WHERE typology_id IS NOT NULL GROUP BY 1""")
def q_cluster_profile(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "chennai_powerbi_stations").where("typology_id is not null")
    med = lambda c: _r(F.median(F.when(~F.isnan(c), F.col(c))), 6)
    return s.groupBy("typology_id").agg(F.count("*").alias("stations"), med("distance_cbd_km").alias("distance"), med("street_density_km_per_km2").alias("streets"))


@R.query("SELECT layout, phase, count(*) AS n FROM dim_station GROUP BY ALL ORDER BY n DESC, layout NULLS FIRST, phase NULLS FIRST LIMIT 15")
def q_value_counts(spark: S, d: str) -> DataFrame:
    """The 15 commonest tag combinations, nulls included."""
    return table(spark, d, "dim_station").groupBy("layout", "phase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("layout"), F.asc_nulls_first("phase")).limit(15)


@R.query(f"SELECT corridor_line, round(median(street_density_km_per_km2), 6) AS streets FROM {_st('corridor_line', double=('street_density_km_per_km2',))} GROUP BY 1")
def q_group_median(spark: S, d: str) -> DataFrame:
    return _stations(spark, d, "corridor_line", "street_density_km_per_km2").groupBy("corridor_line").agg(_r(F.median("street_density_km_per_km2"), 6).alias("streets"))


@R.query("""SELECT n_nationkey, count(c_custkey) AS stops, coalesce(round(sum(c_acctbal), 2), 0) AS area FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY 1""")
def q_zero_filled_counts(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 9000").withColumnRenamed("c_nationkey", "n_nationkey")
    return T.zero_filled(table(spark, d, "nation"), "n_nationkey", c, F.count("*").alias("stops"), F.round(F.sum("c_acctbal"), 2).alias("area"))


@R.query("""SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS suppliers,
round(stddev_samp(l_quantity), 6) AS sd, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem""")
def q_global_summary(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), _r(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        F.count_distinct("l_suppkey").alias("suppliers"), _r(F.stddev_samp("l_quantity"), 6).alias("sd"), F.percentile("l_quantity", 0.25).alias("q25"), F.percentile("l_quantity", 0.75).alias("q75"),
    )


@R.query("""WITH x AS (SELECT value AS a, (event_id % 97)::DOUBLE AS p FROM events),
r AS (SELECT a, p, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM x)
SELECT count(*) AS n, round(1 - sum((a - p) ** 2) / (var_pop(a) * count(*)), 5) AS r2, round(avg(abs(a - p)), 3) AS mae, round(sqrt(avg((a - p) ** 2)), 5) AS rmse,
round(avg(abs((a - p) / a)) FILTER (a <> 0) * 100, 4) AS mape, round(corr(ra, rp), 6) AS spearman FROM r""")
def q_metrics(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("value").alias("a"), (F.col("event_id") % 97).cast("double").alias("p"))
    return T.fit_metrics(e, "a", "p").select("n", *(_r(F.col(c), k).alias(c) for c, k in (("r2", 5), ("mae", 3), ("rmse", 5), ("mape", 4), ("spearman", 6))))


@R.query("""WITH p AS (SELECT sum(predicted_boardings) AS p FROM fact_prediction WHERE predicted_boardings IS NOT NULL AND NOT isnan(predicted_boardings)),
o AS (SELECT avg(t) AS o FROM (SELECT date, sum(boardings) AS t FROM fact_observed WHERE NOT is_partial AND boardings >= 0 AND date IS NOT NULL GROUP BY 1))
SELECT round(p, 2) AS predicted, round(o, 2) AS observed, round(p / o, 6) AS ratio, p / o BETWEEN 0.85 AND 1.15 AS in_band FROM p, o""")
def q_calibration(spark: S, d: str) -> DataFrame:
    """The predicted total against the mean observed day, within 15 percent or not."""
    p = table(spark, d, "fact_prediction").where("not isnan(predicted_boardings)").agg(F.sum("predicted_boardings").alias("p"))
    o = table(spark, d, "fact_observed").where("not is_partial and boardings >= 0 and date is not null").groupBy("date").agg(F.sum("boardings").alias("t")).agg(F.avg("t"))
    x = p.withColumn("o", o.scalar())
    return x.select(F.round("p", 2).alias("predicted"), F.round("o", 2).alias("observed"), _r(F.col("p") / F.col("o"), 6).alias("ratio"), (F.col("p") / F.col("o")).between(0.85, 1.15).alias("in_band"))


@R.query("SELECT trim(lower(city)) AS city, station, round(avg(boardings_weekday) FILTER (NOT isnan(boardings_weekday)), 4) AS boardings FROM chennai_station_target WHERE station IS NOT NULL GROUP BY 1, 2")
def q_duplicate_mean(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "chennai_station_target").where("station is not null")
    return t.groupBy(F.trim(F.lower("city")).alias("city"), "station").agg(_r(F.avg(F.when(~F.isnan("boardings_weekday"), F.col("boardings_weekday")))).alias("boardings"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@R.query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def q_correlations(spark: S, d: str) -> DataFrame:
    """All pairs in one pass, then long."""
    one = table(spark, d, "lineitem").agg(*(_r(F.corr(a, b), 6).alias(f"r{i}") for i, (a, b) in enumerate(_PAIRS)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(_PAIRS)))).alias("x")).select("x.*")


@R.query("SELECT event_type, round(skewness(value), 4) AS skew, count(DISTINCT value) AS nunique, min(value) >= 0 AS can_log FROM events GROUP BY 1")
def q_skew(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(_r(T.adjusted_skewness("value")).alias("skew"), F.count_distinct("value").alias("nunique"), (F.min("value") >= 0).alias("can_log"))


@R.query("""WITH h AS (SELECT ts::DATE AS day, hour(ts) AS hour, sum(value) AS b, count(DISTINCT hour(ts)) AS k FROM events GROUP BY 1, 2),
l AS (SELECT max(day) AS day FROM (SELECT day FROM h GROUP BY 1 HAVING count(*) = 24))
SELECT h.day, arg_max(hour, b) AS peak_hour, round(max(b) / sum(b), 6) AS peak_share, round(sum(b), 4) AS total FROM h JOIN l USING (day) GROUP BY 1""")
def q_peak_hour(spark: S, d: str) -> DataFrame:
    """The busiest hour of the latest day that has all hours."""
    h = _hourly(spark, d).groupBy("day", "hour").agg(F.sum("value").alias("b"))
    days = h.groupBy("day").agg(F.count("*").alias("k"), F.max_by("hour", F.struct("b", -F.col("hour"))).alias("peak_hour"), _r(F.max("b") / F.sum("b"), 6).alias("peak_share"), _r(F.sum("b")).alias("total"))
    return days.where("k = 24").drop("k").orderBy(F.desc("day")).limit(1)


_NULLED = ["density_pop_per_km2", "bus_stops_500m", "corridor_line", "poi_total_count", "phase", "phase2_ridership_rank"]


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL{'' if c in ('bus_stops_500m', 'corridor_line', 'phase', 'phase2_ridership_rank') else f' OR isnan({c})'}) AS nulls FROM chennai_powerbi_stations" for c in _NULLED))
def q_null_counts(spark: S, d: str) -> DataFrame:
    return T.null_counts(table(spark, d, "chennai_powerbi_stations"), _NULLED)


@R.query("SELECT count(*) AS n, count(*) > 30000 AS enough FROM lineitem")
def q_row_guard(spark: S, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), (F.count("*") > 30000).alias("enough"))


@R.query("""SELECT sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'O') AS phase2_total, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low,
round((SELECT sum(o_totalprice) FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15)) / sum(o_totalprice) FILTER (o_orderstatus = 'O') * 100, 6) AS top15_share FROM orders""")
def q_kpi_cards(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    top = o.where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).agg(F.sum("o_totalprice"))
    live = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    one = o.agg(F.sum(live.cast("decimal(18,2)")).cast("decimal(38,2)").alias("phase2_total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.sum(live).alias("t"))
    return one.withColumn("top15_share", F.round(top.scalar() / F.col("t") * 100, 6)).drop("t")


@R.query("SELECT c_mktsegment, unnest([0, 1, 2, 3, 4, 5]) AS step, unnest(quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS bound FROM customer GROUP BY 1")
def q_quantile_bounds(spark: S, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.percentile("c_acctbal", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("q"))
    return g.select("c_mktsegment", F.posexplode("q").alias("step", "bound"))


@R.query("""SELECT strategic_action, count(*) AS stations, sum(is_intermodal_hub) AS hubs FROM chennai_powerbi_stations WHERE phase <> 'Phase 1' GROUP BY 1""")
def q_chart_groups(spark: S, d: str) -> DataFrame:
    return table(spark, d, "chennai_powerbi_stations").where("phase <> 'Phase 1'").groupBy("strategic_action").agg(F.count("*").alias("stations"), F.sum("is_intermodal_hub").alias("hubs"))


# ---- windows


@R.query(f"""SELECT station_id, phase, round((rank() OVER (PARTITION BY phase ORDER BY p) + (count(*) OVER (PARTITION BY phase, p) - 1) / 2.0) / count(p) OVER (PARTITION BY phase), 8) AS pctl FROM {_st('phase')}""")
def q_pctl_rank(spark: S, d: str) -> DataFrame:
    return T.average_rank(_stations(spark, d, "phase"), ["phase"], "p", "r").select("station_id", "phase", F.round("r", 8).alias("pctl"))


_AR = lambda c, t: f"(SELECT k, (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER () AS r FROM {t} WHERE {c} IS NOT NULL)"


@R.query(f"""WITH t AS (SELECT station_id AS k, intersection_density AS a, distance_cbd_km AS b, pnr_walkability_ratio AS c FROM {_st(double=('intersection_density', 'distance_cbd_km', 'pnr_walkability_ratio'))})
SELECT t.k AS station_id, round((coalesce(x.r, 0) + coalesce(y.r, 0) + coalesce(z.r, 0)) / nullif((x.r IS NOT NULL)::INT + (y.r IS NOT NULL)::INT + (z.r IS NOT NULL)::INT, 0), 8) AS access_index
FROM t LEFT JOIN {_AR('a', 't')} x ON t.k = x.k LEFT JOIN {_AR('b', 't')} y ON t.k = y.k LEFT JOIN {_AR('c', 't')} z ON t.k = z.k""")
def q_access_index(spark: S, d: str) -> DataFrame:
    """Mean of three percentile ranks, leaving out unknown ones."""
    p = _stations(spark, d, "intersection_density", "distance_cbd_km", "pnr_walkability_ratio").toDF("station_id", "p", "a", "b", "c")
    for c in "abc":
        p = T.average_rank(p, [], c, f"r{c}")
    known = F.filter(F.array("ra", "rb", "rc"), lambda x: x.isNotNull())
    return p.select("station_id", F.round(F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known)), 8).alias("access_index"))


@R.query(f"""SELECT phase, station_id, p, row_number() OVER (PARTITION BY phase ORDER BY p DESC, station_id) AS rk FROM {_st('phase')} QUALIFY rk <= 15""")
def q_rank_first_top15(spark: S, d: str) -> DataFrame:
    w = W.partitionBy("phase").orderBy(F.desc("p"), "station_id")
    return _stations(spark, d, "phase").select("phase", "station_id", "p", F.row_number().over(w).alias("rk")).where("rk <= 15")


@R.query("""SELECT obs_id, row_number() OVER (PARTITION BY station_cmrl ORDER BY -coalesce(boardings, 0), obs_id) AS rank_in_feed, 'MAA' || lpad((row_number() OVER (ORDER BY obs_id) - 1)::VARCHAR, 8, '0') AS surrogate FROM fact_observed""")
def q_ordinals(spark: S, d: str) -> DataFrame:
    """Ranks within feeds, of which one is hot, and surrogate keys over all rows, without a single-task sort."""
    o = table(spark, d, "fact_observed").select("obs_id", "station_cmrl", (-F.coalesce("boardings", F.lit(0))).alias("neg"))
    o = T.row_numbers(T.row_numbers(o, ["station_cmrl"], ["neg", "obs_id"], "rank_in_feed"), [], ["obs_id"], "n")
    return o.select("obs_id", "rank_in_feed", F.format_string("MAA%08d", F.col("n") - 1).alias("surrogate"))


@R.query(f"""WITH r AS (SELECT station_id, row_number() OVER (ORDER BY p, station_id) AS rn, count(*) OVER () AS n FROM {_st()})
SELECT station_id, greatest(ceil((rn - 1) * 5 / (n - 1)), 1)::INT AS band FROM r""")
def q_quintile_band(spark: S, d: str) -> DataFrame:
    return T.quantile_bands(_stations(spark, d), ["p", "station_id"], "band").select("station_id", "band")


@R.query("""WITH h AS (SELECT ts::DATE AS day, hour(ts) AS hour, sum(value) AS b FROM events GROUP BY 1, 2)
SELECT day, hour, lpad(hour::VARCHAR, 2, '0') || ':00' AS time_label, round(b, 4) AS boardings, round(b / sum(b) OVER (PARTITION BY day), 6) AS share_of_day FROM h""")
def q_share_of_day(spark: S, d: str) -> DataFrame:
    h = _hourly(spark, d).groupBy("day", "hour").agg(F.sum("value").alias("b"))
    return h.select("day", "hour", F.format_string("%02d:00", "hour").alias("time_label"), _r("b").alias("boardings"), _r(F.col("b") / F.sum("b").over(W.partitionBy("day")), 6).alias("share_of_day"))


@R.query("""WITH g AS (SELECT p_type, sum(p_retailprice) AS t FROM part GROUP BY 1) SELECT p_type, round(100 * t / (SELECT sum(t) FROM g), 6) AS pct FROM g""")
def q_share_total(spark: S, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_type").agg(F.sum("p_retailprice").alias("t"))
    return T.with_totals(g, a=F.sum("t")).select("p_type", F.round(100 * F.col("t") / F.col("a"), 6).alias("pct"))


@R.query(f"WITH s AS {_st()} SELECT station_id, round((p - (SELECT min(p) FROM s)) * 100.0 / ((SELECT max(p) - min(p) FROM s)), 1) AS score FROM s")
def q_minmax_score(spark: S, d: str) -> DataFrame:
    p = T.with_totals(_stations(spark, d), lo=F.min("p"), hi=F.max("p"))
    return p.select("station_id", F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(F.round((F.col("p") - F.col("lo")) * 100.0 / (F.col("hi") - F.col("lo")), 1)).alias("score"))


@R.query(f"WITH s AS {_st()} SELECT station_id, round((p - (SELECT avg(p) FROM s)) / (SELECT stddev_samp(p) FROM s), 6) AS z FROM s")
def q_zscore(spark: S, d: str) -> DataFrame:
    c = T.with_totals(_stations(spark, d), m=F.avg("p"), s=F.stddev_samp("p"))
    return c.select("station_id", F.round((F.col("p") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 6).alias("z"))


_MONTHS = "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS t FROM orders GROUP BY 1)"


@R.query(_MONTHS + """, r AS (SELECT t, row_number() OVER (ORDER BY month DESC) AS k FROM m) SELECT n, round(avg(t), 5) AS trailing FROM r, (VALUES (3), (6), (12), (24)) v(n) WHERE k <= n GROUP BY 1""")
def q_trailing_mean(spark: S, d: str) -> DataFrame:
    """Means of the last 3, 6, 12 and 24 months."""
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("t"))
    last = m.orderBy(F.desc("month")).limit(24).withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("month"))))
    return last.withColumn("n", F.explode(F.array(*map(F.lit, (3, 6, 12, 24))))).where("k <= n").groupBy("n").agg(F.round(F.avg("t"), 5).alias("trailing"))


@R.query(_MONTHS + " SELECT month, round(t / lag(t, 12) OVER (ORDER BY month) - 1, 6) AS yoy FROM m")
def q_yoy(spark: S, d: str) -> DataFrame:
    # one row per month: small however many orders
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("t"))
    return m.select("month", _r(F.col("t") / F.lag("t", 12).over(W.partitionBy(F.lit(0)).orderBy("month")) - 1, 6).alias("yoy"))


_RUNS = """WITH c AS (SELECT station_id, arg_max(predicted_boardings, (run_date, pred_id)) AS n, arg_min(predicted_boardings, (run_date, pred_id)) AS o, count(*) AS k FROM fact_prediction
  WHERE station_id IS NOT NULL AND predicted_boardings IS NOT NULL AND NOT isnan(predicted_boardings) AND run_date IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""


def _runs(spark: S, d: str) -> DataFrame:
    """The first and the last prediction of each station that has several."""
    p = table(spark, d, "fact_prediction").where("station_id is not null and predicted_boardings is not null and not isnan(predicted_boardings) and run_date is not null")
    at = F.struct("run_date", "pred_id")
    return p.groupBy("station_id").agg(F.max_by("predicted_boardings", at).alias("n"), F.min_by("predicted_boardings", at).alias("o"), F.count("*").alias("k")).where("k > 1")


@R.query(_RUNS + """, r AS (SELECT *, rank() OVER (ORDER BY -o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS ro, rank() OVER (ORDER BY -n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn FROM c)
SELECT station_id, floor(ro)::INT AS rank_old, floor(rn)::INT AS rank_new, floor(ro)::INT - floor(rn)::INT AS rank_change, round(100 * (n - o) / nullif(o, 0), 4) + 0.0 AS delta_pct FROM r""")
def q_rank_change(spark: S, d: str) -> DataFrame:
    """The first and the last run of a forecast compared: average ranks cut to whole numbers, and their change."""
    c = _runs(spark, d).withColumns({"no": -F.col("o"), "nn": -F.col("n")})
    c = T.average_rank(T.average_rank(c, [], "no", "ro", False), [], "nn", "rn", False)
    a, b = F.floor("ro").cast("int"), F.floor("rn").cast("int")
    return c.select("station_id", a.alias("rank_old"), b.alias("rank_new"), (a - b).alias("rank_change"), (_r(F.try_divide(100 * (F.col("n") - F.col("o")), F.col("o"))) + 0.0).alias("delta_pct"))


# ---- top-k, argmax, search


@R.query(f"SELECT station_id, p FROM {_st()} ORDER BY p DESC, station_id LIMIT 15")
def q_nlargest(spark: S, d: str) -> DataFrame:
    return _stations(spark, d).orderBy(F.desc("p"), "station_id").limit(15)


@R.query(f"SELECT station_id, p FROM {_st()} ORDER BY p, station_id LIMIT 8")
def q_nsmallest(spark: S, d: str) -> DataFrame:
    return _stations(spark, d).orderBy("p", "station_id").limit(8)


@R.query(f"""WITH s AS {_st()} (SELECT 'top' AS side, station_id, p FROM s ORDER BY p DESC, station_id LIMIT 5) UNION ALL (SELECT 'bottom', station_id, p FROM s ORDER BY p, station_id LIMIT 5)""")
def q_movers(spark: S, d: str) -> DataFrame:
    c = _stations(spark, d)
    one = lambda s, *o: c.orderBy(*o).limit(5).select(F.lit(s).alias("side"), "station_id", "p")
    return one("top", F.desc("p"), "station_id").unionAll(one("bottom", F.asc("p"), "station_id"))


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - 2500 * l_quantity), 2) AS err FROM lineitem ORDER BY err DESC, l_orderkey, l_linenumber, l_partkey LIMIT 6")
def q_largest_errors(spark: S, d: str) -> DataFrame:
    e = F.round(F.abs(F.col("l_extendedprice") - 2500 * F.col("l_quantity")), 2).alias("err")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e).orderBy(F.desc("err"), "l_orderkey", "l_linenumber", "l_partkey").limit(6)


@R.query(f"SELECT corridor_line, arg_min(station_id, (-p, station_id)) AS best_station, max(p) AS p FROM {_st('corridor_line')} GROUP BY 1")
def q_argmax(spark: S, d: str) -> DataFrame:
    return _stations(spark, d, "corridor_line").groupBy("corridor_line").agg(F.min_by("station_id", F.struct(-F.col("p"), "station_id")).alias("best_station"), F.max("p").alias("p"))


@R.query("SELECT station_cmrl, max(date) AS date, arg_max(boardings, (date, fetched_at, obs_id)) AS boardings FROM fact_observed WHERE station_cmrl IS NOT NULL AND date IS NOT NULL AND boardings IS NOT NULL GROUP BY 1")
def q_latest(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "fact_observed").where("station_cmrl is not null and date is not null and boardings is not null")
    return o.groupBy("station_cmrl").agg(F.max("date").alias("date"), F.max_by("boardings", F.struct("date", "fetched_at", "obs_id")).alias("boardings"))


@R.query("SELECT ref_id, station FROM station_names WHERE contains(lower(station), 'gate') ORDER BY ref_id LIMIT 8")
def q_search(spark: S, d: str) -> DataFrame:
    return table(spark, d, "station_names").where(F.lower("station").contains("gate")).select("ref_id", "station").orderBy("ref_id").limit(8)


@R.query(f"SELECT station_id, round(abs(p - 5000), 6) AS gap FROM {_st()} WHERE abs(p - 5000) > 4500 ORDER BY gap DESC, station_id")
def q_threshold_sort(spark: S, d: str) -> DataFrame:
    return _stations(spark, d).select("station_id", F.round(F.abs(F.col("p") - 5000), 6).alias("gap")).where("gap > 4500").orderBy(F.desc("gap"), "station_id")


# ---- joins


@R.query("SELECT obs_id, station_cmrl FROM fact_observed WHERE station_cmrl IN (SELECT alias FROM station_names UNION SELECT station FROM station_names)")
def q_semi_join(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "station_names")
    t = n.select(F.col("alias").alias("station_cmrl")).union(n.select("station"))
    return table(spark, d, "fact_observed").select("obs_id", "station_cmrl").join(t, "station_cmrl", "left_semi")


@R.query("SELECT DISTINCT station_id FROM dim_station d WHERE station_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fact_prediction p WHERE p.station_id = d.station_id AND confidence = 'high')")
def q_anti_join(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "fact_prediction").where("confidence = 'high'").select("station_id")
    return table(spark, d, "dim_station").where("station_id is not null").select("station_id").distinct().join(p, "station_id", "left_anti")


@R.query("""WITH s AS (SELECT station_id, min(name) AS name, min(line) AS line FROM dim_station GROUP BY 1)
SELECT p.pred_id, p.station_id, s.name AS name_dim, s.line AS line_dim FROM fact_prediction p LEFT JOIN s USING (station_id)""")
def q_left_enrich(spark: S, d: str) -> DataFrame:
    """Left join to a side reduced to one row per key first, its columns renamed."""
    s = table(spark, d, "dim_station").groupBy("station_id").agg(F.min("name").alias("name_dim"), F.min("line").alias("line_dim"))
    return table(spark, d, "fact_prediction").select("pred_id", "station_id").join(s, "station_id", "left").select("pred_id", "station_id", "name_dim", "line_dim")


@R.query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def q_star_rollup(spark: S, d: str) -> DataFrame:
    """Facts to two dimensions, aggregated on the key before the names are joined."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "customers", F.round("b", 2).alias("balance"))


@R.query("""WITH s AS (SELECT station_id, avg(latitude) FILTER (position_source = 'osm') AS a, avg(latitude) FILTER (position_source = 'wikipedia') AS b, min(latitude) AS c
  FROM dim_station WHERE station_id IS NOT NULL AND NOT isnan(latitude) AND latitude BETWEEN 8 AND 23 GROUP BY 1)
SELECT station_id, round(coalesce(a, b, c), 6) AS position, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'third' END AS source FROM s""")
def q_source_cascade(spark: S, d: str) -> DataFrame:
    """A value from the best source that has one, and which it was."""
    v, of = F.col("latitude"), F.col("position_source")
    s = table(spark, d, "dim_station").where("station_id is not null and latitude between 8 and 23")
    f = s.groupBy("station_id").agg(F.avg(F.when(of == "osm", v)).alias("a"), F.avg(F.when(of == "wikipedia", v)).alias("b"), F.min(v).alias("c"))
    return f.select("station_id", F.round(F.coalesce("a", "b", "c"), 6).alias("position"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("third").alias("source"))


@R.query(f"""{_RUNS} SELECT station_id, p AS published, n AS last_run, round(n - p, 4) AS delta FROM c JOIN {_st()} USING (station_id)""")
def q_version_join(spark: S, d: str) -> DataFrame:
    """The published table against the last run."""
    return _stations(spark, d).join(_runs(spark, d), "station_id").select("station_id", F.col("p").alias("published"), F.col("n").alias("last_run"), _r(F.col("n") - F.col("p")).alias("delta"))


# ---- sets and reshaping


@R.query("SELECT pred_id::VARCHAR AS id, name, line, NULL AS layout FROM fact_prediction UNION ALL SELECT station_id, name, line, layout FROM dim_station")
def q_union_by_name(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "fact_prediction").select(F.col("pred_id").cast("string").alias("id"), "name", "line")
    s = table(spark, d, "dim_station").select(F.col("station_id").alias("id"), "name", "line", "layout")
    return p.unionByName(s, allowMissingColumns=True)


@R.query("SELECT station_id, name, loaded_on FROM dim_station QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY loaded_on NULLS LAST, name NULLS LAST) = 1")
def q_dedup_first(spark: S, d: str) -> DataFrame:
    return T.first_by(table(spark, d, "dim_station").select("station_id", "name", "loaded_on"), ["station_id"], F.asc_nulls_last("loaded_on"), F.asc_nulls_last("name"))


@R.query("SELECT DISTINCT station_id FROM fact_prediction WHERE station_id IS NOT NULL EXCEPT SELECT station_id FROM dim_station")
def q_set_difference(spark: S, d: str) -> DataFrame:
    return table(spark, d, "fact_prediction").where("station_id is not null").select("station_id").distinct().join(table(spark, d, "dim_station").select("station_id"), "station_id", "left_anti")


@R.query("""SELECT date, lpad(line, 2, '0') AS line, station_cmrl, boardings, is_partial FROM fact_observed WHERE date IS NOT NULL AND station_cmrl IS NOT NULL AND line IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY date, lpad(line, 2, '0'), station_cmrl ORDER BY is_partial, fetched_at DESC, obs_id DESC) = 1""")
def q_upsert_store(spark: S, d: str) -> DataFrame:
    """The daily store: keys spelled alike, complete readings before partial ones, then the latest."""
    o = table(spark, d, "fact_observed").where("date is not null and station_cmrl is not null and line is not null").withColumn("line", F.lpad("line", 2, "0"))
    best = F.min_by(F.struct("boardings", "is_partial"), F.struct("is_partial", -F.unix_micros(F.col("fetched_at").cast("timestamp")), -F.col("obs_id")))
    return o.groupBy("date", "line", "station_cmrl").agg(best.alias("b")).select("date", "line", "station_cmrl", "b.*")


_DIM = {"density_pop_per_km2": "density", "poi_total_count": "diversity", "intersection_density": "design", "distance_cbd_km": "destination", "bus_stops_500m": "distance"}


@R.query(" UNION ALL ".join(f"SELECT DISTINCT station_id, '{c}' AS feature, CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END AS value, '{g}' AS dimension FROM chennai_powerbi_stations" for c, g in _DIM.items()))
def q_unpivot_features(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "chennai_powerbi_stations").select("station_id", *_DIM).distinct()
    return T.unpivot(s, ["station_id"], _DIM).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@R.query("""SELECT month, medium, n FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low,
count(*) FILTER (o_orderpriority = 'none') AS unused FROM orders GROUP BY 1) UNPIVOT (n FOR medium IN (urgent, low)) WHERE n > 0""")
def q_ticket_unpivot(spark: S, d: str) -> DataFrame:
    """Counts per kind, wide and then long; kinds without any and zeros are left out."""
    kinds = {"urgent": "1-URGENT", "low": "5-LOW", "unused": "none"}
    wide = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(*(F.count_if(F.col("o_orderpriority") == v).alias(k) for k, v in kinds.items()))
    return wide.unpivot(["month"], list(kinds), "medium", "n").where("n > 0")


@R.query("""PIVOT (SELECT hour(ts) AS hour, strftime(ts, '%Y-%m-%d %a') AS day, value FROM events WHERE ts IS NOT NULL) ON day USING round(sum(value), 4) GROUP BY hour""")
def q_pivot_hour_date(spark: S, d: str) -> DataFrame:
    """Every date of the table; one column a day."""
    e = table(spark, d, "events").where("ts is not null").select(F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd EEE").alias("day"), "value")
    days = [r["day"] for r in e.select("day").distinct().orderBy("day").collect()]
    return e.groupBy("hour").pivot("day", days).agg(_r(F.sum("value")))


@R.query("""SELECT d::DATE AS date, year(d) AS year, monthname(d) AS month, dayname(d) AS day_name, CASE WHEN isodow(d) < 6 THEN 'Weekday' ELSE 'Weekend' END AS day_type, weekofyear(d) AS iso_week
FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM fact_observed)""")
def q_dim_date(spark: S, d: str) -> DataFrame:
    return T.calendar(table(spark, d, "fact_observed"), "date")


@R.query("""SELECT station_id, radius_m::DOUBLE AS radius_m, round(32 * sin(2 * pi() / 64) * radius_m * radius_m, 4) AS buffer_area_m2
FROM (SELECT DISTINCT station_id FROM dim_station WHERE latitude BETWEEN 8 AND 23 AND longitude BETWEEN 72 AND 88), (VALUES (400), (800), (1200)) r(radius_m)""")
def q_station_radii(spark: S, d: str) -> DataFrame:
    """Each station with each catchment radius; the buffer is a 64-gon."""
    s = table(spark, d, "dim_station").where("latitude between 8 and 23 and longitude between 72 and 88").groupBy(F.col("station_id").alias("id")).agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    x, y = G.utm(F.col("lat"), F.col("lon"), G.city_zone("bengaluru"))
    out = G.catchment_circles(s.select("id", x.alias("x"), y.alias("y")), [400.0, 800.0, 1200.0])
    return out.select(F.col("id").alias("station_id"), "radius_m", F.round("buffer_area_m2", 4).alias("buffer_area_m2"))


@R.query(f"""SELECT station_id, round(p, 4) AS base, round(p * 1.2, 4) AS denser, round(p + 5, 4) AS more_stops, 100.0 AS fixed FROM {_st()}""")
def q_scenarios(spark: S, d: str) -> DataFrame:
    """What-if variants of a column: multiply, add, set."""
    p, v = _stations(spark, d), F.col("p")
    return p.select("station_id", _r(v).alias("base"), _r(v * 1.2).alias("denser"), _r(v + 5).alias("more_stops"), F.lit("100.0").cast("decimal(4,1)").alias("fixed"))


@R.query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS k FROM c)
SELECT user_id, k AS kinds, round(CASE WHEN k <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(k) END, 6) AS entropy FROM p GROUP BY 1, 2""")
def q_zonal_entropy(spark: S, d: str) -> DataFrame:
    return T.mix_entropy(table(spark, d, "events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 6))


QUERIES, SQL = R.queries, R.sql
