"""Name matching and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaymill.functions.missing import no_value
from quaymill.operators import matching as M
from quaymill.operators import models as L
from quaymill.operators import stations as B
from quaymill.operators import tables as T
from quaymill.plans.registry import Registry
from quaymill.session import attach, cut, table

R = Registry()
S = SparkSession
FEATURES = ["intersection_density", "pnr_walkability_ratio", "poi_total_count", "distance_cbd_km", "street_density_km_per_km2", "access_index"]

KINDS = ["linear", "elastic_net", "random_forest", "boosting"]


def _train(spark: S, d: str) -> DataFrame:
    """One gap-free row per station with a score."""
    s = table(spark, d, "chennai_powerbi_stations").where(~no_value(F.col("predicted_boardings"))).select("station_id", "predicted_boardings", *FEATURES).distinct()
    return cut(L.clean(s, FEATURES)[0], "train")


@R.query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem""")
def q_least_squares(spark: S, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = L.least_squares(li, ["l_quantity"], F.col("l_extendedprice"))
    return spark.range(1).select(F.round(F.lit(float(a)), 4).alias("intercept"), F.round(F.lit(float(b)), 6).alias("slope"))


@R.query("""WITH m AS (SELECT avg(p_size) AS mx, count(*) AS n, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, sum((p_size - (SELECT avg(p_size) FROM part)) ** 2) AS sxx FROM part)
SELECT p_partkey, round(p_retailprice - (p_retailprice - a - b * p_size) / (1 - 1.0 / n - (p_size - mx) ** 2 / sxx), 4) AS predicted FROM part, m""")
def q_leave_one_out(spark: S, d: str) -> DataFrame:
    p = L.leave_one_out(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size"], "p_retailprice", log_target=False)
    return p.select("p_partkey", F.round("predicted", 4).alias("predicted"))


def q_screened_features(spark: S, d: str) -> DataFrame:
    t = _train(spark, d)
    logged, names = L.log_skewed(t, FEATURES)
    kept = L.screen(logged, FEATURES, "predicted_boardings", ["distance_cbd_km"], most=4)
    return spark.createDataFrame([(c, c in names) for c in kept], "feature string, logged boolean")


def q_negative_binomial(spark: S, d: str) -> DataFrame:
    beta, alpha = L.negative_binomial(_train(spark, d), FEATURES, "predicted_boardings")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in (beta | {"alpha": alpha}).items()], "feature string, coef double")


def q_model_performance(spark: S, d: str) -> DataFrame:
    return L.model_table(_train(spark, d), "station_id", FEATURES, "predicted_boardings", KINDS)


def q_best_model(spark: S, d: str) -> DataFrame:
    return L.best_model(cut(L.model_table(_train(spark, d), "station_id", FEATURES, "predicted_boardings", KINDS), "metrics"))


def q_bootstrap_intervals(spark: S, d: str) -> DataFrame:
    t = _train(spark, d)
    return L.bootstrap_intervals(t, "predicted_boardings", FEATURES, t, "station_id")


def q_typology(spark: S, d: str) -> DataFrame:
    t = L.typology(_train(spark, d), FEATURES)
    return t.groupBy("typology").agg(F.count("*").alias("stations"), *(F.median(c).alias(c) for c in FEATURES))


def q_transfer_prediction(spark: S, d: str) -> DataFrame:
    """A model of phase 1 applied to the rest, with the training medians and the training choice of logarithms."""
    s = table(spark, d, "chennai_powerbi_stations").select("station_id", "phase", "predicted_boardings", *FEATURES).distinct()
    home, medians = L.clean(s.where("phase = 'Phase 1'").where(~no_value(F.col("predicted_boardings"))), FEATURES)
    home, logged = L.log_skewed(cut(home, "home"), FEATURES)
    away = L.log_skewed(L.clean(s.where("phase <> 'Phase 1'"), FEATURES, medians)[0], FEATURES, columns=logged)[0]
    model = L.fitted(home, FEATURES, "predicted_boardings", "linear")
    return L.predicted(model, away).select("station_id", F.round("predicted", 2).alias("predicted"))


def q_what_if(spark: S, d: str) -> DataFrame:
    """Mean change of the prediction in percent, per scenario."""
    t = _train(spark, d)
    model = L.fitted(t, FEATURES, "predicted_boardings", "linear")
    base = L.predicted(model, t).select("station_id", F.col("predicted").alias("base"))
    out = None
    for name, changes in {"walkable": {"pnr_walkability_ratio": 1.2}, "denser_streets": {"intersection_density": ("add", 20.0)}, "central": {"distance_cbd_km": ("set", 1.0)}}.items():
        new = L.simulate(model, t, changes).select("station_id", "predicted").join(base, "station_id")
        one = new.agg((F.avg(F.try_divide(F.col("predicted") - F.col("base"), F.col("base"))) * 100).alias("mean_pct")).select(F.lit(name).alias("scenario"), F.round("mean_pct", 4).alias("mean_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def _names(spark: S, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, n = table(spark, d, "chennai_station_target"), table(spark, d, "station_names")
    left = n.select(F.col("station").alias("name"), F.col("ref_id").cast("bigint").alias("pos"))
    right = t.select(F.col("cmrl_name").alias("name"), F.col("target_id").alias("pos"))
    return left, right, n.where("alias is not null").select(F.col("station").alias("name"), "alias")


def q_fuzzy_match(spark: S, d: str) -> DataFrame:
    """The canonical names against the typed ones, one to one."""
    left, right, aliases = _names(spark, d)
    return M.match_names(left, right, 0.82, aliases)


def q_fuzzy_failures(spark: S, d: str) -> DataFrame:
    left, right, aliases = _names(spark, d)
    return M.nearest_failures(left, right, cut(M.match_names(left, right, 0.82, aliases), "matched"))


def _key_sql(c: str) -> str:
    """The name key in SQL, for texts whose decomposition is that of their accents and raised digits: a mark leaves a blank behind its letter."""
    bare = f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN strip_accents(x) <> x THEN strip_accents(x) || ' ' ELSE translate(x, '¹²³', '123') END), '')"
    out = f"lower(regexp_replace(regexp_replace({bare}, '[*†‡§¶#¤°·]', '', 'g'), '\\([^)]*\\)', ' ', 'g'))"
    for word in M.NOISE_WORDS:
        out = f"replace({out}, '{word}', ' ')"
    titles = "|".join(M.HONORIFICS)
    return f"coalesce(trim(regexp_replace(regexp_replace({out}, '\\b({titles})\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '')"


@R.query(f"SELECT target_id, cmrl_name, {_key_sql('cmrl_name')} AS key FROM chennai_station_target")
def q_plain_names(spark: S, d: str) -> DataFrame:
    """The comparable key of every name as typed."""
    return table(spark, d, "chennai_station_target").select("target_id", "cmrl_name", M.plain_key(F.col("cmrl_name")).alias("key"))


def q_canonical_names(spark: S, d: str) -> DataFrame:
    """Typed names by an explicit table first, the rest by likeness among the stations that are left."""
    n = table(spark, d, "station_names")
    explicit = n.where("alias is not null").select(F.col("alias").alias("name"), "station")
    typed = table(spark, d, "chennai_station_target").select(F.col("cmrl_name").alias("name"), F.col("target_id").alias("pos"))
    return B.canonical_names(typed, n.select(F.col("station").alias("name"), F.col("ref_id").cast("bigint").alias("pos")), explicit)


@R.query("""WITH a AS (SELECT n_name AS label, n_nationkey AS k FROM nation WHERE n_nationkey < 10) SELECT c_custkey, coalesce(k, -1) AS mapped, CASE WHEN k IS NULL THEN 'unmatched' ELSE 'alias' END AS how FROM customer LEFT JOIN a ON label = 'NATION_' || c_nationkey""")
def q_alias_lookup(spark: S, d: str) -> DataFrame:
    """Explicit names first; what is left over goes on to the fuzzy match."""
    a = table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("k"))
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("label"))
    return c.join(attach(a), "label", "left").select("c_custkey", F.coalesce("k", F.lit(-1)).alias("mapped"), F.when(F.col("k").isNull(), "unmatched").otherwise("alias").alias("how"))


@R.query("""WITH v AS (SELECT p.station_id, avg(p.predicted_boardings) AS p FROM fact_prediction p WHERE NOT isnan(p.predicted_boardings) AND p.predicted_boardings IS NOT NULL AND p.station_id IS NOT NULL GROUP BY 1),
o AS (SELECT station_id, min(predicted_boardings) AS a FROM chennai_powerbi_stations WHERE NOT isnan(predicted_boardings) AND predicted_boardings IS NOT NULL GROUP BY 1)
SELECT station_id, round(p - a, 3) AS error FROM v JOIN o USING (station_id) ORDER BY abs(round(p - a, 3)) DESC, station_id LIMIT 6""")
def q_worst_misses(spark: S, d: str) -> DataFrame:
    p = table(spark, d, "fact_prediction").where("station_id is not null and predicted_boardings is not null and not isnan(predicted_boardings)").groupBy("station_id").agg(F.avg("predicted_boardings").alias("p"))
    o = table(spark, d, "chennai_powerbi_stations").where("predicted_boardings is not null and not isnan(predicted_boardings)").groupBy("station_id").agg(F.min("predicted_boardings").alias("a"))
    e = p.join(o, "station_id").select("station_id", F.round(F.col("p") - F.col("a"), 3).alias("error"))
    return e.orderBy(F.desc(F.abs("error")), "station_id").limit(6)


@R.query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS open_priority FROM supplier")
def q_open_priority(spark: S, d: str) -> DataFrame:
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(w).alias("open_priority"))


for _q in (q_screened_features, q_negative_binomial, q_model_performance, q_best_model, q_bootstrap_intervals, q_typology, q_transfer_prediction, q_what_if, q_fuzzy_match, q_fuzzy_failures, q_canonical_names):
    R.queries[_q.__name__] = _q

QUERIES, SQL = R.queries, R.sql
