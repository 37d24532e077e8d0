"""Queries of the core operators: orphans, proximity, imputation, regular grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.functions.missing import MOST_COUNT, MOST_PER_KM2, no_number, no_text
from quaymill.operators.impute import Field, impute, filled_cases
from quaymill.operators.orphans import orphan_references, orphan_report
from quaymill.operators.proximity import located, near_pairs
from quaymill.operators.regrid import daily_grid
from quaymill.session import table

#: South, north, west and east of all stations.
BOUNDS = (8.0, 23.0, 72.0, 88.0)
WALK_M = 250.0

FIELDS = [
    Field("density_pop_per_km2", True, lambda c: no_number(c, MOST_PER_KM2), MOST_PER_KM2),
    Field("bus_stops_500m", True, lambda c: no_number(c, MOST_COUNT), MOST_COUNT, whole=True),
    Field("corridor_line", False, no_text),
]
HELPERS = ["poi_total_count", "distance_cbd_km", "population_800m", "intersection_density", "street_density_km_per_km2", "access_index", "potential_index"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    station, date = table(spark, d, "dim_station"), table(spark, d, "dim_date")
    a = orphan_references(table(spark, d, "fact_prediction"), "station_id", "pred_id", "run_date", station, "station_id", "loaded_on", "retired_on")
    b = orphan_references(table(spark, d, "fact_observed"), "date", "obs_id", "date", date, "date")
    return a.select(F.lit("fact_prediction").alias("tab"), "*").unionByName(b.select(F.lit("fact_observed").alias("tab"), "*"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tab", "period", "row_id", "kind")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d), "tab", "period", "kind")


def _near(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(located(table(spark, d, "dim_station"), "station_id", "latitude", "longitude", BOUNDS), WALK_M)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select(F.col("id_a").alias("station_id_a"), F.col("id_b").alias("station_id_b"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in walking distance and the metres to the nearest, per station that has any."""
    pairs = _near(spark, d)
    both = pairs.select("id_a", "metres").union(pairs.select("id_b", "metres"))
    return both.groupBy(F.col("id_a").alias("station_id")).agg(F.count("*").alias("neighbours"), F.round(F.min("metres"), 1).alias("nearest_m"))


def _imputed(spark: SparkSession, d: str) -> DataFrame:
    return impute(table(spark, d, "chennai_powerbi_stations"), "station_id", FIELDS, HELPERS, ["phase"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return filled_cases(_imputed(spark, d), "station_id", [f.name for f in FIELDS])


def p6_imputed(spark: SparkSession, d: str) -> DataFrame:
    return _imputed(spark, d)


def p6_marked(spark: SparkSession, d: str) -> DataFrame:
    """The result without what was filled in: delivered values, what was missing and what has been filled."""
    f = _imputed(spark, d)
    out = [F.col("station_id")]
    for x in FIELDS:
        out += [F.when(~F.col(f"{x.name}_missing"), F.col(x.name)).alias(x.name), F.col(f"{x.name}_missing"), F.col(f"{x.name}_filled")]
    return f.select(*out)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    usable = ~F.coalesce(F.col("is_partial"), F.lit(True)) & (F.col("boardings") >= 0)
    return daily_grid(table(spark, d, "fact_observed"), "station_cmrl", "date", "boardings", usable, ["fetched_at", "obs_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("is_missing").select(F.col("source").alias("station_cmrl"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumnRenamed("source", "station_cmrl")


def p7_marked(spark: SparkSession, d: str) -> DataFrame:
    """The grid without the smoothed values: the reading of each day, or that there is none."""
    g = p7_grid(spark, d)
    return g.select("station_cmrl", "day", F.when(~F.col("is_missing"), F.col("value")).alias("reading"), "is_missing")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p4_neighbours, p6_found, p6_imputed, p6_marked, p7_found, p7_grid, p7_marked)}

_KEYS = "(SELECT station_id, min(loaded_on) AS lo, max(retired_on) AS hi FROM dim_station GROUP BY 1)"
_P2 = f"""
WITH o AS (
  SELECT 'fact_prediction' AS tab, strftime(run_date, '%Y-%m') AS period, pred_id AS row_id,
    CASE WHEN s.station_id IS NULL THEN 'missing' WHEN run_date < lo THEN 'later' WHEN run_date >= hi THEN 'deleted' END AS kind
  FROM fact_prediction p LEFT JOIN {_KEYS} s ON p.station_id = s.station_id WHERE p.station_id IS NOT NULL
  UNION ALL
  SELECT 'fact_observed', strftime(date, '%Y-%m'), obs_id, 'missing' FROM fact_observed f
  WHERE date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dim_date d WHERE d.date = f.date))
"""
_USABLE = """
WITH u AS (SELECT station_cmrl, date FROM fact_observed WHERE date IS NOT NULL AND station_cmrl IS NOT NULL AND NOT is_partial AND boardings >= 0 GROUP BY 1, 2),
s AS (SELECT station_cmrl, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM u GROUP BY 1)
SELECT station_cmrl, strftime(day, '%Y-%m-%d') AS day FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.station_cmrl = s.station_cmrl AND u.date = s.day)
"""
_NO_LINE = "corridor_line IS NULL OR regexp_replace(lower(corridor_line), '\\bline\\b', '') !~ '[a-z0-9]' OR trim(regexp_replace(trim(lower(corridor_line)), '\\s*\\bline$', '')) IN ('n/a', 'nan', 'tbd', 'unknown', 'none', 'null', 'na', 'tba', 'tbc')"
_P6 = f"""
SELECT DISTINCT station_id, 'density_pop_per_km2' AS field FROM chennai_powerbi_stations
WHERE station_id IS NOT NULL AND (density_pop_per_km2 IS NULL OR isnan(density_pop_per_km2) OR density_pop_per_km2 < 0 OR density_pop_per_km2 > 1e6)
UNION ALL SELECT DISTINCT station_id, 'bus_stops_500m' FROM chennai_powerbi_stations WHERE station_id IS NOT NULL AND (bus_stops_500m IS NULL OR bus_stops_500m < 0 OR bus_stops_500m > 5000)
UNION ALL SELECT DISTINCT station_id, 'corridor_line' FROM chennai_powerbi_stations WHERE station_id IS NOT NULL AND ({_NO_LINE})
"""
_P4 = """
WITH raw AS (SELECT station_id, CASE WHEN abs(latitude) > 1000 THEN abs(latitude) / 1e6 ELSE abs(latitude) END AS a,
                    CASE WHEN abs(longitude) > 1000 THEN abs(longitude) / 1e6 ELSE abs(longitude) END AS b FROM dim_station WHERE NOT isnan(latitude) AND NOT isnan(longitude)),
pt AS (SELECT station_id, min(least(a, b)) AS lat, min(greatest(a, b)) AS lon FROM raw WHERE least(a, b) BETWEEN 8 AND 23 AND greatest(a, b) BETWEEN 72 AND 88 GROUP BY 1),
pairs AS (SELECT p.station_id AS station_id_a, q.station_id AS station_id_b,
  2 * 6371008.8 * asin(sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2))) AS m
  FROM pt p JOIN pt q ON p.station_id < q.station_id AND abs(p.lat - q.lat) < 0.0024 AND abs(p.lon - q.lon) < 0.0028)
"""
_P6_MARKED = f"""
WITH r AS (SELECT DISTINCT station_id, density_pop_per_km2 AS a, bus_stops_500m AS b, corridor_line AS c,
  density_pop_per_km2 IS NULL OR isnan(density_pop_per_km2) OR density_pop_per_km2 < 0 OR density_pop_per_km2 > 1e6 AS ma, bus_stops_500m IS NULL OR bus_stops_500m < 0 OR bus_stops_500m > 5000 AS mb, ({_NO_LINE}) AS mc
  FROM chennai_powerbi_stations WHERE station_id IS NOT NULL)
SELECT station_id, CASE WHEN NOT ma THEN a END AS density_pop_per_km2, ma AS density_pop_per_km2_missing, ma AS density_pop_per_km2_filled, CASE WHEN NOT mb THEN b::BIGINT END AS bus_stops_500m, mb AS bus_stops_500m_missing,
  mb AS bus_stops_500m_filled, CASE WHEN NOT mc THEN c END AS corridor_line, mc AS corridor_line_missing, mc AS corridor_line_filled FROM r
"""
_P7_MARKED = """
WITH u AS (SELECT station_cmrl, date, arg_max(boardings, (fetched_at, obs_id))::DOUBLE AS reading FROM fact_observed WHERE date IS NOT NULL AND station_cmrl IS NOT NULL AND NOT is_partial AND boardings >= 0 GROUP BY 1, 2),
s AS (SELECT station_cmrl, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM u GROUP BY 1)
SELECT s.station_cmrl, s.day, reading, reading IS NULL AS is_missing FROM s LEFT JOIN u ON u.station_cmrl = s.station_cmrl AND u.date = s.day
"""
SQL = {
    "p2_found": _P2 + "SELECT tab, period, row_id, kind FROM o WHERE kind IS NOT NULL",
    "p2_report": _P2 + 'SELECT tab, period, kind, count(*) AS "references" FROM o WHERE kind IS NOT NULL GROUP BY ALL',
    "p4_found": _P4 + "SELECT station_id_a, station_id_b FROM pairs WHERE m <= 250",
    "p4_neighbours": _P4 + """SELECT station_id, count(*) AS neighbours, round(min(m), 1) AS nearest_m
FROM (SELECT station_id_a AS station_id, m FROM pairs WHERE m <= 250 UNION ALL SELECT station_id_b, m FROM pairs WHERE m <= 250) GROUP BY 1""",
    "p6_found": _P6,
    "p6_marked": _P6_MARKED,
    "p7_found": _USABLE,
    "p7_marked": _P7_MARKED,
}
