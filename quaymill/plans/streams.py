"""Streaming queries: each runs over what is there and returns the state it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.plans.registry import Registry
from quaymill.session import table
from quaymill.streaming import store as X

R = Registry()
S = SparkSession
_STORE = "date date, line string, station_cmrl string, boardings bigint, is_partial boolean, stamp string"


def _observed(df: DataFrame) -> DataFrame:
    """Keys spelled alike; the stamp orders by time and then by id."""
    o = df.where("date is not null and station_cmrl is not null and line is not null")
    stamp = F.concat(F.lpad(F.coalesce(F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(0)).cast("string"), 20, "0"), F.lpad(F.col("obs_id").cast("string"), 20, "0"))
    return o.select("date", F.lpad("line", 2, "0").alias("line"), "station_cmrl", "boardings", "is_partial", stamp.alias("stamp"))


@R.query("""SELECT date, lpad(line, 2, '0') AS line, station_cmrl, boardings, is_partial FROM fact_observed WHERE date IS NOT NULL AND station_cmrl IS NOT NULL AND line IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY date, lpad(line, 2, '0'), station_cmrl ORDER BY is_partial, fetched_at DESC, obs_id DESC) = 1""")
def q_stream_upsert(spark: S, d: str) -> DataFrame:
    path = X.scratch(spark, "store")
    store = X.Store(spark, path, _STORE)
    X.upsert_stream(_observed(X.stream_of(spark, d, "fact_observed")), store, ["date", "line", "station_cmrl"], "is_partial", "stamp", f"{path}-checkpoint").awaitTermination()
    return store.read().drop("stamp")


@R.query("SELECT ts::DATE AS day, event_type, round(sum(value), 4) AS total, count(*) AS readings FROM events GROUP BY 1, 2")
def q_stream_daily_totals(spark: S, d: str) -> DataFrame:
    path = X.scratch(spark, "totals")
    totals = X.daily_totals_stream(X.stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    # complete mode gives every day anew with each batch: the last batch is the result
    out = totals.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/last"))
    out.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("day date, event_type string, total double, readings bigint").parquet(f"{path}/last").withColumn("total", F.round("total", 4))


@R.query("""WITH d AS (SELECT date, bool_or(NOT coalesce(is_partial, true)) AS done FROM fact_observed WHERE date IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (done AND isodow(date) < 6) AS weekdays, count(*) FILTER (done AND isodow(date) >= 6) AS weekend_days, greatest(10 - count(*) FILTER (done AND isodow(date) < 6), 0) AS weekdays_needed,
count(*) FILTER (done AND isodow(date) < 6) >= 10 AS ready, max(date) FILTER (done) AS last_day, (max(date) FILTER (done) - min(date) FILTER (done) + 1 - count(*) FILTER (done))::INT AS days_missing,
max(date) AS newest, (current_date - max(date))::INT AS days_old, current_date - max(date) > 1 AS is_stale FROM d""")
def q_readiness(spark: S, d: str) -> DataFrame:
    """What is collected, what is still needed, and how old the newest record is today."""
    r = X.readiness(table(spark, d, "fact_observed"), "date", "is_partial")
    return r.withColumns({c: F.col(c).cast("int") for c in ("days_missing", "days_old")})


QUERIES, SQL = R.queries, R.sql
