"""The daily store as a stream: files arrive, partial readings are superseded by complete ones, reruns change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.operators.tables import upsert
from quaymill.session import cut, shared_dir


class Store:
    """A table in one folder, in parts that are written anew only where a batch changes them.

    A part is a month of the date ``by``, or one value if ``by`` is no date; values must be fit for folder names. Each batch writes the
    parts that it touches under its own number; of a part the highest committed number below holds. A batch that is run again after a
    failure writes its parts anew and sees the ones before it, so that each batch counts once. Of each part the last ``keep`` states
    stay, the older ones are deleted after a batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str = "date", keep: int = 2):
        self.spark, self.path, self.schema, self.by, self.keep = spark, path.rstrip("/"), schema, by, keep
        self.columns = spark.createDataFrame([], schema).columns

    def _part(self, df: DataFrame) -> Column:
        value = F.date_format(self.by, "yyyy-MM") if dict(df.dtypes)[self.by] in ("date", "timestamp", "timestamp_ntz") else F.col(self.by).cast("string")
        return F.coalesce(value, F.lit("none")).alias("part")

    def _folder(self, path: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        root, fs = self._folder(path)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def versions(self) -> list[int]:
        """Numbers of the batches that were written to their end."""
        numbers = sorted(int(n[1:]) for n in self._names(self.path) if n[:1] == "v")
        return [v for v in numbers if "_SUCCESS" in self._names(f"{self.path}/v{v}")]

    def parts(self, below: int | None = None) -> dict[str, list[int]]:
        """The batches that hold each part, in order."""
        out: dict[str, list[int]] = {}
        for v in self.versions():
            if below is None or v < below:
                for n in self._names(f"{self.path}/v{v}"):
                    if "=" in n:
                        out.setdefault(n, []).append(v)
        return out

    def read(self, below: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The table as the batches below ``below`` left it; of the parts in ``only`` if given."""
        found = [f"{self.path}/v{held[-1]}/{part}" for part, held in self.parts(below).items() if only is None or part in only]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def merge(self, fresh: DataFrame, batch: int, keys: list[str], partial: str, stamp: str) -> None:
        fresh = cut(fresh.select(self.columns), "fresh")
        touched = {f"part={r[0]}" for r in fresh.select(self._part(fresh)).distinct().collect()}  # months, not rows
        merged = upsert(self.read(batch, touched).select(self.columns), fresh, keys, partial, stamp)
        merged.withColumn("part", self._part(merged)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{batch}")
        for part, held in self.parts().items():
            for v in held[: -self.keep]:
                old, fs = self._folder(f"{self.path}/v{v}/{part}")
                fs.delete(old, True)


def upsert_stream(source: DataFrame, store: Store, keys: list[str], partial: str, stamp: str, checkpoint: str, every: str | None = None):
    """Starts merging a streaming ``source`` into ``store``; without ``every`` it takes what there is and ends."""
    out = source.writeStream.foreachBatch(lambda df, n: store.merge(df, n, keys, partial, stamp)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def best_reading_stream(source: DataFrame, keys: list[str], partial: str, stamp: str, values: list[str]) -> DataFrame:
    """The same rule as a stateful aggregation: per key the complete reading before the partial one, then the latest. Run it in update or complete mode."""
    best = F.min_by(F.struct(*values, partial, stamp), F.struct(F.coalesce(F.col(partial), F.lit(True)), -F.unix_micros(F.col(stamp).cast("timestamp"))))
    return source.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def daily_totals_stream(source: DataFrame, time: str, group: str, value: str, late: str = "2 days") -> DataFrame:
    """Tumbling calendar-day sums per group; a day is final once the watermark has passed it."""
    w = source.withWatermark(time, late).groupBy(F.window(time, "1 day"), group)
    return w.agg(F.sum(value).alias("total"), F.count("*").alias("readings")).select(F.to_date("window.start").alias("day"), group, "total", "readings")


def readiness(store: DataFrame, day: str, partial: str, weekdays: int = 10, today: Column | None = None) -> DataFrame:
    """One row: complete weekdays and weekend days collected, weekdays still needed, whether they suffice, the last complete day and the
    days missing before it; the newest day of any record, how many days ago that was, and whether that is more than one: then the
    collection may have stopped. Without records the days are null and nothing is ready."""
    d = F.col("d")
    seen = store.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("d")).agg(F.bool_or(~F.coalesce(F.col(partial), F.lit(True))).alias("done"))
    whole = F.when(F.col("done"), d)
    n = F.count_if(F.col("done") & (F.weekday(d) < 5))
    age = F.datediff(F.current_date() if today is None else today, F.max(d))
    return seen.agg(
        n.alias("weekdays"), F.count_if(F.col("done") & (F.weekday(d) >= 5)).alias("weekend_days"), F.greatest(weekdays - n, F.lit(0)).alias("weekdays_needed"), (n >= weekdays).alias("ready"), F.max(whole).alias("last_day"),
        (F.datediff(F.max(whole), F.min(whole)) + 1 - F.count(whole)).alias("days_missing"), F.max(d).alias("newest"), age.alias("days_old"), F.coalesce(age > 1, F.lit(False)).alias("is_stale"),
    )


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of ``folder``, a file or a directory of files, as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/{table}.parquet*")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quaymill/{name}-{uuid.uuid4().hex}"
