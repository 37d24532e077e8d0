"""Queries of the operators for training data, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.functions.missing import MOST_COUNT, MOST_PER_KM2, no_number, no_text
from quaymill.llm.canonical import map_to_canonical
from quaymill.llm.clusters import cluster, describe
from quaymill.llm.mixing import mix
from quaymill.llm.packing import pack, packing_report
from quaymill.llm.spans import anchors, repeated_units, shared_pairs, shared_runs, shared_share
from quaymill.llm.tokens import with_tokens
from quaymill.llm.topn import top_n_per_group
from quaymill.session import attach, cut, table

TOP = 5
ALIKE = {"density_pop_per_km2": 1900.0, "poi_total_count": 14.0, "intersection_density": 9.0, "pnr_walkability_ratio": 0.033}
ENTRIES = (("chennai_station_target", "cmrl_name"), ("chennai_station_target", "station"), ("fact_observed", "station_cmrl"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chennai_powerbi_stations").where(~no_text(F.col("corridor_line")))
    top = top_n_per_group(rows, ["phase", "corridor_line"], "station_id", "predicted_boardings", TOP)
    return top.select("phase", "corridor_line", F.col("rk").cast("int").alias("rk"), "station_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    target, seen, names = (table(spark, d, t) for t in ("chennai_station_target", "fact_observed", "station_names"))
    rows = target.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tab"), F.lit(c).alias("fld"), F.col("target_id").cast("string").alias("row_key"), F.col(c).alias("entry")) for t, c in ENTRIES[:2]))).alias("r")).select("r.*")
    feeds = seen.select(F.col("station_cmrl").alias("entry")).where("entry is not null").distinct()
    rows = rows.unionByName(feeds.select(*(F.lit(x).alias(a) for x, a in zip(ENTRIES[2], ("tab", "fld"))), F.col("entry").alias("row_key"), "entry"))
    listed = names.select(F.col("station").alias("entry")).where("entry is not null").distinct()
    cases = cut(rows.where(F.col("entry").rlike(r"(?U)\S")).join(attach(listed), "entry", "left_anti"), "cases")
    meant = map_to_canonical(cases, "entry", names, "ref_id", ["station", "alias"])
    return cases.join(meant, "entry").select("tab", "fld", "row_key", F.col("ref_id").cast("int").alias("ref_id"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entries that mean no station, per field."""
    return p3_found(spark, d).groupBy("tab", "fld").agg(F.count("*").alias("cases"), F.count_if(F.col("ref_id") == -1).alias("unmatched"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    counted = ~no_number(F.col("poi_total_count"), MOST_COUNT) & ~no_number(F.col("intersection_density"), MOST_COUNT)
    usable = counted & ~no_number(F.col("density_pop_per_km2"), MOST_PER_KM2) & ~no_number(F.col("pnr_walkability_ratio"), MOST_COUNT)
    return cluster(table(spark, d, "chennai_powerbi_stations"), "station_id", ALIKE, usable)[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = cut(_members(spark, d), "members")
    several = m.groupBy("cluster").count().where("count > 1").select("cluster")
    return m.join(several, "cluster", "left_semi").select(F.col("key").alias("station_id"), F.col("cluster").alias("cluster_key"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe(cut(_members(spark, d), "members"), list(ALIKE.values())).select(F.col("cluster").alias("cluster_key"), "size", F.col("rk").cast("int").alias("rk"), F.col("key").alias("station_id"))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = cut(with_tokens(table(spark, d, "documents"), "text", [F.col("doc_id").alias("id")]), "sizes")
    caps = table(spark, d, "pack_sizes").select("container", F.col("capacity_tokens").alias("capacity"))
    return pack(sizes, caps), caps


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    packed, caps = _packed(spark, d)
    return packing_report(cut(packed, "bins"), caps)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    sized = with_tokens(docs, "text", [F.col("doc_id").alias("id"), "source"], weight=True)
    return mix(cut(sized, "sized"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    around, copies = anchors(table(spark, d, "documents"), "doc_id", "text")
    pairs = shared_pairs(shared_runs(around), copies)
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, "doc_id", "text", *anchors(docs, "doc_id", "text")).withColumnRenamed("doc", "doc_id")


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return repeated_units(table(spark, d, "documents"), "doc_id", "text", ["created_at"]).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_unmatched, p5_found, p5_clusters, p8_packed, p8_report, p9_mix, p9_report, p10_found, p10_shared, p10_units)}

SQL = {
    "p1_found": r"""
WITH s AS (SELECT DISTINCT phase, corridor_line, station_id, predicted_boardings AS b FROM chennai_powerbi_stations
  WHERE phase IS NOT NULL AND station_id IS NOT NULL AND predicted_boardings IS NOT NULL AND NOT isnan(predicted_boardings)
    AND corridor_line IS NOT NULL AND regexp_replace(lower(corridor_line), '\bline\b', '') ~ '[a-z0-9]'
    AND trim(regexp_replace(trim(lower(corridor_line)), '\s*\bline$', '')) NOT IN ('n/a', 'nan', 'tbd', 'unknown', 'none', 'null', 'na', 'tba', 'tbc')),
m AS (SELECT phase, corridor_line, station_id, max(b) AS b FROM s GROUP BY ALL)
SELECT phase, corridor_line, row_number() OVER (PARTITION BY phase, corridor_line ORDER BY b DESC, station_id)::INT AS rk, station_id FROM m
QUALIFY rk <= 5
""",
    "p10_units": r"""
WITH l AS (SELECT doc_id, created_at, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  trim(regexp_replace(lower(line), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g')) AS plain FROM l),
h AS (SELECT * FROM o WHERE length(plain) >= 40),
g AS (SELECT plain, arg_min((doc_id, pos), (created_at IS NULL, created_at, doc_id, pos)) AS f FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, unit::INT AS unit, pos::INT AS "offset", length(line)::INT AS chars, f[1] AS first_doc, doc_id = f[1] AND pos = f[2] AS kept FROM h JOIN g USING (plain)
""",
}
