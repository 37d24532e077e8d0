"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymill.functions import scalars as X
from quaymill.functions.missing import no_text
from quaymill.operators import tables as T
from quaymill.plans.registry import Registry
from quaymill.session import table
from quaymill.sources.web import alignment_class, station_class

R = Registry()
S = SparkSession


@R.query("""SELECT o_orderkey, isodow(o_orderdate) - 1 AS weekday, isodow(o_orderdate) < 6 AS is_weekday, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month, year(o_orderdate) AS year, weekofyear(o_orderdate) AS iso_week,
day(last_day(o_orderdate)) AS days, (o_orderdate::DATE + 14) AS later, (o_orderdate::DATE - 14) AS earlier, strftime(o_orderdate, '%Y-%m-%d %a') AS header, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':00' AS label FROM orders""")
def q_date_parts(spark: S, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), F.col("o_orderdate")
    return o.select(
        "o_orderkey", X.weekday(c).cast("bigint").alias("weekday"), X.is_weekday(c).alias("is_weekday"), F.date_format(c, "EEEE").alias("day_name"), F.date_format(c, "MMMM").alias("month"), F.year(c).cast("bigint").alias("year"),
        F.weekofyear(c).cast("bigint").alias("iso_week"), X.days_in_month(c).cast("bigint").alias("days"), F.date_add(F.to_date(c), 14).alias("later"), F.date_sub(F.to_date(c), 14).alias("earlier"),
        F.date_format(c, "yyyy-MM-dd EEE").alias("header"), X.hour_label(F.col("o_orderkey") % 24).alias("label"),
    )


@R.query("""WITH t AS (SELECT s_suppkey, 'Rs ' || s_suppkey % 99 || ',' || lpad((s_suppkey % 97)::VARCHAR, 2, '0') || ',' || lpad((s_suppkey % 991)::VARCHAR, 3, '0') || ' /-' AS raw FROM supplier)
SELECT s_suppkey, (s_suppkey % 99) * 100000.0 + (s_suppkey % 97) * 1000.0 + s_suppkey % 991 AS amount FROM t""")
def q_clean_numeric(spark: S, d: str) -> DataFrame:
    """Indian digit groups with units around."""
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("Rs "), (k % 99).cast("string"), F.lit(","), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(","), F.lpad((k % 991).cast("string"), 3, "0"), F.lit(" "))
    return table(spark, d, "supplier").select("s_suppkey", X.number_in(raw).cast("decimal(18,1)").alias("amount"))


@R.query("SELECT DISTINCT o_orderdate::DATE AS d, date_trunc('month', o_orderdate)::DATE AS month FROM orders")
def q_month_label(spark: S, d: str) -> DataFrame:
    """A label like 'Apr-98' read back as a month."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return o.select("d", X.month_of(F.date_format("d", "MMM-yy")).alias("month"))


@R.query(r"""SELECT p_partkey, regexp_replace(regexp_replace('noOf' || replace(initcap_all, ' ', ''), '^noOf', ''), '([a-z])([A-Z])', '\1 \2', 'g') AS words FROM
(SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS initcap_all FROM part)""")
def q_camel_split(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.words_of_camel(F.concat(F.lit("noOf"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))).alias("words"))


@R.query(r"""SELECT ref_id, trim(regexp_replace(regexp_replace(station, '\s+(?:I{1,3}|IV|V|\d+)\s*$', ''), '(?i)\s+(?:depot|market|north|south|east|west|inner|outer|bus stand|junction)\s*$', '')) AS stem,
regexp_matches(coalesce(alias, ''), '[A-Za-z]') AS latin_alias FROM station_names""")
def q_stem(spark: S, d: str) -> DataFrame:
    return table(spark, d, "station_names").select("ref_id", X.stem(F.col("station")).alias("stem"), F.coalesce(X.has_latin(F.col("alias")), F.lit(False)).alias("latin_alias"))


_LU = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{g}'" for g, ws in X.LAND_USE.items())


@R.query(f"SELECT doc_id, CASE {_LU} ELSE 'Other' END AS land_use, CASE {_LU} ELSE 'Barren/Open' END AS land_use_open FROM documents")
def q_land_use(spark: S, d: str) -> DataFrame:
    """Both variants: what fits no group is other, or open land."""
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.land_use(text).alias("land_use"), X.land_use(text, open_by_default=True).alias("land_use_open"))


#: Tags of railway elements as maps write them; the query gives each station some of them in turn.
_TAGS = {
    "railway": ["station", "construction", "halt", "proposed", "rail", None, "Station"],
    "station": ["subway", None, None, "light_rail", None],
    "construction": [None, "station", None, "tower", None, None, None, "subway", None, None, None],
    "construction:railway": [None, None, None, "station", None, None, "rail", None, None, None, None, None, None],
    "proposed:railway": [None, None, "halt", None, None, None, None, None, None, None, None, None, None, None, None, None, None],
    "network": ["CMRL", None, "Southern Railway", None],
    "operator": [None, "Bangalore Metro", "IR"],
    "subway": [None, "yes", "no", None, None, None, None, None, None],
}
_TAG_SQL = {k: "coalesce(lower(" + f"([{', '.join('NULL' if v is None else repr(v) for v in vs)}])[ref_id % {len(vs)} + 1]" + "), '')" for k, vs in _TAGS.items()}


@R.query(f"""WITH t AS (SELECT ref_id, lower(coalesce(station, '')) AS name, {', '.join(f'{c} AS "{k}"' for k, c in _TAG_SQL.items())} FROM station_names),
m AS (SELECT *, station = 'subway' OR subway = 'yes' OR name LIKE '%metro%' OR network || ' ' || operator SIMILAR TO '.*(metro|cmrl|bmrcl).*' AS metro,
railway IN ('construction', 'proposed') OR "construction:railway" IN ('station', 'halt') OR "proposed:railway" IN ('station', 'halt') OR construction IN ('station', 'subway', 'light_rail') AS unfinished FROM t)
SELECT ref_id, CASE WHEN unfinished AND (metro OR "construction:railway" <> '' OR "proposed:railway" <> '') THEN 'metro_construction' WHEN unfinished THEN 'other_construction'
WHEN metro THEN 'metro_operational' WHEN railway IN ('station', 'halt') THEN 'other_rail' ELSE 'other' END AS kind FROM m""")
def q_station_class(spark: S, d: str) -> DataFrame:
    """What a railway element is by its tags."""
    entries = [x for k, vs in _TAGS.items() for x in (F.lit(k), F.get(F.array(*map(F.lit, vs)), F.col("ref_id") % len(vs)))]
    tags = F.create_map(F.lit("name"), F.col("station"), *entries)
    return table(spark, d, "station_names").select("ref_id", station_class(tags).alias("kind"))


_ALIGNMENTS = ["Chennai Metro Line 1", "Chennai Metro Line 2", "Line 3: A - B", "CMRL Line 5: C - D", "Yellow Line (u/c)", "Line 3: Proposed", "Line 5B: x", "Yellow Line corridor switch", "Line 9", "", None]


@R.query(f"""WITH a AS (SELECT ref_id, ([{', '.join('NULL' if a is None else repr(a) for a in _ALIGNMENTS)}])[ref_id % {len(_ALIGNMENTS)} + 1] AS name FROM station_names),
k AS (SELECT *, coalesce(lower(name) LIKE '%proposed%' OR name LIKE '%Line 5B%' OR name LIKE '%corridor switch%', true) AS out FROM a)
SELECT ref_id, CASE WHEN out THEN NULL WHEN name IN ('Chennai Metro Line 1', 'Chennai Metro Line 2') THEN 'phase1' WHEN name LIKE '%Line 3:%' OR name LIKE '%Line 5:%' OR name LIKE '%Yellow Line%' THEN 'phase2' END AS phase,
CASE WHEN out THEN NULL WHEN name = 'Chennai Metro Line 1' THEN 'Blue Line' WHEN name = 'Chennai Metro Line 2' THEN 'Green Line' WHEN name LIKE '%Line 3:%' THEN 'Purple Line' WHEN name LIKE '%Line 5:%' THEN 'Red Line'
WHEN name LIKE '%Yellow Line%' THEN 'Yellow Line' END AS line FROM k""")
def q_alignment_class(spark: S, d: str) -> DataFrame:
    """Phase and line of an alignment by its name."""
    name = F.get(F.array(*map(F.lit, _ALIGNMENTS)), F.col("ref_id") % len(_ALIGNMENTS))
    return table(spark, d, "station_names").select("ref_id", alignment_class(name).alias("c")).select("ref_id", "c.phase", "c.line")


@R.query("""SELECT event_id, (json_extract(props, '$.k'))::INT AS k FROM events""")
def q_json_props(spark: S, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.query("""SELECT station_id, floor((longitude + 180) / 10)::BIGINT + 1 AS tile_col, floor((90 - latitude) / 10)::BIGINT + 1 AS tile_row FROM dim_station WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180""")
def q_tile_index(spark: S, d: str) -> DataFrame:
    s = table(spark, d, "dim_station").where("latitude between -90 and 90 and longitude between -180 and 180")
    return s.select("station_id", (F.floor((F.col("longitude") + 180) / 10) + 1).alias("tile_col"), (F.floor((90 - F.col("latitude")) / 10) + 1).alias("tile_row"))


@R.query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'very low' WHEN c_acctbal < 3000 THEN 'low' WHEN c_acctbal < 6000 THEN 'medium' WHEN c_acctbal < 8000 THEN 'high' ELSE 'very high' END AS tier FROM customer""")
def q_tier(spark: S, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.tier(F.col("c_acctbal"), (0, 3000, 6000, 8000), ("very low", "low", "medium", "high", "very high")).alias("tier"))


@R.query("""WITH m AS (SELECT median(p_size) AS a, median(p_retailprice) AS b FROM part)
SELECT p_partkey, CASE WHEN p_size >= a AND p_retailprice >= b THEN 'high_high' WHEN p_size >= a THEN 'high_low' WHEN p_retailprice >= b THEN 'low_high' ELSE 'low_low' END AS quadrant,
CASE p_type WHEN 'ECONOMY' THEN 'Eco' WHEN 'SMALL' THEN 'Min' ELSE p_type END AS label FROM part, m""")
def q_quadrant(spark: S, d: str) -> DataFrame:
    p = T.with_totals(table(spark, d, "part"), a=F.median("p_size"), b=F.median("p_retailprice"))
    return p.select("p_partkey", X.quadrant(F.col("p_size"), F.col("p_retailprice"), F.col("a"), F.col("b")).alias("quadrant"), X.mapped(F.col("p_type"), {"ECONOMY": "Eco", "SMALL": "Min"}, F.col("p_type")).alias("label"))


@R.query("""SELECT station_id, min(CASE WHEN lower(coalesce(phase, '')) LIKE 'phase1%' AND lower(coalesce(layout, '')) = 'underground' THEN 'operational_deep' WHEN lower(coalesce(phase, '')) LIKE 'phase1%' THEN 'operational'
WHEN position_source IN ('osm', 'wikipedia') THEN 'planned_surveyed' ELSE 'planned' END) AS kind FROM dim_station GROUP BY 1""")
def q_station_kind(spark: S, d: str) -> DataFrame:
    """A classifier of several branches over optional fields."""
    phase, layout = (F.lower(F.coalesce(c, F.lit(""))) for c in ("phase", "layout"))
    kind = F.when(phase.startswith("phase1") & (layout == "underground"), "operational_deep").when(phase.startswith("phase1"), "operational")
    kind = kind.when(F.col("position_source").isin("osm", "wikipedia"), "planned_surveyed").otherwise("planned")
    return table(spark, d, "dim_station").groupBy("station_id").agg(F.min(kind).alias("kind"))


@R.query("""SELECT line, CASE WHEN line ~ '^Saffron' THEN 'trunk' WHEN line ~ '^(Blue|Teal)' THEN 'cool' WHEN line ~ '^(Red|Coral)' THEN 'warm' ELSE line END AS merged, count(*) AS n FROM dim_station WHERE line IS NOT NULL GROUP BY ALL""")
def q_rule_table(spark: S, d: str) -> DataFrame:
    """The first rule that matches renames; others stay."""
    rules = [("^Saffron", "trunk"), ("^(Blue|Teal)", "cool"), ("^(Red|Coral)", "warm")]
    s = table(spark, d, "dim_station").where("line is not null")
    return s.groupBy("line", X.first_rule(F.col("line"), rules).alias("merged")).agg(F.count("*").alias("n"))


@R.query("""SELECT pred_id, round(predicted_boardings - predicted_lower, 6) AS below, round(predicted_upper - predicted_boardings, 6) AS above, round(predicted_upper - predicted_lower, 6) AS width,
round(greatest(predicted_lower, 0), 6) AS lower_clipped, (predicted_boardings > 8000)::INT AS is_large FROM fact_prediction WHERE predicted_boardings IS NOT NULL AND NOT isnan(predicted_boardings) AND NOT isnan(predicted_lower) AND NOT isnan(predicted_upper) AND predicted_lower IS NOT NULL""")
def q_intervals(spark: S, d: str) -> DataFrame:
    p, lo, hi = (F.col(f"predicted_{c}") for c in ("boardings", "lower", "upper"))
    f = table(spark, d, "fact_prediction").where("predicted_boardings is not null and predicted_lower is not null and not isnan(predicted_boardings) and not isnan(predicted_lower) and not isnan(predicted_upper)")
    return f.select("pred_id", F.round(p - lo, 6).alias("below"), F.round(hi - p, 6).alias("above"), F.round(hi - lo, 6).alias("width"), F.round(X.clipped(lo, 0.0), 6).alias("lower_clipped"), (p > 8000).cast("int").alias("is_large"))


@R.query("SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 3 WHEN c_acctbal >= 8000 THEN 12 ELSE 3 + c_acctbal / 8000 * 9 END, 3) AS marker, round(ln(1 + greatest(c_acctbal, 0)), 5) AS log1p, round(sqrt(c_acctbal ** 2 + c_nationkey ** 2), 4) AS hypot FROM customer")
def q_math(spark: S, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(X.interpolated(b, 0, 8000, 3.0, 12.0), 3).alias("marker"), F.round(F.log1p(F.greatest(b, F.lit(0.0))), 5).alias("log1p"), F.round(F.hypot(b, F.col("c_nationkey")), 4).alias("hypot"))


@R.query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3) AND NOT regexp_matches(c_name, '(?i)0{8}1|99$') AND length(trim(c_name)) > 0""")
def q_conjunctive_filter(spark: S, d: str) -> DataFrame:
    """Equality, membership, exclusion by pattern and non-blank, all pushed as far as the scan takes them."""
    c = table(spark, d, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.col("c_nationkey").isin(1, 2, 3))
    return c.where(~F.coalesce(F.col("c_name").rlike("(?i)0{8}1|99$"), F.lit(False)) & (F.length(F.trim("c_name")) > 0)).select("c_custkey", "c_mktsegment")


@R.query("""SELECT ref_id, cmrl_name FROM (SELECT target_id AS ref_id, cmrl_name FROM chennai_station_target) WHERE contains(lower(cmrl_name), '(') OR contains(lower(cmrl_name), 'st.') OR contains(lower(cmrl_name), '[1]')""")
def q_literal_search(spark: S, d: str) -> DataFrame:
    """An alternation of literals: nothing in them is a pattern."""
    t = table(spark, d, "chennai_station_target").where(X.contains_any(F.col("cmrl_name"), ("(", "st.", "[1]")))
    return t.select(F.col("target_id").alias("ref_id"), "cmrl_name")


@R.query("""SELECT station_id, phase, corridor_line FROM (SELECT DISTINCT station_id, phase, corridor_line, is_top15_phase2, position_confidence FROM chennai_powerbi_stations)
WHERE CASE WHEN corridor_line = 'Saffron Trunk Line' THEN true ELSE phase = 'Phase 2A' END AND position_confidence <> 'low'""")
def q_layer_filter(spark: S, d: str) -> DataFrame:
    """A corridor filter that takes precedence over the phase filter."""
    s = table(spark, d, "chennai_powerbi_stations").where("position_confidence <> 'low'").select("station_id", "phase", "corridor_line").distinct()
    return s.where(F.coalesce(F.when(F.col("corridor_line") == "Saffron Trunk Line", True).otherwise(F.col("phase") == "Phase 2A"), F.lit(False)))


@R.query("""SELECT phase, is_top15_phase2 AS label_top15, count(DISTINCT station_id) AS stations, count(DISTINCT station_id) FILTER (position_confidence = 'low') AS low_confidence, count(DISTINCT station_id) FILTER (is_intermodal_hub = 1) AS hubs
FROM chennai_powerbi_stations GROUP BY 1, 2""")
def q_layer_subsets(spark: S, d: str) -> DataFrame:
    sid = F.col("station_id")
    return table(spark, d, "chennai_powerbi_stations").groupBy("phase", F.col("is_top15_phase2").alias("label_top15")).agg(
        F.count_distinct(sid).alias("stations"), F.count_distinct(F.when(F.col("position_confidence") == "low", sid)).alias("low_confidence"), F.count_distinct(F.when(F.col("is_intermodal_hub") == 1, sid)).alias("hubs")
    )


@R.query("""SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN '#d62728' WHEN 1 THEN '#1f77b4' WHEN 2 THEN '#2ca02c' ELSE '#7f7f7f' END AS colour, n_regionkey <= 1 AS known FROM nation""")
def q_palette(spark: S, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", "n_name", X.mapped(F.col("n_regionkey").cast("string"), {"0": "#d62728", "1": "#1f77b4", "2": "#2ca02c"}, F.lit("#7f7f7f")).alias("colour"), (F.col("n_regionkey") <= 1).alias("known"))


@R.query("""SELECT s_suppkey, s_nationkey % 3 = 0 AS shop, s_nationkey % 5 = 0 AS cafe FROM supplier""")
def q_tag_predicate(spark: S, d: str) -> DataFrame:
    """Key-value tags in text, tested by key and by value."""
    n = F.col("s_nationkey")
    raw = F.concat(F.lit('"name"=>"a ""b"'), F.when(n % 3 == 0, F.lit(',"shop"=>"yes \\"big\\""')).otherwise(""), F.when(n % 5 == 0, F.lit(', "amenity"=>"cafe"')).otherwise(F.lit(', "amenity"=>"bank"')))
    tags = X.tags_of(F.replace(raw, F.lit('""'), F.lit('\\"')))
    return table(spark, d, "supplier").select("s_suppkey", X.has_tag(tags, "shop").alias("shop"), X.has_tag(tags, "amenity", ["cafe"]).alias("cafe"))


@R.query("""WITH h AS (SELECT median(o_totalprice) > 100000 AS monthly FROM orders) SELECT o_orderkey, round(CASE WHEN monthly THEN o_totalprice / 30.4 ELSE o_totalprice END, 4) AS daily FROM orders, h""")
def q_daily_heuristic(spark: S, d: str) -> DataFrame:
    """A column whose median is too large for a day is taken as monthly."""
    o = T.with_totals(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), mid=F.median("o_totalprice"))
    return o.select("o_orderkey", F.round(F.when(F.col("mid") > 100000, F.col("o_totalprice") / 30.4).otherwise(F.col("o_totalprice")), 4).alias("daily"))


@R.query("""SELECT p_partkey, round(least((p_size % 40 + 1) / 40.0, 1), 6) AS pnr, round(least((p_size % 40 + 1) / 40.0, 1) * pi() * 800 * 800, 2) AS served_m2, round((1 - least((p_size % 40 + 1) / 40.0, 1)) * pi() * 800 * 800, 2) AS severed_m2
FROM part WHERE (p_size % 40 + 1) / 40.0 < 0.30""")
def q_severed_areas(spark: S, d: str) -> DataFrame:
    """The part of a walking circle that streets reach, and the part cut off, where little is reached."""
    pnr = F.least((F.col("p_size") % 40 + 1) / 40.0, F.lit(1.0))
    circle = F.pi() * 800 * 800
    return table(spark, d, "part").where(pnr < 0.30).select("p_partkey", F.round(pnr, 6).alias("pnr"), F.round(pnr * circle, 2).alias("served_m2"), F.round((1 - pnr) * circle, 2).alias("severed_m2"))


@R.query("""SELECT obs_id, lpad(line, 2, '0') AS line, CASE WHEN boardings >= 0 THEN boardings END AS boardings FROM fact_observed WHERE NOT is_partial""")
def q_clean_observed(spark: S, d: str) -> DataFrame:
    b = F.col("boardings")
    return table(spark, d, "fact_observed").where("not is_partial").select("obs_id", X.padded(F.col("line")).alias("line"), F.when(b >= 0, b).alias("boardings"))


@R.query("""SELECT to_json({'id': n_nationkey, 'name': n_name}) AS feature FROM nation""")
def q_to_json(spark: S, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("feature"))


@R.query("SELECT count(*) AS rows, count(*) FILTER (corridor_line IS NULL OR trim(corridor_line) IN ('', '-', 'N/A', 'TBD', 'nan', 'Unknown', 'unknown line')) AS unnamed FROM chennai_powerbi_stations")
def q_unnamed_lines(spark: S, d: str) -> DataFrame:
    return table(spark, d, "chennai_powerbi_stations").agg(F.count("*").alias("rows"), F.count_if(no_text(F.col("corridor_line"))).alias("unnamed"))


# ---- measures: filters as rows, all in one pass

_STATIONS = "(SELECT DISTINCT station_id, phase, corridor_line, strategic_action, is_intermodal_hub, CASE WHEN NOT isnan(predicted_boardings) THEN predicted_boardings END AS p, lower_ci_95 AS lo, upper_ci_95 AS hi FROM chennai_powerbi_stations)"
_FILTERS = {
    "all": "true", "phase_1": "phase = 'Phase 1'", "later_phases": "phase <> 'Phase 1'", "named_line": "corridor_line IS NOT NULL", "trunk": "corridor_line = 'Saffron Trunk Line'",
    "hubs": "is_intermodal_hub = 1", "with_action": "strategic_action IS NOT NULL", "large": "p > 8000", "never": "phase = 'never delivered'",
}


def _measured(spark: S, d: str) -> DataFrame:
    cols = ["station_id", "phase", "corridor_line", "strategic_action", "is_intermodal_hub"]
    p = F.col("predicted_boardings")
    return table(spark, d, "chennai_powerbi_stations").select(*cols, F.when(~F.isnan(p), p).alias("p"), F.col("lower_ci_95").alias("lo"), F.col("upper_ci_95").alias("hi")).distinct()


def _long(one: DataFrame, names: list[str], **values: str) -> DataFrame:
    """One row of aggregates as a row per measure."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), *(F.col(f"{v}_{n}").alias(k) for k, v in values.items())) for n in names))).alias("m")).select("m.*")


_MEASURE_SQL = {k: f"SELECT '{k}' AS measure, {{}} FROM {_STATIONS} s" for k in _FILTERS}


@R.query(" UNION ALL ".join(q.format(f"count(*) FILTER ({_FILTERS[k]}) AS stations") for k, q in _MEASURE_SQL.items()))
def q_measure_counts(spark: S, d: str) -> DataFrame:
    return _long(_measured(spark, d).agg(*(F.count_if(F.expr(c)).alias(f"n_{k}") for k, c in _FILTERS.items())), list(_FILTERS), stations="n")


@R.query(" UNION ALL ".join(q.format(f"coalesce(sum(p::DECIMAL(18, 2)) FILTER ({_FILTERS[k]}), 0)::DECIMAL(28, 2) AS total, round(coalesce(100 * sum(p) FILTER ({_FILTERS[k]}) / nullif(sum(p), 0), 0), 6) AS share_pct") for k, q in _MEASURE_SQL.items()))
def q_measure_totals(spark: S, d: str) -> DataFrame:
    """Totals and their shares of everything; 0 where a filter keeps none."""
    p = F.col("p")
    sums = [x for k, c in _FILTERS.items() for x in (
        F.coalesce(F.sum(F.when(F.expr(c), p.cast("decimal(18,2)"))), F.lit(0)).cast("decimal(28,2)").alias(f"t_{k}"), F.round(F.coalesce(F.try_divide(100 * F.sum(F.when(F.expr(c), p)), F.sum(p)), F.lit(0.0)), 6).alias(f"s_{k}"),
    )]
    return _long(_measured(spark, d).agg(*sums), list(_FILTERS), total="t", share_pct="s")


@R.query(" UNION ALL ".join(q.format(f"round(avg(hi - lo) FILTER (({_FILTERS[k]}) AND NOT isnan(hi) AND NOT isnan(lo)), 4) AS width, max(p) FILTER ({_FILTERS[k]}) AS most, min(p) FILTER ({_FILTERS[k]}) AS least") for k, q in _MEASURE_SQL.items()))
def q_measure_bounds(spark: S, d: str) -> DataFrame:
    """Mean width of the intervals and the extremes."""
    p, width = F.col("p"), F.when(~F.isnan("hi") & ~F.isnan("lo"), F.col("hi") - F.col("lo"))
    aggs = [x for k, c in _FILTERS.items() for x in (F.round(F.avg(F.when(F.expr(c), width)), 4).alias(f"w_{k}"), F.max(F.when(F.expr(c), p)).alias(f"hi_{k}"), F.min(F.when(F.expr(c), p)).alias(f"lo_{k}"))]
    return _long(_measured(spark, d).agg(*aggs), list(_FILTERS), width="w", most="hi", least="lo")


_MEANS = ["density_pop_per_km2", "pnr_walkability_ratio", "bus_stops_500m", "poi_total_count", "distance_cbd_km", "population_800m", "predicted_boardings"]


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS measure, round(avg({c}) FILTER (NOT isnan({c}::DOUBLE) AND {c} >= 0), 4) AS mean FROM chennai_powerbi_stations" for c in _MEANS))
def q_measure_means(spark: S, d: str) -> DataFrame:
    """Means of the known values of several columns in one pass."""
    means = [F.round(F.avg(F.when(~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0), F.col(c))), 4).alias(f"m_{c}") for c in _MEANS]
    return _long(table(spark, d, "chennai_powerbi_stations").agg(*means), _MEANS, mean="m")


QUERIES, SQL = R.queries, R.sql
