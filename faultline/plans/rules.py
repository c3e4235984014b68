"""Queries of hard rules, guardrails and report validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import safety
from ..session import table
from .registry import query


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 52).cast("int").alias("device_type"), (F.col("event_id") % 2003).cast("int").alias("sensor_id"), F.pmod(F.floor("value"), F.lit(5)).cast("int").alias("severity"))


def rules(spark: SparkSession) -> DataFrame:
    """All kinds of rules; the higher number wins."""
    rows = [(1, None, None, 0, False), (2, 3, None, None, False), (3, None, 101, None, True), (4, 7, 55, None, False), (5, 3, 303, 2, True), (6, 9, None, 4, False), (7, None, 77, 1, False), (8, 3, None, None, True), (9, 11, None, None, False)]
    return safety.check_indexes(spark.createDataFrame(rows, safety.RULES))


GUARD = """
WITH e AS (SELECT event_id, (user_id % 52)::INT AS d, (event_id % 2003)::INT AS s, (((floor(value)::BIGINT % 5) + 5) % 5)::INT AS v FROM events),
r(n, d, s, v, a) AS (VALUES (1, NULL, NULL, 0, false), (2, 3, NULL, NULL, false), (3, NULL, 101, NULL, true), (4, 7, 55, NULL, false), (5, 3, 303, 2, true), (6, 9, NULL, 4, false), (7, NULL, 77, 1, false), (8, 3, NULL, NULL, true), (9, 11, NULL, NULL, false)),
h AS (SELECT e.event_id, any_value(e.v) AS v, CASE WHEN any_value(e.d) < 50 AND any_value(e.s) < 2000 THEN coalesce(arg_max(r.a, r.n), true) ELSE true END AS allowed
  FROM e LEFT JOIN r ON (r.d IS NULL OR r.d = e.d) AND (r.s IS NULL OR r.s = e.s) AND (r.v IS NULL OR r.v = e.v) GROUP BY e.event_id)
"""


@query(f"{GUARD} SELECT event_id, allowed, CASE WHEN NOT allowed THEN 'block' WHEN v <= 0 THEN 'pass' ELSE 'llm' END AS route FROM h")
def guard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-03 to SAF-05, SAF-08, JOI-05."""
    return safety.guard(readings(spark, sf_dir), rules(spark)).select("event_id", "allowed", "route")


@query(f"{GUARD} SELECT count(*) FILTER (NOT allowed) AS blocked, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) / count(*)::DOUBLE AS block_ratio FROM h")
def guard_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08."""
    return safety.guard_counts(safety.guard(readings(spark, sf_dir), rules(spark)))


@query(
    """WITH e AS (SELECT event_id, (user_id % 52)::INT AS d, (event_id % 2003)::INT AS s, (((floor(value)::BIGINT % 5) + 5) % 5)::INT AS v FROM events)
SELECT event_id, NOT (v = 4 AND ((d = 0 AND s = 50) OR (d = 1 AND s IN (200, 201)) OR (d = 2 AND s = 300)) AND d < 50 AND s < 2000) OR (d = 1 AND s = 200 AND v = 4) AS allowed FROM e"""
)
def guard_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-06: bounds, flat and nested, then an allowlist."""
    bounds = spark.createDataFrame([("enrichment", 0, 50, None), ("valves", None, None, {"1": [200, 201], "2": [300]})], "name string, device_type int, sensor_id int, devices map<string, array<int>>")
    allowed = spark.createDataFrame([(1, 200, [4]), (5, 5, None)], "device_type int, sensor_id int, severities array<int>")
    every = safety.from_bounds(bounds).unionByName(safety.from_allowlist(allowed, 1 << 40))
    return safety.guard(readings(spark, sf_dir), every).select("event_id", "allowed")


@query(
    """SELECT event_id, (((floor(value)::BIGINT % 5) + 5) % 5)::INT >= 2 AS allowed FROM events WHERE user_id % 52 < 50 AND event_id % 2003 < 2000"""
)
def guard_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-03: everything under a severity blocked."""
    out = safety.guard(readings(spark, sf_dir), safety.block_below(spark, 2, 1))
    return out.filter("device_type < 50 and sensor_id < 2000").select("event_id", "allowed")


@query("SELECT event_id, CASE WHEN user_id % 52 = 3 THEN 'Pump' ELSE 'Device-' || (user_id % 52) END AS device, CASE WHEN event_id % 2003 = 5 THEN 'TE-301' ELSE 'Sensor-' || (event_id % 2003) END AS sensor FROM events")
def guard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-07."""
    devices, sensors = F.create_map(F.lit(3), F.lit("Pump")), F.create_map(F.lit(5), F.lit("TE-301"))
    return readings(spark, sf_dir).select("event_id", safety.device_name(devices, F.col("device_type")).alias("device"), safety.sensor_tag(sensors, F.col("sensor_id")).alias("sensor"))


REPORTED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 1 THEN l_quantity * 2.1 END AS ab, l_discount * 1100 - 2 AS vo, l_extendedprice / 100 - 300 AS te, l_tax * 400 AS pr, l_linenumber - 1.5 AS fl,
  0.5 + l_tax * 2 AS conf, CASE WHEN l_linenumber = 3 THEN 'This is GUARANTEED' ELSE 'fine' END AS su FROM lineitem"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from order lines, with values inside and outside the bounds."""
    rows = table(spark, sf_dir, "lineitem")
    summary = F.when(F.col("l_linenumber") == 3, "This is GUARANTEED").otherwise("fine")
    return rows.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 1, F.col("l_quantity") * 2.1).alias("abundance_pct"), (F.col("l_discount") * 1100 - 2).alias("valve_opening_pct"), (F.col("l_extendedprice") / 100 - 300).alias("temperature_c"),
        (F.col("l_tax") * 400).alias("pressure_bar"), (F.col("l_linenumber") - 1.5).alias("flow_rate"), F.array(F.struct((F.lit(0.5) + F.col("l_tax") * 2).alias("confidence"))).alias("matched_fmea"), summary.alias("diagnostic_summary"),
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN ab NOT BETWEEN 0 AND 100 THEN 'abundance' WHEN vo NOT BETWEEN 0 AND 100 THEN 'valve' WHEN te NOT BETWEEN -273.15 AND 500 THEN 'temperature' WHEN pr NOT BETWEEN 0 AND 30 THEN 'pressure'
  WHEN fl < 0 THEN 'flow' WHEN conf < 0.6 THEN 'confidence' WHEN contains(lower(su), 'guaranteed') THEN 'language' END, 'passed') AS outcome FROM ({REPORTED})"""
)
def guardrail_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-01."""
    rows = reports(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(safety.guardrail_failure(rows), F.lit("passed")).alias("outcome"))


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN ab IS NULL THEN NULL ELSE least(100, greatest(0, ab)) END, 6) AS abundance_pct, round(least(100, greatest(0, vo)), 6) AS valve_opening_pct, round(least(500, greatest(-273.15, te)), 6) AS temperature_c, round(least(30, greatest(0, pr)), 6) AS pressure_bar FROM ({REPORTED})")
def guardrail_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-02."""
    out = safety.sanitized(reports(spark, sf_dir))
    names = ("abundance_pct", "valve_opening_pct", "temperature_c", "pressure_bar")
    return out.select("l_orderkey", "l_linenumber", *(F.round(n, 6).alias(n) for n in names))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as reports with one entry, valid and not."""
    mode = F.element_at(F.array(*(F.lit(m) for m in (*fixed.FAILURE_MODES, "melting"))), (F.col("p_partkey") % 11 + 1).cast("int"))
    tag = F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("TE-"), (F.lit(300) + F.col("p_partkey") % 12).cast("string")))
    severity = (F.col("p_size") % 12).cast("int")
    rpn = F.when(F.col("p_partkey") % 7 == 0, F.lit(1)).otherwise(severity * 2 * 3)
    entry = F.struct(mode.alias("failure_mode"), severity.alias("severity"), F.lit(2).alias("occurrence"), F.lit(3).alias("detection"), rpn.cast("int").alias("rpn"), (F.col("p_retailprice") / 1800.0).alias("confidence"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("wear").alias("cause"), F.lit("").alias("recommended_action"))
    summary = F.when(F.col("p_partkey") % 17 == 0, F.lit(None)).otherwise("text")
    return table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"), F.array(entry).alias("matches"), summary.alias("summary"))


MODES = "[" + ", ".join(f"'{m}'" for m in (*fixed.FAILURE_MODES, "melting")) + "]"
STRUCTURED = f"""SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN 'TE-' || (300 + p_partkey % 12) END AS tag, {MODES}[(p_partkey % 11 + 1)::INT] AS mode, p_size % 12 AS sev, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE (p_size % 12) * 6 END AS rpn,
  p_retailprice / 1800.0::DOUBLE AS conf, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'wear' END AS cause, CASE WHEN p_partkey % 17 <> 0 THEN 'text' END AS summary FROM part"""


@query(
    f"""SELECT p_partkey, concat_ws('; ', CASE WHEN tag IS NULL THEN 'Missing required field: alarm_tag' END, CASE WHEN summary IS NULL THEN 'Missing required field: diagnostic_summary' END, CASE WHEN tag IN ('TE-300', 'TE-311') THEN 'Invalid tag ''' || tag || '''' END,
  CASE WHEN mode = 'melting' THEN 'matched_fmea[0]: invalid failure_mode ''melting''' END, CASE WHEN sev NOT BETWEEN 1 AND 10 THEN 'matched_fmea[0]: severity ' || sev || ' out of [1,10]' END, CASE WHEN conf NOT BETWEEN 0 AND 1 THEN 'matched_fmea[0]: confidence out of [0,1]' END) AS errors FROM ({STRUCTURED})"""
)
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-09."""
    return structured(spark, sf_dir).select("p_partkey", F.array_join(safety.schema_errors(F.col("tag"), F.col("matches"), F.col("summary")), "; ").alias("errors"))


@query(
    f"""SELECT p_partkey, concat_ws('; ', CASE WHEN tag IS NULL THEN 'alarm_tag: empty' WHEN tag IN ('TE-300', 'TE-311') THEN 'alarm_tag: unknown' END, CASE WHEN summary IS NULL THEN 'diagnostic_summary: empty' END,
  CASE WHEN mode = 'melting' THEN 'matched_fmea[0].failure_mode' END, CASE WHEN sev NOT BETWEEN 1 AND 10 THEN 'matched_fmea[0].severity' END, CASE WHEN rpn NOT BETWEEN 1 AND 1000 OR rpn <> sev * 6 THEN 'matched_fmea[0].rpn' END,
  CASE WHEN conf NOT BETWEEN 0 AND 1 THEN 'matched_fmea[0].confidence' END, CASE WHEN cause = '' THEN 'matched_fmea[0].cause' END) AS errors FROM ({STRUCTURED})"""
)
def model_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-10."""
    return structured(spark, sf_dir).select("p_partkey", F.array_join(safety.model_errors(F.col("tag"), F.col("matches"), F.col("summary")), "; ").alias("errors"))


@query(f"SELECT p_partkey, CASE WHEN tag IS NULL THEN 'Invalid tag: None' WHEN tag IN ('TE-300', 'TE-311') THEN 'Invalid tag: ' || tag END AS error FROM ({STRUCTURED})")
def field_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAF-11."""
    return structured(spark, sf_dir).select("p_partkey", safety.field_error(F.lit("alarm_tag"), F.col("tag")).alias("error"))
