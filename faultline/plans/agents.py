"""Queries of the alarm-to-report pipeline and of advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import agent
from ..session import table
from .registry import query

PREFIXES = ("TE", "PT", "FT", "FV", "LT", "XX")
AT = "2024-01-01 00:00:00"


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as alarms; tags by user, feedback on every fourth."""
    tag = F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("user_id") % 6 + 1).cast("int")), F.lit("-"), (F.lit(301) + F.col("user_id") % 3).cast("string"))
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    feedback = F.when(F.col("event_id") % 4 == 0, "wrong cause").otherwise("")
    none = F.array().cast("array<struct<role: string, content: string>>")
    return rows.select(F.col("event_id").alias("alarm_id"), tag.alias("tag"), F.round("value", 1).alias("value"), F.lit("PLC").alias("source"), feedback.alias("engineer_feedback"), none.alias("history"))


ALARMS = f"SELECT event_id AS alarm_id, ['TE', 'PT', 'FT', 'FV', 'LT', 'XX'][(user_id % 6 + 1)::INT] || '-' || (301 + user_id % 3) AS tag, event_id % 4 = 0 AS fed FROM events WHERE event_type = 'error'"
VALUES = ", ".join(f"('{p}', {k}, '{m}', {s}, {c}, '{i}')" for k, (p, m, s, _o, _d, _r, c, _w, _a, i) in enumerate(fixed.FAILURE_BASE))
TRIPLES = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in fixed.TOPOLOGY)
MATCHED = f"WITH a AS ({ALARMS}), b(prefix, k, mode, sev, conf, sid) AS (VALUES {VALUES}), m AS (SELECT a.*, b.mode, b.sev, b.conf::DOUBLE AS conf, b.sid, b.k FROM a LEFT JOIN b ON b.prefix = left(a.tag, 2))"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.resolve(alarms(spark, sf_dir), agent.failure_base(spark), agent.topology(spark))


@query(
    f"""WITH a AS ({ALARMS}), t(s, p, o) AS (VALUES {TRIPLES}), u AS (SELECT DISTINCT tag FROM a)
SELECT a.alarm_id, coalesce((SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM t WHERE contains(o, a.tag)), '') AS upstream, coalesce((SELECT string_agg(DISTINCT o, ',' ORDER BY o) FROM t WHERE contains(s, a.tag)), '') AS downstream FROM a"""
)
def topology_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-02."""
    out = agent.neighbours(alarms(spark, sf_dir), agent.topology(spark), "tag")
    return out.select("alarm_id", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query(f"{MATCHED} SELECT alarm_id, string_agg(coalesce(mode, 'unknown'), ',' ORDER BY k) AS modes FROM m GROUP BY alarm_id")
def resolve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGT-01, JOI-01, SRC-06."""
    out = resolved(spark, sf_dir)
    return out.select("alarm_id", F.array_join(F.transform("matched", lambda m: m["failure_mode"]), ",").alias("modes"))


@query(f"{MATCHED} SELECT alarm_id, coalesce(string_agg(mode, ',' ORDER BY conf * sev DESC, k) FILTER (conf >= 0.6), '') AS modes, coalesce(max(conf) FILTER (conf >= 0.6), 0)::DOUBLE AS confidence, coalesce(string_agg(sid, ',' ORDER BY conf * sev DESC, k) FILTER (conf >= 0.6), '') AS sources FROM m GROUP BY alarm_id")
def reason_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGT-02, AGG-07."""
    out = agent.reason(resolved(spark, sf_dir))
    return out.select("alarm_id", F.array_join(F.transform("matched", lambda m: m["failure_mode"]), ",").alias("modes"), "confidence", F.array_join("citation_sources", ",").alias("sources"))


@query(
    f"""{MATCHED} SELECT alarm_id, any_value(tag) AS tag, CASE WHEN any_value(mode) IS NULL THEN 'fallback' WHEN any_value(fed) THEN 'reflect' ELSE 'end' END AS route, any_value(mode) IS NULL AS manual, count(mode) AS entries,
  CASE WHEN any_value(mode) IS NOT NULL AND any_value(fed) THEN 1 ELSE 0 END AS said FROM m GROUP BY alarm_id"""
)
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGT-03 to AGT-07: from alarm to routed report."""
    out = agent.diagnose(alarms(spark, sf_dir), agent.failure_base(spark), agent.topology(spark), F.lit(AT))
    r = F.col("report")
    return out.select("alarm_id", r["alarm_tag"].alias("tag"), "route", r["requires_manual_inspection"].alias("manual"), F.size(r["matched_fmea"]).cast("long").alias("entries"), F.size("history").alias("said"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ENTRIES = ", ".join(f"('{p}', {k}, '{m}', {s}, {o}, {d}, {r}, {c}::DOUBLE, {quoted(w)}, {quoted(a)})" for k, (p, m, s, o, d, r, c, w, a, _i) in enumerate(fixed.FAILURE_BASE))


@query(
    f"""WITH a AS (SELECT event_id AS alarm_id, ['TE', 'PT', 'FT', 'FV', 'LT', 'XX'][(user_id % 6 + 1)::INT] || '-' || (301 + user_id % 3) AS tag, round(value, 1) AS value FROM events WHERE event_type = 'error'),
b(prefix, k, mode, s, o, d, rpn, conf, cause, act) AS (VALUES {ENTRIES}),
m AS (SELECT a.alarm_id, a.tag, a.value, b.*, row_number() OVER (PARTITION BY alarm_id ORDER BY conf * s DESC, k) AS r FROM a LEFT JOIN b ON b.prefix = left(a.tag, 2) AND conf >= 0.6),
t AS (SELECT alarm_id, any_value(tag) AS tag, any_value(value) AS value, count(mode) AS n, coalesce(max(conf), 0) AS conf, arg_min(mode, r) AS top, arg_min(conf, r) AS top_conf,
  string_agg(printf('  [%d] %s (S=%d, O=%d, D=%d, RPN=%d, conf=%.2f)', r, mode, s, o, d, rpn, conf), chr(10) ORDER BY r) AS lines,
  coalesce(string_agg(concat_ws('/', mode, s, o, d, rpn, conf, cause, act), '|' ORDER BY r), '') AS matched FROM m GROUP BY alarm_id)
SELECT alarm_id, tag, matched, n = 0 AS manual,
  CASE WHEN n = 0 THEN printf({quoted(fixed.FALLBACK_SUMMARY)}, '{AT}', tag, conf, n, tag)
    ELSE concat_ws(chr(10), 'FMEA Diagnostic Report — {AT}', printf('Trigger: %s (value: %s)', tag, value::VARCHAR), printf('Matches found: %d', n), printf('Overall confidence: %.2f', conf), lines) END AS summary,
  concat_ws(' | ', printf('Last alarm: %s=%s', tag, value::VARCHAR), CASE WHEN n > 0 THEN printf('Top FMEA: %s (conf=%.2f)', top, top_conf) END, CASE WHEN n > 0 THEN printf('Confidence: %.2f', conf) END, CASE WHEN n = 0 THEN '⚠ Fallback triggered' END) AS digest
FROM t"""
)
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGT-03, AGT-04, TXT-18: reports with their summaries and digests as text."""
    out = agent.state_digests(agent.diagnose(alarms(spark, sf_dir), agent.failure_base(spark), agent.topology(spark), F.lit(AT)))
    r = F.col("report")
    entry = lambda m: F.concat_ws("/", *(m[n].cast("string") for n in ("failure_mode", "severity", "occurrence", "detection", "rpn", "confidence", "cause", "recommended_action")))
    matched = F.array_join(F.transform(r["matched_fmea"], entry), "|")
    return out.select("alarm_id", r["alarm_tag"].alias("tag"), matched.alias("matched"), r["requires_manual_inspection"].alias("manual"), r["diagnostic_summary"].alias("summary"), "digest")


@query(
    """WITH h AS (SELECT doc_id % 50 AS k, doc_id, lang AS hypothesis, round(n_chars % 100 / 100.0::DOUBLE, 2) AS c FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, doc_id) AS r FROM h),
t AS (SELECT k, least(count(*), 3) AS n, max(CASE WHEN r = 1 THEN c END) AS c1, max(CASE WHEN r = 2 THEN c END) AS c2 FROM r GROUP BY k)
SELECT k, n::INT AS n, c1 >= 0.6 AS primary_over, 1 + CASE WHEN c1 - c2 < 0.15 THEN 1 ELSE 0 END AS recommendations FROM t"""
)
def advice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL-06."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), F.col("lang").alias("hypothesis"), F.round(F.col("n_chars") % 100 / 100.0, 2).alias("confidence"), F.lit(None).cast("string").alias("fmea_action"), F.col("doc_id").alias("place"))
    out = agent.advise(rows, "k")
    return out.select("k", (F.size(F.split("summary", "\n")) - 1).alias("n"), F.get("recommendations", F.lit(0)).startswith("Primary").alias("primary_over"), F.size("recommendations").alias("recommendations"))
