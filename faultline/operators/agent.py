"""From alarm to report as one plan: context, reasoning, report, fallback, routing, advice (AGT, JOI-01/02, RL-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.sizes import small_side
from . import text as tx

MIN_CONFIDENCE = 0.6
BASE = "prefix string, failure_mode string, severity int, occurrence int, detection int, rpn int, confidence double, cause string, recommended_action string, source_id string"
ENTRY = ("failure_mode", "severity", "occurrence", "detection", "rpn", "confidence", "cause", "recommended_action", "source_id")


def failure_base(spark: SparkSession) -> DataFrame:
    """SRC-06: the failure-mode entries by tag prefix, in order (``place``)."""
    rows = [(*r, k) for k, r in enumerate(fixed.FAILURE_BASE)]
    return spark.createDataFrame(rows, f"{BASE}, place int")


def topology(spark: SparkSession) -> DataFrame:
    """SRC-06: the topology triples, in order (``place``)."""
    return spark.createDataFrame([(*t, k) for k, t in enumerate(fixed.TOPOLOGY)], "subject string, predicate string, object string, place int")


def neighbours(alarms: DataFrame, triples: DataFrame, tag: str, compat: bool = False) -> DataFrame:
    """JOI-02: adds sorted ``upstream`` and ``downstream`` equipment.

    A tag matches ends that contain it, as it is or with underscores; ``compat`` tries underscores only.  Tags
    are made distinct first, so the substring join is between two small sets.
    """
    tags = alarms.select(F.col(tag).alias("__tag")).distinct()
    soft = F.replace("__tag", F.lit("-"), F.lit("_"))
    inside = lambda end: F.contains(end, soft) if compat else F.contains(end, soft) | F.contains(end, F.col("__tag"))
    met = tags.join(small_side(triples), inside(F.col("subject")) | inside(F.col("object")))
    sides = met.groupBy("__tag").agg(
        F.array_sort(F.collect_set(F.when(inside(F.col("object")), F.col("subject")))).alias("upstream"),
        F.array_sort(F.collect_set(F.when(inside(F.col("subject")), F.col("object")))).alias("downstream"),
    )
    out = alarms.join(sides, alarms[tag] == sides["__tag"], "left").drop("__tag")
    none = F.array().cast("array<string>")
    return out.withColumn("upstream", F.coalesce("upstream", none)).withColumn("downstream", F.coalesce("downstream", none))


def resolve(alarms: DataFrame, base: DataFrame, triples: DataFrame) -> DataFrame:
    """AGT-01, JOI-01: adds ``matched`` (entries of the tag's prefix, in order) and ``device_context``.

    ``alarms(alarm_id, tag, value, source)``; a prefix without entries gets the unknown entry.
    """
    unknown = F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in zip(ENTRY, fixed.UNKNOWN_FAILURE, ("string", "int", "int", "int", "int", "double", "string", "string", "string"))))
    packed = base.groupBy("prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*ENTRY).alias("e")))), lambda x: x["e"]).alias("matched"))
    out = neighbours(alarms, triples, "tag")
    out = out.join(small_side(packed), F.substring("tag", 1, 2) == F.col("prefix"), "left").drop("prefix")
    out = out.withColumn("matched", F.coalesce("matched", F.array(unknown)))
    part = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{head}: "), F.array_join(xs, ", ")))
    context = F.concat_ws(
        "\n", F.concat(F.lit("Alarm source: "), F.coalesce("source", F.lit("UNKNOWN"))), F.concat(F.lit("Triggering tag: "), F.coalesce("tag", F.lit("UNKNOWN"))),
        F.concat(F.lit("Current value: "), F.coalesce(F.col("value").cast("string"), F.lit("N/A"))), part("Upstream", "upstream"), part("Downstream", "downstream"),
        F.concat(F.lit("\nFMEA matches retrieved: "), F.size("matched").cast("string")),
    )
    return out.withColumn("device_context", context)


def reason(states: DataFrame) -> DataFrame:
    """AGT-02, AGG-07: keeps confident matches, most confident times severe first (stable); adds ``confidence, citation_sources``."""
    conf = lambda m: F.coalesce(m["confidence"], F.lit(0.0))
    numbered = F.transform("matched", lambda m, i: F.struct((-conf(m) * F.coalesce(m["severity"], F.lit(1))).alias("by"), i.alias("i"), m.alias("m")))
    ranked = F.transform(F.array_sort(F.filter(numbered, lambda x: conf(x["m"]) >= MIN_CONFIDENCE)), lambda x: x["m"])
    out = states.withColumn("matched", ranked)
    best = F.coalesce(F.array_max(F.transform("matched", lambda m: m["confidence"])), F.lit(0.0))
    sources = F.filter(F.transform("matched", lambda m: m["source_id"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return out.withColumn("confidence", best).withColumn("citation_sources", sources)


def entries(matched: Column) -> Column:
    """The eight fields of report entries, with their defaults."""
    d = {"failure_mode": "unknown", "severity": 0, "occurrence": 1, "detection": 1, "rpn": 0, "confidence": 0.0, "cause": "", "recommended_action": ""}
    return F.transform(matched, lambda m: F.struct(*(F.coalesce(m[n], F.lit(v)).alias(n) for n, v in d.items())))


def report(states: DataFrame, at: Column) -> DataFrame:
    """AGT-03: adds ``requires_fallback`` and ``report``; ``at`` is the time printed in the summary."""
    out = states.withColumn("__entries", entries(F.col("matched")))
    fallback = (F.col("confidence") < MIN_CONFIDENCE) | (F.size("__entries") == 0)
    line = lambda e, i: F.format_string("  [%d] %s (S=%d, O=%d, D=%d, RPN=%d, conf=%.2f)", i + 1, e["failure_mode"], e["severity"], e["occurrence"], e["detection"], e["rpn"], e["confidence"])
    summary = F.concat_ws(
        "\n", F.concat(F.lit("FMEA Diagnostic Report — "), at), F.format_string("Trigger: %s (value: %s)", F.col("tag"), F.coalesce(F.col("value").cast("string"), F.lit("N/A"))),
        F.format_string("Matches found: %d", F.size("__entries")), F.format_string("Overall confidence: %.2f", F.col("confidence")),
        F.when(fallback, F.lit(fixed.LOW_CONFIDENCE_LINE)), F.when(F.size("__entries") > 0, F.array_join(F.transform("__entries", line), "\n")),
    )
    made = F.struct(F.col("tag").alias("alarm_tag"), F.col("__entries").alias("matched_fmea"), summary.alias("diagnostic_summary"), fallback.alias("requires_manual_inspection"), "citation_sources")
    return out.withColumn("requires_fallback", fallback).withColumn("report", made).drop("__entries")


def fall_back(states: DataFrame, at: Column) -> DataFrame:
    """AGT-04: replaces ``report`` by the safe one."""
    summary = F.format_string(fixed.FALLBACK_SUMMARY, at, F.col("tag"), F.col("confidence"), F.size("matched"), F.col("tag"))
    none = F.filter(F.col("report")["matched_fmea"], lambda m: F.lit(False))
    made = F.struct(F.col("tag").alias("alarm_tag"), none.alias("matched_fmea"), summary.alias("diagnostic_summary"), F.lit(True).alias("requires_manual_inspection"), F.array().cast("array<string>").alias("citation_sources"))
    return states.withColumn("report", made).withColumn("requires_fallback", F.lit(True))


def route(fallback: Column, feedback: Column) -> Column:
    """AGT-06: where a state goes after its report; after reflection the way always ends."""
    return F.when(F.coalesce(fallback, F.lit(False)), "fallback").when(F.coalesce(feedback, F.lit("")) != "", "reflect").otherwise("end")


def reflect(states: DataFrame) -> DataFrame:
    """AGT-05: feedback moves to the end of ``history``; without feedback nothing changes."""
    given = F.coalesce("engineer_feedback", F.lit("")) != ""
    said = F.struct(F.lit("engineer").alias("role"), F.col("engineer_feedback").alias("content"))
    history = F.coalesce("history", F.array().cast("array<struct<role: string, content: string>>"))
    out = states.withColumn("history", F.when(given, F.array_append(history, said)).otherwise(history))
    return out.withColumn("engineer_feedback", F.when(given, F.lit("")).otherwise(F.col("engineer_feedback")))


def diagnose(alarms: DataFrame, base: DataFrame, triples: DataFrame, at: Column) -> DataFrame:
    """AGT-07: alarms ``(alarm_id, tag, value, source, engineer_feedback, history)`` to routed reports.

    Narrow but for the small joins: all alarms advance through the five steps in one job.
    """
    states = report(reason(resolve(alarms, base, triples)), at)
    states = states.withColumn("route", route(F.col("requires_fallback"), F.col("engineer_feedback")))
    low = fall_back(states.filter("route = 'fallback'"), at)
    return states.filter("route <> 'fallback'").transform(reflect).unionByName(low)


def advise(hypotheses: DataFrame, key: str, top: int = 3, threshold: float = 0.6, close: float = 0.15) -> DataFrame:
    """RL-06: ``key, summary, recommendations, disambiguation_action`` from ``(key, hypothesis, confidence, fmea_action, place)``.

    The best ``top`` per key by confidence, ties in ``place``.
    """
    order = Window.partitionBy(key).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "place")
    best = hypotheses.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top)
    per = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__r", "hypothesis", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("fmea_action", F.lit("manual inspection")).alias("action")))).alias("h"))
    line = lambda x: F.format_string("  [%d] %s (confidence: %.2f)", x["__r"], x["hypothesis"], x["confidence"])
    summary = F.concat(F.format_string("Counterfactual analysis — %d hypotheses ranked:\n", F.size("h")), F.array_join(F.transform("h", line), "\n"))
    one, two = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    first = F.when(one["confidence"] >= threshold, F.format_string("Primary hypothesis '%s' exceeds confidence threshold.  Recommend executing associated FMEA action: %s.", one["hypothesis"], one["action"])).otherwise(
        "No hypothesis exceeds confidence threshold.  Recommend additional sensor data collection before action."
    )
    gap = one["confidence"] - two["confidence"]
    second = F.when(gap < close, F.format_string("Hypotheses '%s' and '%s' are close in confidence (gap=%.2f).  Suggested disambiguation: dispatch technician for on-site inspection of associated equipment within 2 hours.", one["hypothesis"], two["hypothesis"], gap))
    out = per.withColumn("summary", summary).withColumn("recommendations", F.filter(F.array(first, second), lambda r: r.isNotNull()))
    return out.select(key, "summary", "recommendations", F.element_at("recommendations", -1).alias("disambiguation_action"))


def state_digests(states: DataFrame) -> DataFrame:
    """TXT-18 over agent states: adds ``digest``."""
    top = F.get("matched", F.lit(0))
    return states.withColumn("digest", tx.state_digest(F.col("tag"), F.col("value"), top["failure_mode"], top["confidence"], F.col("confidence"), F.col("requires_fallback")))
