"""Hard rules, guardrails and report validation (SAF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Extents of the rule table: device types, sensors, severities.
EXTENTS = (50, 2000, 5)
PHYSICAL_IMPOSSIBLE = 4
RULES = "rule_seq long, device_type int, sensor_id int, severity int, allow boolean"
#: Rules up to which the table is broadcast.
SMALL_RULES = 500_000


def check_indexes(df: DataFrame) -> DataFrame:
    """SAF-08: fails on rules outside the extents (null is a wildcard)."""
    bad = reduce(lambda a, b: a | b, (F.col(c).isNotNull() & ((F.col(c) < 0) | (F.col(c) >= n)) for c, n in zip(("device_type", "sensor_id", "severity"), EXTENTS)))
    fine = F.when(bad, F.raise_error(F.lit("rule outside the table")).cast("long")).otherwise(F.col("rule_seq"))
    return df.withColumn("rule_seq", fine)


def block_below(spark, threshold: int, seq: int) -> DataFrame:
    """SAF-03: rules that block every severity under ``threshold``."""
    rows = [(seq + k, None, None, k, False) for k in range(min(threshold, EXTENTS[2]))]
    return spark.createDataFrame(rows, RULES)


def from_bounds(bounds: DataFrame, seq: int = 0) -> DataFrame:
    """SAF-06: block rules from ``(name, device_type, sensor_id, devices)``, flat or nested.

    ``devices`` maps a device type to sensor ids; a row with both fields of the flat form uses those.  Rules are numbered by the
    order of the rows' contents, not by where the rows lie; as all of them block, their order among each other has no effect.
    """
    flat = bounds.filter("device_type is not null and sensor_id is not null").select("name", "device_type", "sensor_id")
    nested = bounds.filter("(device_type is null or sensor_id is null) and devices is not null")
    nested = nested.select("name", F.explode("devices").alias("d", "ids")).select("name", F.col("d").cast("int").alias("device_type"), F.explode("ids").alias("sensor_id"))
    every = flat.union(nested)
    every = every.withColumn("rule_seq", F.row_number().over(Window.orderBy("name", "device_type", "sensor_id")).cast("long") - 1 + seq)  # a table of settings, of the size of SMALL_RULES
    return every.select("rule_seq", "device_type", "sensor_id", F.lit(PHYSICAL_IMPOSSIBLE).alias("severity"), F.lit(False).alias("allow"))


def from_allowlist(entries: DataFrame, seq: int = 0) -> DataFrame:
    """SAF-06: allow rules from ``(device_type, sensor_id, severities)``; severity 0 where none is given.  Numbered by contents."""
    each = entries.select("device_type", "sensor_id", F.explode(F.coalesce("severities", F.array(F.lit(0)))).alias("severity"))
    each = each.withColumn("rule_seq", F.row_number().over(Window.orderBy("device_type", "sensor_id", "severity")).cast("long") - 1 + seq)  # a table of settings, of the size of SMALL_RULES
    return each.select("rule_seq", "device_type", "sensor_id", F.col("severity").cast("int").alias("severity"), F.lit(True).alias("allow"))


def effective(rules: DataFrame) -> DataFrame:
    """The last rule of each pattern, where null matches anything."""
    return rules.groupBy("device_type", "sensor_id", "severity").agg(F.max("rule_seq").alias("rule_seq"), F.max_by("allow", "rule_seq").alias("allow"))


def guard(events: DataFrame, rules: DataFrame, default: bool = True) -> DataFrame:
    """SAF-03 to SAF-05, JOI-05: adds ``allowed`` and ``route``; the last matching rule wins.

    Wildcards make eight kinds of patterns at most; each kind is an equi-join on the columns it names.  A read
    outside the table takes the default; a severity of 0 or less passes without a model.
    """
    rules = effective(rules)
    sized = rules.limit(SMALL_RULES + 1).count() <= SMALL_RULES
    names, found, out = ("device_type", "sensor_id", "severity"), [], events
    kinds = {tuple(r) for r in rules.select(*(F.col(c).isNotNull() for c in names)).distinct().collect()}
    for k, kind in enumerate(sorted(kinds)):
        used = [c for c, on in zip(names, kind) if on]
        shape = reduce(lambda a, b: a & b, (F.col(c).isNotNull() if on else F.col(c).isNull() for c, on in zip(names, kind)))
        part = rules.filter(shape).select(*used, F.struct("rule_seq", "allow").alias(f"__hit{k}"))
        if used:
            out = out.join(F.broadcast(part) if sized else part, used, "left")
        else:
            row = part.first()[0]
            out = out.withColumn(f"__hit{k}", F.struct(F.lit(row[0]).alias("rule_seq"), F.lit(row[1]).alias("allow")))
        found.append(F.col(f"__hit{k}"))
    inside = reduce(lambda a, b: a & b, (F.col(c).between(0, n - 1) for c, n in zip(names, EXTENTS)))
    last = F.array_max(F.filter(F.array(*found), lambda h: h.isNotNull()))["allow"] if found else F.lit(None).cast("boolean")
    allowed = F.when(F.coalesce(inside, F.lit(False)), F.coalesce(last, F.lit(default))).otherwise(F.lit(default))
    route = F.when(~allowed, "block").when(F.col("severity") <= 0, "pass").otherwise("llm")
    return out.withColumn("allowed", allowed).withColumn("route", route).drop(*(f"__hit{k}" for k in range(len(found))))


def guard_counts(routed: DataFrame) -> DataFrame:
    """AGG-08: ``blocked, allowed, block_ratio``."""
    counts = routed.agg(F.count_if(~F.col("allowed")).alias("blocked"), F.count_if("allowed").alias("allowed"))
    total = F.col("blocked") + F.col("allowed")
    return counts.withColumn("block_ratio", F.when(total > 0, F.col("blocked") / total).otherwise(0.0))


def device_name(names: Column, device_type: Column) -> Column:
    """SAF-07: a registered name from a map, or ``Device-n``."""
    return F.coalesce(F.try_element_at(names, device_type), F.concat(F.lit("Device-"), device_type.cast("string")))


def sensor_tag(names: Column, sensor_id: Column) -> Column:
    """SAF-07: a registered tag from a map, or ``Sensor-n``."""
    return F.coalesce(F.try_element_at(names, sensor_id), F.concat(F.lit("Sensor-"), sensor_id.cast("string")))


#: Physical bounds of report fields: (column, name, low, high).
BOUNDS = (
    ("abundance_pct", "abundance", 0.0, 100.0),
    ("valve_opening_pct", "valve", 0.0, 100.0),
    ("temperature_c", "temperature", -273.15, 500.0),
    ("pressure_bar", "pressure", 0.0, 30.0),
)
MIN_CONFIDENCE = 0.6


def guardrail_failure(df: DataFrame) -> Column:
    """SAF-01: the first check that fails, in order, as its name; null if all pass.

    Fields that are null or have no column pass; a NaN fails the bounds but not the flow check; a match without
    confidence counts as 0.
    """
    has = lambda c: c in df.columns
    checks = [F.when(F.col(c).isNotNull() & ~((F.col(c) >= lo) & (F.col(c) <= hi)), F.lit(name)) for c, name, lo, hi in BOUNDS if has(c)]
    if has("flow_rate"):
        checks.append(F.when(F.col("flow_rate") < 0.0, F.lit("flow")))
    if has("matched_fmea"):
        low = F.exists("matched_fmea", lambda m: F.coalesce(m["confidence"].cast("double"), F.lit(0.0)) < MIN_CONFIDENCE)
        checks.append(F.when(low, F.lit("confidence")))
    if has("diagnostic_summary"):
        spoken = reduce(lambda a, b: a | b, (F.lower("diagnostic_summary").contains(p) for p in fixed.FORBIDDEN_PHRASES))
        checks.append(F.when(spoken, F.lit("language")))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def sanitized(df: DataFrame) -> DataFrame:
    """SAF-02: the bounded fields cut to their bounds; nulls stay."""
    cut = {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))) for c, _, lo, hi in BOUNDS if c in df.columns}
    return df.withColumns(cut)


def _known(value: Column, names: tuple[str, ...]) -> Column:
    return value.isin(*names)


def schema_errors(tag: Column, matches: Column, summary: Column) -> Column:
    """SAF-09: errors of a report, in order; empty if it is valid (then the report may be used as it is)."""
    top = [
        F.when(tag.isNull(), F.lit("Missing required field: alarm_tag")),
        F.when(matches.isNull(), F.lit("Missing required field: matched_fmea")),
        F.when(summary.isNull(), F.lit("Missing required field: diagnostic_summary")),
        F.when((tag != "") & ~_known(tag, fixed.TAGS), F.concat(F.lit("Invalid tag '"), tag, F.lit("'"))),
    ]

    def entry(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("matched_fmea["), i.cast("string"), F.lit("]: "))
        return F.array(
            F.when((m["failure_mode"] != "") & ~_known(m["failure_mode"], fixed.FAILURE_MODES), F.concat(at, F.lit("invalid failure_mode '"), m["failure_mode"], F.lit("'"))),
            F.when(~m["severity"].between(1, 10), F.concat(at, F.lit("severity "), m["severity"].cast("string"), F.lit(" out of [1,10]"))),
            F.when(~m["confidence"].between(0.0, 1.0), F.concat(at, F.lit("confidence out of [0,1]"))),
        )

    inner = F.flatten(F.transform(F.coalesce(matches, F.array().cast(matches_type())), entry))
    return F.filter(F.concat(F.array(*top), inner), lambda e: e.isNotNull())


def matches_type() -> str:
    """The type of ``matched_fmea``."""
    return "array<struct<failure_mode: string, severity: int, occurrence: int, detection: int, rpn: int, confidence: double, cause: string, recommended_action: string>>"


def model_errors(tag: Column, matches: Column, summary: Column) -> Column:
    """SAF-10: errors of the strict model, by field; empty if the report is valid."""
    top = [
        F.when(F.coalesce(tag, F.lit("")) == "", F.lit("alarm_tag: empty")).when(~_known(tag, fixed.TAGS), F.lit("alarm_tag: unknown")),
        F.when(F.coalesce(summary, F.lit("")) == "", F.lit("diagnostic_summary: empty")),
        F.when(matches.isNull(), F.lit("matched_fmea: missing")).when(F.size(matches) > 5, F.lit("matched_fmea: more than 5")),
    ]

    def entry(m: Column, i: Column) -> Column:
        name = lambda f: F.concat(F.lit("matched_fmea["), i.cast("string"), F.lit(f"].{f}"))
        whole = lambda c, hi: ~F.coalesce(c.between(1, hi), F.lit(False))
        o, d, rpn = (F.coalesce(m[c], F.lit(1)) for c in ("occurrence", "detection", "rpn"))
        return F.array(
            F.when(~F.coalesce(_known(m["failure_mode"], fixed.FAILURE_MODES), F.lit(False)), name("failure_mode")),
            F.when(whole(m["severity"], 10), name("severity")),
            F.when(whole(o, 10), name("occurrence")),
            F.when(whole(d, 10), name("detection")),
            F.when(whole(rpn, 1000) | (rpn != m["severity"] * o * d), name("rpn")),
            F.when(~F.coalesce(m["confidence"].between(0.0, 1.0), F.lit(False)), name("confidence")),
            F.when(F.coalesce(m["cause"], F.lit("")) == "", name("cause")),
        )

    inner = F.flatten(F.transform(F.coalesce(matches, F.array().cast(matches_type())), entry))
    return F.filter(F.concat(F.array(*top), inner), lambda e: e.isNotNull())


def field_error(field: Column, value: Column) -> Column:
    """SAF-11: the error of a single field, null if there is none."""
    return F.when((field == "alarm_tag") & ~F.coalesce(_known(value, fixed.TAGS), F.lit(False)), F.concat(F.lit("Invalid tag: "), F.coalesce(value, F.lit("None"))))
