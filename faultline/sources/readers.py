"""Readers (SRC): documents, failure-mode tables, event streams and fixed dimension tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

FAILURE_ROWS = "id string, system string, tag string, failure_mode string, effect string, cause string, controls string, severity int, occurrence int, detection int, rpn int, recommended_action string"
#: Names that failure-mode tables use for the same thing.
ALIASES = {"cause": "root_cause", "recommended_action": "mitigation"}
EVENTS = "source string, ntp_ns long, payload string"
SOURCES = "source string, delay_ns long, priority int"
REPORT = (
    "alarm_tag string, matched_fmea array<struct<failure_mode: string, severity: int, occurrence: int, detection: int, rpn: int, confidence: double, cause: string, recommended_action: string>>, "
    "diagnostic_summary string, requires_manual_inspection boolean, citation_sources array<string>"
)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01, SRC-02: ``path, text`` of Markdown or text files, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def office(spark: SparkSession, path: str, convert: Callable[[bytes, str], str], glob: str = "*") -> DataFrame:
    """SRC-01, SRC-02: ``path, text`` of other files through a converter hook (bytes, path) -> Markdown."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [convert(c, p) for c, p in zip(pdf["content"], pdf["path"])]})

    return files.mapInPandas(run, "path string, text string")


def failure_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: a JSON array of failure modes, with both names of cause and action."""
    rows = spark.read.schema(FAILURE_ROWS).json(path, multiLine=True)
    return rows.withColumns({new: F.col(old) for old, new in ALIASES.items()})


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, **options: str) -> DataFrame:
    """SRC-04: events as a stream of JSON files."""
    return spark.readStream.schema(schema).options(**options).json(path)


def asset_tags(spark: SparkSession) -> DataFrame:
    """SRC-06: ``kind, name`` of the asset dictionary."""
    rows = [("tag", n) for n in fixed.TAGS] + [("system", n) for n in fixed.SYSTEMS] + [("failure_mode", n) for n in fixed.FAILURE_MODES]
    return spark.createDataFrame(rows, "kind string, name string")


def intent_keywords(spark: SparkSession) -> DataFrame:
    """SRC-06: ``intent, keyword``."""
    return spark.createDataFrame([(i, k) for i, ks in fixed.INTENTS.items() for k in ks], "intent string, keyword string")


def refusal_examples(spark: SparkSession) -> DataFrame:
    """SRC-06: the worked refusal examples."""
    return spark.createDataFrame(list(fixed.REFUSAL_EXAMPLES), "context string, query string, good_response string, bad_response string")


def unknown_assets(rows: DataFrame, kind: str, column: str, spark: SparkSession) -> DataFrame:
    """Data-quality rows: names in ``column`` that the asset dictionary lacks."""
    known = asset_tags(spark).filter(F.col("kind") == kind).select(F.col("name").alias(column))
    return rows.select(column).distinct().join(F.broadcast(known), column, "left_anti")  # the dictionary is fixed
