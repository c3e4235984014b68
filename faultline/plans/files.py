"""Queries of sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recurrences as rec
from ..session import table
from ..sources import readers, writers
from .registry import query


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in local mode without one, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def one_per_file(df: DataFrame, path: str) -> str:
    """Writes a column of texts, one file each."""
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def jsonl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: JSON lines, as many files as partitions."""
    rows, path = table(spark, sf_dir, "documents"), fresh_path(spark, "jsonl")
    writers.jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, role, md5(text) AS digest, 1::BIGINT AS files FROM conversations")
def jsonl_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: JSON lines in a given number of files."""
    rows, path = table(spark, sf_dir, "conversations"), fresh_path(spark, "jsonl")
    writers.jsonl(rows, path, files=1)
    back = spark.read.schema(rows.schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    files = back.agg(F.count_distinct("file").alias("files"))
    return back.crossJoin(F.broadcast(files)).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "files")  # one row of files


@query("SELECT md5(html || chr(10)) AS digest FROM pages")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01: a text per file."""
    path = one_per_file(table(spark, sf_dir, "pages").select("html"), fresh_path(spark, "texts"))
    return readers.markdown(spark, path).select(F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT md5(replace(html, '<', '[') || chr(10)) AS digest FROM pages")
def converted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: files of other formats through a converter hook."""
    path = one_per_file(table(spark, sf_dir, "pages").select("html"), fresh_path(spark, "office"))
    return readers.office(spark, path, lambda content, _: content.decode().replace("<", "["), "*.txt").select(F.md5(F.col("text").cast("binary")).alias("digest"))


FAILURES = (
    "cast(s_suppkey as string) AS id", "concat('N', s_nationkey) AS system", "s_name AS tag", "concat('FM', s_suppkey % 5) AS failure_mode", "'effect' AS effect", "concat('RC', s_suppkey % 7) AS cause",
    "'control' AS controls", "cast(s_suppkey % 10 + 1 as int) AS severity", "cast(s_suppkey % 4 + 1 as int) AS occurrence", "cast(s_suppkey % 6 + 1 as int) AS detection",
    "cast((s_suppkey % 10 + 1) * (s_suppkey % 4 + 1) * (s_suppkey % 6 + 1) as int) AS rpn", "concat('MT', s_nationkey % 3) AS recommended_action",
)


@query(f"SELECT id, system, tag, failure_mode, severity, occurrence, detection, rpn, cause AS root_cause, recommended_action AS mitigation FROM (SELECT {', '.join(FAILURES)} FROM supplier)")
def failure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: files that hold a JSON array of failure modes, a thousand each, with both names of cause and action."""
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey div 1000 AS file", *FAILURES)
    names = [c for c in rows.columns if c != "file"]
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*names))).alias("value")).select("value")
    out = readers.failure_table(spark, one_per_file(arrays, fresh_path(spark, "failures")))
    return out.select("id", "system", "tag", "failure_mode", "severity", "occurrence", "detection", "rpn", "root_cause", "mitigation")


@query("SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id")
def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05: a saved table of states, the latest of each key."""
    path = fresh_path(spark, "states")
    writers.state_table(table(spark, sf_dir, "conversations"), path, "conv_id", "turn")
    return spark.read.parquet(path).select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))


LEVELS = tuple((q, r, p) for q in (1e-5, 0.0, -1.0) for r in (1e-3, 0.0, -0.5) for p in (1.0, 0.0))


@query(f"SELECT q::DOUBLE AS q, r::DOUBLE AS r, p::DOUBLE AS p, q > 0 AND r > 0 AND p > 0 AS accepted FROM (VALUES {', '.join(map(str, LEVELS))}) t(q, r, p)")
def noise_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: which noise levels a filter accepts."""

    def accepted(q: float, r: float, p: float) -> bool:
        try:
            return bool(rec.kalman(q, r, p).outputs)
        except ValueError:
            return False

    return spark.createDataFrame([(*x, accepted(*x)) for x in LEVELS], "q double, r double, p double, accepted boolean")
