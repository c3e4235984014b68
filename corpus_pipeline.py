"""A corpus pipeline: five stages, each written and read again before the next.

Documents that are predicted toxic go; later occurrences of repeated three-line windows are cut; one document of
each near-duplicate group stays; documents that hold a benchmark item go; the rest is mixed to target weights.
In every stage a row is judged by its own text, also where rows share an id; null texts stay, as texts without
words are copies of each other only; ties go to the smaller id; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, linedup, mixing, nearcopies, toxicity
from faultline.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic, as they came; rows without an id stay."""
    return toxicity.keep_civil(docs.select(*COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with repeated passages cut from its text and ``n_chars`` counted anew where lines went."""
    cut = linedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies: Jaccard similarity 0.8 or more on five-word shingles.

    Rows without an id stay, and so do equal rows of a kept id.
    """
    return nearcopies.keep_one_per_group(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; rows without an id stay."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each row, and its source's target, beside the row's text and language.

    Every row is a document of its own, also if its id is null or repeats; a null source is one more source.
    """
    return mixing.mix(docs.select("doc_id", "source", "lang", "text"), keep=("lang", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot express the nearest examples, hashes and index searches of the stages; tests compare plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
