"""Shared plumbing of the training-data operators: shared-folder tables, tokenisation, Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the query contracts define it: a run of anything but ASCII blanks (Java and DuckDB syntax).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is taken in local mode (one machine, as in tests); on a cluster that
    is an error, because executors could not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the jobs run inside: texts pass to Python without large buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are deleted as each query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash_texts(df: DataFrame, label: str) -> DataFrame:
    """:func:`stash` for frames that send whole texts to Python."""
    with small_batches(df.sparkSession):
        return stash(df, label)


def stash(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete the files of a stash that no later plan reads."""
    spark = df.sparkSession
    jvm, files = spark._jvm, df.inputFiles()
    for folder in {name.rsplit("/", 1)[0] for name in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have ``rows`` or fewer, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text) -> F.Column:
    """A 64-bit hash of a text column, null as empty: with the id, it tells rows that repeat an id from each other."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are not among ``gone(doc_id, key)``, all columns; null ids stay."""
    out = gone.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct()
    return docs.join(out, (docs["doc_id"] == out["__gone"]) & (text_key(docs["text"]) == out["__key"]), "left_anti")


def words_of(text: str | None) -> list[bytes]:
    """Words of the contracts: A-Z lower-cased, split at ASCII blanks (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text_column) -> F.Column:
    """Number of words of a text column, 0 for null; native."""
    return F.coalesce(F.regexp_count(text_column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice at a time, so that long texts do not pile up as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            yield from zip(*(piece.column(name).to_pylist() for name in columns), strict=True)
