"""Line dedup by overlapping three-line windows; DataFrame operations only.

Every window of ``WINDOW`` consecutive lines is hashed; a window that occurs more than once in the corpus keeps
its first occurrence (by document id, null first, then MD5 of the text, then line) and is removed everywhere else.
Covered positions of a document are merged, so overlapping windows remove each line once.  A document is its id
and its text: rows that repeat an id, or have none, with other texts are other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, mark, at, key)``: the MD5 of the text, a 128-bit hash of each window, ``at`` the index (from 0) of its first line.

    Windows of blank lines only are left out.  Lines are hashed once; a window hashes its lines' hashes.
    """
    rows = docs.select("doc_id", _mark(F.col("text")).alias("mark"), F.transform(_lines(F.col("text")), lambda x: F.struct(F.md5(x).alias("h"), (F.trim(x) == "").alias("blank"))).alias("lines"))
    rows = rows.filter(F.size("lines") >= window)
    starts = F.transform(
        F.sequence(F.lit(0), F.size("lines") - window),
        lambda i: F.struct(
            i.alias("at"),
            F.concat(*(F.get("lines", i + k)["h"] for k in range(window))).alias("joined"),
            *[F.forall(F.slice("lines", i + 1, window), lambda x: x["blank"]).alias("blank")],
        ),
    )
    met = rows.select("doc_id", "mark", F.inline(starts)).filter("not blank")
    return met.select("doc_id", "mark", "at", F.unhex(F.md5(F.col("joined").cast("binary"))).alias("key"))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(__id, __mark, __gone)``: the sorted distinct line numbers (from 0) that go, for documents that lose any."""
    met = stash(windows(docs, window), "linedup-windows")
    first = met.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    own = F.col("doc_id").eqNullSafe(F.col("first")["doc_id"]) & (F.col("mark") == F.col("first")["mark"]) & (F.col("at") == F.col("first")["at"])
    later = met.join(first, "key").filter(~own)
    starts = later.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("at").alias("starts"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + window - 1)))))
    return starts.select("__id", "__mark", lines.alias("__gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs``, with ``text`` cut, plus ``n_lines`` and ``n_removed``.

    Every occurrence of a window but the corpus-first one loses its lines; the rest keeps its order, joined by
    ``\\n``.  A null text stays null (0 lines); texts with fewer lines than a window stay as they are; a document
    whose lines all go has an empty text.  Rows that are equal in id and text share a fate: they count as one
    document, and the same lines go in each; rows that share an id only do not touch each other.  Whole texts count,
    of any length.  Input columns that clash with the two counts are replaced; no rows give no rows.
    """
    # lines are told from their places alone, so that the texts are shuffled once, beside a short list each
    gone = covered(docs.select("doc_id", "text"), window)
    base = docs.drop("n_lines", "n_removed", "__id", "__mark", "__gone")
    # the input text gets a name of its own: inside a lambda, the output's name would win
    names, base = base.columns, base.withColumnRenamed("text", "__text")
    # hashing the short lists leaves the texts unsorted
    met = base.join(gone.hint("shuffle_hash"), base["doc_id"].eqNullSafe(gone["__id"]) & (_mark(base["__text"]) == gone["__mark"]), "left")
    lines = _lines(F.col("__text"))
    hit = F.filter("__gone", lambda i: i < F.size(lines))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept)
    n_lines = F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.coalesce(F.size(hit), F.lit(0)).cast("long")
    n_removed = F.when(F.col("__gone").isNull() | F.col("__text").isNull(), F.lit(0)).otherwise(n_removed).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(c) for c in names]
    return met.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
