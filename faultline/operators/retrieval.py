"""Keyword, vector and fused retrieval for many queries at once (RET, AGG-04, AGG-12, WIN-10, JOI-03, JOI-06)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_side
from .text import tokens

K1, B, TOP, RRF_K = 1.5, 0.75, 50, 60
#: Queries of a block that an exact vector search sends to its tasks at once, which bounds what it broadcasts.
QUERY_BLOCK = 10_000
#: Spaces of all kinds, which keyword search cuts from both ends of a text.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _trimmed(text: str) -> Column:
    return F.btrim(F.col(text), F.lit(SPACES))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """RET-01, TXT-09: ``key, term, tf, dl``: term counts and the length of each document; an id's texts of unlike lengths stay apart."""
    return _listed(docs, key, text, None)


def _listed(docs: DataFrame, key: str, text: str, words: DataFrame | None) -> DataFrame:
    """:func:`postings`, of some words only: the others go before they are counted."""
    split = docs.select(key, tokens(_trimmed(text)).alias("terms")).withColumn("dl", F.size("terms"))
    each = split.select(key, "dl", F.explode("terms").alias("term"))
    each = each.join(small_side(words), "term", "left_semi") if words is not None else each
    return each.groupBy(key, "term", "dl").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """AGG-12: one row ``n_docs, avgdl``; a null text is a document, but has no length."""
    return docs.select(F.regexp_count(_trimmed(text), F.lit(r"[^\t\n\f\r ]+")).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _exact_sum(part: Column) -> Column:
    """The sum of values from 0 to 2^30, in integer steps of 2^-64, so that it does not depend on the order of rows."""
    high = F.floor(part * 2.0**32)
    return F.sum(high) * 2.0**-32 + F.sum(F.floor((part * 2.0**32 - high) * 2.0**32)) * 2.0**-64


def _top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best per query, ties (to nine digits) to the smaller key, with a rank from 0 (WIN-10)."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank0", F.row_number().over(order) - 1).filter(F.col("rank0") < k)


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, k: int = TOP, k1: float = K1, b: float = B) -> DataFrame:
    """RET-02, AGG-04: Okapi BM25: ``query_id, key, score, rank0``, scores over the best of their query.

    ``queries(query_id, query)``; a word asked twice counts twice.  Only postings of words that are asked for
    are scored; negative weights of very common words are cut at 0; results with score 0 go.  Scores are exact sums, so
    that copies tie on every layout.
    """
    asked = queries.select("query_id", F.explode(tokens(_trimmed("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = asked.select("term").distinct()
    listed = _listed(docs, key, text, words)
    total, mean = corpus_stats(docs, text).first()
    df = listed.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(0.0), F.log((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean)))
    scored = listed.join(df, "term").join(asked, "term").groupBy("query_id", key).agg(_exact_sum(part).alias("score")).filter("score > 0")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return _top(scored, key, k).withColumn("score", F.col("score") / best).select("query_id", key, "score", "rank0")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = TOP) -> DataFrame:
    """RET-03: exact search by dot product of a stated query set ``(query_id, query_vector)``; scores over 0 only.

    Queries are packed in blocks of about ``QUERY_BLOCK``.  One block is broadcast, so a vector's row is not shuffled
    before it is scored; several are joined by their number, which every vector names.  The best ``k`` of each task are kept
    before the shuffle (a grouped limit).
    """
    count = -(-queries.count() // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, count))).cast("int")
    packed = queries.groupBy(block.alias("__block")).agg(F.collect_list(F.struct("query_id", "query_vector")).alias("qs"))
    named = vectors.select(key, F.col(vector).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1))).alias("__block"))
    met = named.join(F.broadcast(packed) if count <= 1 else packed, "__block")
    each = met.select(key, "__v", F.inline("qs"))
    scored = each.select("query_id", key, dot(F.col("__v"), F.col("query_vector")).alias("score")).filter("score > 0")
    return _top(scored, key, k).select("query_id", key, "score", "rank0")


def fuse(branches: Mapping[str, tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """RET-04, JOI-06: reciprocal rank fusion: ``query_id, key, score``, the sum of ``weight / (k + rank0 + 1)``."""
    parts = [df.select("query_id", key, (F.lit(w) / (F.lit(k) + F.col("rank0") + 1)).alias("part")) for df, w in branches.values()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", key).agg(F.sum("part").alias("score"))


def matches(metadata: Column, condition: Mapping[str, str], every: bool = True) -> Column:
    """RET-07: whether all (or any) pairs are equal in a map; a missing key is ""; no pairs match everything."""
    tests = [F.coalesce(F.try_element_at(metadata, F.lit(n)), F.lit("")) == v for n, v in condition.items()]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), tests) if tests else F.lit(True)


def hybrid(docs: DataFrame, key: str, text: str, vectors: DataFrame, vector_key: str, vector: str, queries: DataFrame, top: int = 10, condition: Column | None = None, prefilter: bool = False) -> DataFrame:
    """RET-04 to RET-06: keyword (0.4) and vector (0.6) branches fused; ``query_id, key, score, rank0``.

    ``queries(query_id, query, query_vector)``.  A condition on ``docs`` is applied to fused results before the
    final limit, or with ``prefilter`` to the documents before the search.
    """
    wanted = docs.filter(condition) if condition is not None and prefilter else docs
    dense_part = dense(vectors.withColumnRenamed(vector_key, key), key, vector, queries)
    if condition is not None and prefilter:
        dense_part = dense_part.join(wanted.select(key), key, "left_semi")
    fused = fuse({"dense": (dense_part, 0.6), "sparse": (bm25(wanted, key, text, queries), 0.4)}, key)
    if condition is not None and not prefilter:
        fused = fused.join(docs.filter(condition).select(key), key, "left_semi")
    return _top(fused, key, top).select("query_id", key, "score", "rank0")


def lexical_overlap(query: pd.Series, text: pd.Series) -> pd.Series:
    """Default scorer of :func:`rerank`: share of the query's words that the text has."""
    def one(q: str, t: str) -> float:
        asked = set((q or "").lower().split())
        return len(asked & set((t or "").lower().split())) / len(asked) if asked else 0.0
    return pd.Series([one(q, t) for q, t in zip(query, text)])


def rerank(hits: DataFrame, key: str, query: str, text: str, scorer: Callable[[pd.Series, pd.Series], pd.Series] = lexical_overlap, first: int = 20, top: int = 5) -> DataFrame:
    """RET-08: the first hits scored again by a model hook; adds ``rerank_score`` and keeps the best."""
    score = F.pandas_udf(scorer, "double")
    some = hits.filter(F.col("rank0") < first).withColumn("rerank_score", score(query, text))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank0", key)
    return some.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= top).drop("__r")


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], pd.Series], name: str = "embedding", prefix: str = "") -> DataFrame:
    """RET-09: vectors of texts by a batch model hook, with an optional query prefix."""
    return df.withColumn(name, F.pandas_udf(model, "array<float>")(F.concat(F.lit(prefix), F.col(text))))


def valid_hits(hits: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """JOI-03: hits whose tag is in the causal tag set."""
    return hits.join(tags.select(tag).distinct(), tag, "left_semi")
