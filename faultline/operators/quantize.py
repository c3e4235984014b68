"""Lossy dictionary quantisation and packed matrices (CMP, AGG-02, AGG-03), natively.

Merging the closest neighbouring clusters until ``2 ** nbits`` remain equals cutting the sorted distinct values at
the largest gaps, because a gap between neighbours never changes when others merge.  So codes come from ranks of
gaps, not from a merge loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_side
from .segments import BUCKET, PLACE, numbered


def value_bucket(value: Column) -> Column:
    """Order-preserving buckets: each spans about 1.6 % of a value's size, so it has few distinct FLOATs."""
    return F.floor(F.asinh(value.cast("double") * 1e6) * 64)


def dictionary(df: DataFrame, keys: Sequence[str], value: str, nbits: int = 8) -> DataFrame:
    """CMP-01, CMP-02, CMP-07: ``keys, value, code, centre, cnt`` for each distinct value (as FLOAT).

    Gap ties cut at the larger value.  ``cnt`` counts the rows of the cluster.  A key's values are never gathered:
    neighbours and running counts are taken within buckets of close values, and carried from bucket to bucket by
    a table with a row per bucket; of each task's gaps, only as many as there can be cuts are kept.
    """
    if not 2 <= nbits <= 16:
        raise ValueError("nbits must lie in 2..16")
    return _coded(df, keys, value, nbits).drop("n")


def _coded(df: DataFrame, keys: Sequence[str], value: str, nbits: int) -> DataFrame:
    """:func:`dictionary`, with the rows ``n`` of each value."""
    # a struct of the keys: equal where the keys are, null ones included
    values = df.select(F.struct(F.lit(0).alias("_"), *keys).alias("__k"), F.col(value).cast("float").alias("value")).filter("value is not null")
    distinct = values.groupBy("__k", "value").agg(F.count("*").alias("n")).withColumn("__b", value_bucket(F.col("value")))
    inside, along = Window.partitionBy("__k", "__b").orderBy("value"), Window.partitionBy("__k").orderBy("__b")
    ends = distinct.groupBy("__k", "__b").agg(F.max("value").alias("__top")).withColumn("__below", F.lag("__top").over(along)).drop("__top")
    near = distinct.join(ends, ["__k", "__b"]).withColumn("gap", F.col("value") - F.coalesce(F.lag("value").over(inside), F.col("__below")))
    by_gap = Window.partitionBy("__k").orderBy(F.col("gap").desc(), F.col("value").desc())
    cuts = near.filter("gap is not null").withColumn("__r", F.row_number().over(by_gap)).filter(F.col("__r") <= (1 << nbits) - 1)
    per = cuts.groupBy("__k", "__b").agg(F.sort_array(F.collect_list("value")).alias("__cuts"))
    before = F.coalesce(F.sum(F.size("__cuts")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = ends.select("__k", "__b").join(per, ["__k", "__b"], "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<float>"))).withColumn("__before", before)
    running = F.sum(F.array_contains("__cuts", F.col("value")).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    coded = distinct.join(bounds, ["__k", "__b"]).withColumn("code", (F.col("__before") + running).cast("int")).select("__k", "value", "code", "n")
    clusters = coded.groupBy("__k", "code").agg(((F.min("value") + F.max("value")) / F.lit(2.0).cast("float")).cast("float").alias("centre"), F.sum("n").alias("cnt"))
    out = coded.join(clusters, ["__k", "code"])
    return out.select(*(F.col("__k")[k].alias(k) for k in keys), "value", "n", "code", "centre", "cnt")


def encode(df: DataFrame, keys: Sequence[str], value: str, nbits: int = 8) -> DataFrame:
    """``df`` plus ``code`` and the reconstruction ``centre`` (CMP-05); null values have neither."""
    codes = dictionary(df, keys, value, nbits).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("value").alias("__value"), "code", "centre")
    match = F.col(value).cast("float") == F.col("__value")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(codes, match, "left").drop("__value", *(f"__{k}" for k in keys))


def statistics(df: DataFrame, keys: Sequence[str], value: str, nbits: int = 8) -> DataFrame:
    """CMP-03, AGG-03: per key ``n, clusters, rms_error, stored_bytes, ratio``."""
    met = _coded(df, keys, value, nbits)
    off = F.col("value").cast("double") - F.col("centre").cast("double")
    per = met.groupBy(*keys).agg(F.sum("n").alias("n"), F.countDistinct("code").alias("clusters"), F.sqrt(F.sum(F.col("n") * off * off) / F.sum("n")).alias("rms_error"))
    return per.withColumn("stored_bytes", stored_bytes(F.col("n"), F.col("clusters"), nbits)).withColumn("ratio", F.col("stored_bytes") / (F.col("n") * 4))


def stored_bytes(n: Column, clusters: Column, nbits: int) -> Column:
    """Packed indexes, float centres and 4 bytes a count."""
    return (F.ceil(n * nbits / 8) + clusters * 4 + clusters * 4).cast("long")


def equal_frequency(df: DataFrame, keys: Sequence[str], value: str, bins: int, bucket: Column | None = None) -> DataFrame:
    """CMP-04: equal-frequency bins by rank; adds ``bin``.

    With ``bucket``, which must not decrease with ``value``, ranks are counted bucket by bucket, so no key is sorted in one task.
    """
    if bucket is None:
        return df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*keys).orderBy(value)) - 1)
    rows = df.withColumn("__keys", F.struct(*keys))
    totals = small_side(rows.groupBy("__keys").agg(F.count("*").alias("__total")))
    ranked = numbered(rows, "__keys", [value], bucket).join(totals, "__keys")
    # the first ``extra`` bins hold one row more than the others
    place, least, extra = F.col(PLACE) - 1, F.floor(F.col("__total") / bins), F.col("__total") % bins
    late = F.floor((place - extra * (least + 1)) / F.greatest(least, F.lit(1)))
    spot = F.when(place < extra * (least + 1), F.floor(place / (least + 1))).otherwise(extra + late)
    return ranked.withColumn("bin", spot.cast("int")).drop("__keys", "__total", BUCKET, PLACE)


def blocks(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 1024, nbits: int = 8, bucket: Column | None = None) -> DataFrame:
    """CMP-06, WIN-08: every run of ``size`` values of a key quantised on its own; adds ``block, code, centre``.

    With ``bucket``, which must not decrease along ``order``, rows are counted bucket by bucket, so no key is sorted in one task.
    """
    if bucket is None:
        rows = df.withColumn(PLACE, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    else:
        rows = numbered(df, key, order, bucket).drop(BUCKET)
    return encode(rows.withColumn("block", F.floor((F.col(PLACE) - 1) / size)).drop(PLACE), [key, "block"], value, nbits)


def lower_triangle(matrix: Column) -> Column:
    """CMP-08: a symmetric matrix (array of rows) as its lower triangle, row by row."""
    return F.flatten(F.transform(matrix, lambda row, i: F.slice(row, F.lit(1), i + 1)))


def full_matrix(packed: Column, n: int) -> Column:
    """CMP-08 back: rows of the symmetric matrix."""
    spot = lambda i, j: F.get(packed, (F.greatest(i, j) * (F.greatest(i, j) + 1) / 2 + F.least(i, j)).cast("int"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda i: F.transform(steps, lambda j: spot(i, j)))


def state_packet(state: Column, covariance: Column, epoch: Column) -> Column:
    """SNK-03: five states, fifteen covariance terms, time and padding: 22 floats."""
    return F.concat(state.cast("array<float>"), lower_triangle(covariance).cast("array<float>"), F.array(epoch.cast("float"), F.lit(0.0).cast("float")))
