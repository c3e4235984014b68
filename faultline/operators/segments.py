"""Recurrences of the form ``y[n] = a[n] * y[n - 1] + b[n]`` cut into segments, for keys too long for one task.

A segment is one (key, bucket); buckets follow the order, for example spans of time.  Steps compose: a segment is
itself a map ``y -> A * y + B``.  So segments are reduced side by side, the few maps of a key are walked in order,
and every segment is then filled in from its start value.  Filters whose gain does not depend on data, and moving
means and variances, have this form; clipped innovations and annealed weights have not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, PLACE = "__bucket", "__n"


def numbered(df: DataFrame, key: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """Adds the bucket and each row's position (from 1) in its key, without gathering a key.

    ``bucket`` must not decrease along ``order``.  Positions are counts of the buckets before plus the place in
    the bucket.  Null keys are one key and null buckets its first one: they meet as structs, which are never null.
    """
    rows = df.withColumn(BUCKET, bucket).withColumn("__group", F.struct(F.col(key).alias("key"), F.col(BUCKET).alias("bucket")))
    sizes = rows.groupBy("__group").agg(F.count("*").alias("__size"))
    ahead = Window.partitionBy("__group.key").orderBy("__group.bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__group", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__group").orderBy(*order))
    return rows.withColumn(PLACE, within).join(sizes, "__group").withColumn(PLACE, F.col(PLACE) + F.col("__before")).drop("__before", "__group")


def affine_scan(rows: DataFrame, key: str, order: Sequence[str], a: Column, b: Column, start: float, name: str) -> DataFrame:
    """``rows`` (of :func:`numbered`) plus ``name``, the value after each row, and ``name_before``, the one before it."""
    kind = rows.schema[key].dataType.simpleString()
    ready = rows.withColumn("__a", a.cast("double")).withColumn("__b", b.cast("double"))
    sort = [key, BUCKET, *order]
    segment = ready.select(key, BUCKET, *order, "__a", "__b").repartition(key, BUCKET).sortWithinPartitions(*sort)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, whole, rest = None, 1.0, 0.0
        for pdf in batches:
            out = []
            for k, u, x, y in zip(pdf[key].tolist(), pdf[BUCKET].tolist(), pdf["__a"].tolist(), pdf["__b"].tolist()):
                if (k, u) != held:
                    if held is not None:
                        out.append((*held, whole, rest))
                    held, whole, rest = (k, u), 1.0, 0.0
                whole, rest = x * whole, x * rest + y
            yield pd.DataFrame(out, columns=[key, BUCKET, "__a", "__b"])
        if held is not None:
            yield pd.DataFrame([(*held, whole, rest)], columns=[key, BUCKET, "__a", "__b"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = object(), start
        for pdf in batches:
            begins = []
            for k, x, y in zip(pdf[key].tolist(), pdf["__a"].tolist(), pdf["__b"].tolist()):
                now = start if k != held else now
                begins.append(now)
                held, now = k, x * now + y
            yield pd.DataFrame({key: pdf[key], BUCKET: pdf[BUCKET], "__start": begins})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, 0.0
        for pdf in batches:
            before, after = [], []
            for k, u, s, x, y in zip(*(pdf[c].tolist() for c in (key, BUCKET, "__start", "__a", "__b"))):
                if (k, u) != held:
                    held, now = (k, u), s
                before.append(now)
                now = x * now + y
                after.append(now)
            yield pdf.drop(columns=["__a", "__b", "__start"]).assign(**{f"{name}_before": before, name: after})

    maps = segment.mapInPandas(reduce, f"`{key}` {kind}, {BUCKET} long, __a double, __b double")
    starts = maps.repartition(key).sortWithinPartitions(key, BUCKET).mapInPandas(walk, f"`{key}` {kind}, {BUCKET} long, __start double")
    met = ready.join(starts, [key, BUCKET]).repartition(key, BUCKET).sortWithinPartitions(*sort)
    out = met.drop("__a", "__b", "__start").withColumn(f"{name}_before", F.lit(0.0)).withColumn(name, F.lit(0.0)).schema
    columns = [f.name for f in out]
    return met.select(*(c for c in columns if c not in (name, f"{name}_before")), "__a", "__b", "__start").mapInPandas(fill, out)


def gain_table(q: float, r: float, p0: float, digits: float = 1e-17) -> list[float]:
    """Gains by position until they no longer change (FLT-06)."""
    out, p = [], p0
    while len(out) < 1_000_000 and (len(out) < 2 or abs(out[-1] - out[-2]) > digits):
        gain = (p + q) / (p + q + r)
        p = (1.0 - gain) * (p + q)
        out.append(gain)
    return out


def kalman(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str = "x", q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, x0: float = 0.0) -> DataFrame:
    """FLT-01 over segments of :func:`numbered` rows; adds ``name``."""
    gains = gain_table(q, r, p0)
    gain = F.get(F.array(*map(F.lit, gains)), F.least(F.col(PLACE) - 1, F.lit(len(gains) - 1)).cast("int"))
    return affine_scan(rows.withColumn("__gain", gain), key, order, 1.0 - F.col("__gain"), F.col("__gain") * F.col(value), x0, name).drop("__gain", f"{name}_before")


def two_stage(df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column, first: tuple = (1e-5, 1e-3, 1.0), second: tuple = (1e-6, 5e-3, 1.0)) -> DataFrame:
    """FLT-04 over segments; adds ``x1`` and ``x``."""
    rows = numbered(df.select(key, *order, value), key, order, bucket)
    rows = kalman(rows, key, order, value, "x1", *first)
    return kalman(rows, key, order, "x1", "x", *second).drop(BUCKET, PLACE)


def baseline(df: DataFrame, key: str, order: Sequence[str], value: str, bucket: Column, alpha: float = 0.05, min_window: int = 1000, sigmas: float = 3.0) -> DataFrame:
    """WIN-02 to WIN-04 over segments, finite values only; adds ``mean, variance, z, flag, lower, upper``."""
    v = F.col(value).cast("double")
    rows = numbered(df.select(key, *order, value).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), key, order, bucket)
    first = F.col(PLACE) == 1
    rows = affine_scan(rows, key, order, F.when(first, 0.0).otherwise(1.0 - alpha), F.when(first, v).otherwise(alpha * v), 0.0, "mean")
    gap = v - F.col("mean_before")
    rows = affine_scan(rows, key, order, F.when(first, 0.0).otherwise(1.0 - alpha), F.when(first, 1.0).otherwise(alpha * gap * gap), 1.0, "variance")
    std = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1e-6)
    z = F.when(F.col(PLACE) >= min_window, (v - F.col("mean")) / std).otherwise(0.0)
    made = {"z": z, "flag": (F.abs(z) > sigmas).cast("double"), "lower": F.col("mean") - sigmas * std, "upper": F.col("mean") + sigmas * std}
    return rows.withColumns(made).drop(BUCKET, PLACE, "mean_before", "variance_before")


def trailing(df: DataFrame, key: str, order: Sequence[str], bucket: Column, window: int, made: dict[str, Column], segment: int = 100_000) -> DataFrame:
    """``df`` plus aggregates ``made`` over each row and the ``window - 1`` before it, for keys of any length.

    Rows are cut into segments by position; the rows before a segment that its frames reach into are copied to
    it, so frames are whole and no key is sorted in one task.
    """
    if segment < window:
        raise ValueError("a segment must hold a window")
    rows = numbered(df, key, order, bucket)
    part, place = F.floor((F.col(PLACE) - 1) / segment), (F.col(PLACE) - 1) % segment
    parts = F.when(place >= segment - (window - 1), F.array(part, part + 1)).otherwise(F.array(part)) if window > 1 else F.array(part)
    spread = rows.withColumn("__own", part).withColumn("__part", F.explode(parts))
    frame = Window.partitionBy(key, "__part").orderBy(PLACE).rowsBetween(-(window - 1), 0)
    out = spread.withColumns({name: f.over(frame) for name, f in made.items()})
    return out.filter("__own = __part").drop("__own", "__part", BUCKET)


def rolling(df: DataFrame, key: str, order: Sequence[str], value: str, name: str, bucket: Column, window: int = 60, segment: int = 100_000) -> DataFrame:
    """WIN-01 over segments: adds ``{name}_rolling_mean`` and ``_std`` as :func:`features.rolling` does."""
    x = F.col(value).cast("double")
    made = {f"{name}_rolling_mean": F.avg(x), f"{name}_rolling_std": F.stddev_pop(x)}
    rows = trailing(df, key, order, bucket, window, made, segment)
    # what short series and the first rows take: a row per key
    whole = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows"), F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__std"))
    lead = rows.filter(F.col(PLACE) == window).select(F.col(key).alias("__lead"), *(F.col(c).alias(f"__{c}") for c in made))
    rest = whole.join(lead, F.col("__key").eqNullSafe(F.col("__lead")), "left").drop("__lead")
    met = rows.join(rest, F.col(key).eqNullSafe(F.col("__key")))
    short, first = F.col("__rows") < window, F.col(PLACE) < window
    filled = {c: F.when(short, F.col(g)).when(first, F.col(f"__{c}")).otherwise(F.col(c)) for c, g in zip(made, ("__mean", "__std"))}
    return met.withColumns(filled).select(*df.columns, *made)
