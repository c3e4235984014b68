"""Time alignment of sources (SRC-04, SRC-05, ALN, JOI)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small_side

#: Spreads in a stretch of time that one task aligns; the events of one spread before it are aligned twice.
STRETCH = 8


def keyed(events: DataFrame, sources: DataFrame) -> DataFrame:
    """SRC-04, SRC-05: events with ``aligned_ns = ntp_ns + delay_ns`` of their source; an unknown source fails."""
    known = small_side(sources.select(F.col("source").alias("__source"), "delay_ns"))
    met = events.join(known, events["source"] == known["__source"], "left")
    checked = F.when(F.col("__source").isNull(), F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null")))).cast("long"))
    return met.withColumn("aligned_ns", checked.otherwise(F.col("ntp_ns") + F.col("delay_ns"))).drop("__source", "delay_ns")


def bundles(events: DataFrame, keys: list[str], at: str, source: str, n_sources: int, spread: int, carry: Column | None = None, non_overlapping: bool = False) -> DataFrame:
    """ALN-01: one bundle per distinct ``at`` whose window ``[at - spread, at]`` holds every source.

    ``keys, at, n_events`` and, if ``carry`` is given, ``events``: the carried values in order.  With
    ``non_overlapping``, a bundle starts only where the window of the one kept before has passed.

    A key's time is cut into stretches, each a task's own with the events that still count in it.  Sources and events are
    running sums of what comes and goes, so the work does not grow with the number of events in a window; only ``carry`` gathers them.
    """
    stretch = lambda t: F.floor(t / F.lit(max(1, STRETCH * spread)))
    on = [*keys, "__stretch"]
    reach = F.explode_outer(F.sequence(stretch(F.col(at)), stretch(F.col(at) + spread)))
    held = events.select(*keys, at, F.col(source).alias("__source"), *([carry.alias("__carried")] if carry is not None else []), reach.alias("__stretch")).repartition(*on)
    each = held.groupBy(*on, at, "__source").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*on, "__source").orderBy(at)
    fresh = (F.row_number().over(w) == 1) | F.coalesce(F.col(at) - F.lag(at).over(w) > spread, F.lit(False))
    left = F.lead("__n").over(w).isNull() | F.coalesce(F.lead(at).over(w) - F.col(at) > spread, F.lit(False))
    known = F.col("__source").isNotNull()
    marked = each.withColumn("__comes", (fresh & known).cast("long")).withColumn("__goes", (left & known).cast("long"))
    # at a time, what comes stands before what goes
    comes = F.struct(F.col(at).alias("__t"), F.lit(0).alias("__side"), F.col("__comes").alias("__ds"), F.col("__n").alias("__dn"))
    goes = F.struct((F.col(at) + spread).alias("__t"), F.lit(1).alias("__side"), (-F.col("__goes")).alias("__ds"), (-F.col("__n")).alias("__dn"))
    until = Window.partitionBy(*on).orderBy("__t", "__side").rangeBetween(Window.unboundedPreceding, 0)
    moves = marked.select(*on, F.inline(F.array(comes, goes)))
    counted = moves.withColumn("__sources", F.sum("__ds").over(until)).withColumn("n_events", F.sum("__dn").over(until))
    own = (F.col("__side") == 0) & F.col("__stretch").eqNullSafe(stretch(F.col("__t")))
    kept = counted.filter(own & (F.col("__sources") == n_sources)).dropDuplicates([*on, "__t"]).withColumnRenamed("__t", at)
    if carry is not None:
        listed = held.withColumn("events", F.collect_list("__carried").over(Window.partitionBy(*on).orderBy(at).rangeBetween(-spread, 0))).dropDuplicates([*on, at])
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*on, at)]
        kept = kept.alias("k").join(listed.alias("l"), same).select(*(f"k.{c}" for c in (*keys, at, "n_events")), "l.events")
    kept = kept.select(*keys, at, "n_events", *(["events"] if carry is not None else []))
    if not non_overlapping:
        return kept
    schema = kept.schema

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = None, 0
        for pdf in batches:
            take = []
            for key, t in zip(zip(*(pdf[k] for k in keys)), pdf[at]):
                fresh = key != held or t - last > spread
                if fresh:
                    held, last = key, t
                take.append(fresh)
            yield pdf[take]

    return kept.repartition(*keys).sortWithinPartitions(*keys, at).mapInPandas(thin, schema)


def pool_depth(events: DataFrame, source: str, limit: int = 1000) -> DataFrame:
    """ALN-03: pending events per source and whether they exceed the limit."""
    return events.groupBy(source).agg(F.count("*").alias("depth")).withColumn("over_limit", F.col("depth") > limit)


def alignment_rate(events: DataFrame, made: DataFrame) -> DataFrame:
    """ALN-04: ``fed, bundles, rate`` (0 if nothing was fed)."""
    fed, got = events.agg(F.count("*").alias("fed")), made.agg(F.count("*").alias("bundles"))
    both = fed.unionByName(got, allowMissingColumns=True).agg(F.sum("fed").alias("fed"), F.sum("bundles").alias("bundles"))
    return both.withColumn("rate", F.when(F.col("fed") > 0, F.col("bundles") / F.col("fed")).otherwise(0.0))


def warp(a: np.ndarray, b: np.ndarray, window: int | None = None, metric: str = "squared") -> tuple[float, np.ndarray]:
    """ALN-05, ALN-06: dynamic time warping distance and path ``(K, 2)``; ties go diagonal, up, left.

    The band is widened to the difference of the lengths; only the band is held in memory.
    """
    n, m = len(a), len(b)
    if not n or not m:
        raise ValueError("both series need at least one value")
    if window is not None and window <= 0:
        raise ValueError("a window must be positive")
    band = max(n, m) if window is None else max(window, abs(n - m))
    width = min(2 * band + 1, m + band)
    cost = np.full((n + 1, width + 2), np.inf)  # row i holds columns j = i - band + k - 1
    moves = np.zeros((n + 1, width + 2), np.int8)
    shift = lambda i: i - band - 1
    cost[0, 0 - shift(0)] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            k = j - shift(i)
            gap = a[i - 1] - b[j - 1]
            # one row up moves the frame by one place
            options = (cost[i - 1, k], cost[i - 1, k + 1] if k + 1 < width + 2 else np.inf, cost[i, k - 1])
            best = min(range(3), key=options.__getitem__)
            cost[i, k] = (gap * gap if metric == "squared" else abs(gap)) + options[best]
            moves[i, k] = best
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        move = moves[i, j - shift(i)]
        i, j = i - (move != 2), j - (move != 1)
    return float(cost[n, m - shift(n)]), np.array(path[::-1])


def dtw(pairs: DataFrame, key: str, left: str, right: str, window: int | None = None, metric: str = "squared") -> DataFrame:
    """ALN-05 to ALN-07: per row of two ARRAY<DOUBLE> columns: ``key, distance, lag_mean, lag_std, steps, path``."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b in zip(pdf[key], pdf[left], pdf[right]):
                distance, path = warp(np.asarray(a, float), np.asarray(b, float), window, metric)
                lag = path[:, 0] - path[:, 1]
                rows.append((k, distance, float(np.abs(lag).mean()), float(lag.std()), len(path), [{"i": int(i), "j": int(j)} for i, j in path]))
            yield pd.DataFrame(rows, columns=[key, "distance", "lag_mean", "lag_std", "steps", "path"])

    return pairs.select(key, left, right).mapInPandas(run, f"`{key}` {kind}, distance double, lag_mean double, lag_std double, steps long, path array<struct<i: int, j: int>>")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The last known ``value`` of ``right`` at or before each row of ``left``, without a range join."""
    tagged = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    known = right.select(*keys, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(known, allowMissingColumns=True).withColumn(f"asof_{value}", F.last("__v", ignorenulls=True).over(w))
    return both.filter("__side = 1").drop("__side", "__v")
