"""Recursive signal filters (FLT)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recurrences as rec
from .scan import scan, scan_by


def kalman(df: DataFrame, key: str, order: Sequence[str], value: str, **params) -> DataFrame:
    """FLT-01: one filter per key, in order; adds ``x, p, gain``."""
    return scan(df, key, order, value, rec.kalman(**params))


def two_stage(df: DataFrame, key: str, order: Sequence[str], value: str, **params) -> DataFrame:
    """FLT-04, FLT-05: cascade per key; adds ``x1`` and ``x``."""
    return scan(df, key, order, value, rec.kalman_cascade(**params))


def two_stage_by_class(df: DataFrame, key: str, order: Sequence[str], value: str, class_column: str, overrides: dict) -> DataFrame:
    """FLT-14: cascades with stages by signal class; ``overrides[class]`` are keyword arguments of the cascade."""
    by_class = {None: rec.kalman_cascade(), **{c: rec.kalman_cascade(**p) for c, p in overrides.items()}}
    return scan_by(df, key, order, value, by_class, class_column)


def annealed(df: DataFrame, key: str, order: Sequence[str], value: str, **params) -> DataFrame:
    """FLT-08 to FLT-10: annealed single measurements; adds ``x, weight, outlier`` (0 or 1)."""
    return scan(df, key, order, value, rec.annealed_kalman(**params))


def final_state(df: DataFrame, key: str, order: Sequence[str], value: str, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0, x0: float = 0.0) -> DataFrame:
    """FLT-01, last estimate only, natively: a fold over each key's ordered values."""
    state = F.struct(F.lit(x0).alias("x"), F.lit(p0).alias("p"))

    def fold(s: Column, e: Column) -> Column:
        ahead = s["p"] + q
        gain = ahead / (ahead + r)
        return F.struct((s["x"] + gain * (e["v"] - s["x"])).alias("x"), ((1.0 - gain) * ahead).alias("p"))

    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("rows"))
    return rows.select(key, F.aggregate("rows", state, fold).alias("s")).select(key, "s.x", "s.p")


def gains(spark, n: int, q: float = 1e-5, r: float = 1e-3, p0: float = 1.0) -> DataFrame:
    """FLT-06: ``n, gain, p``: the gains depend on parameters and position only, never on data."""
    return spark.sql(f"""
        WITH RECURSIVE g(n, gain, p) MAX RECURSION LEVEL {n + 1} AS (
            SELECT 1L, ({p0}D + {q}D) / ({p0}D + {q}D + {r}D), (1D - ({p0}D + {q}D) / ({p0}D + {q}D + {r}D)) * ({p0}D + {q}D)
            UNION ALL
            SELECT n + 1, (p + {q}D) / (p + {q}D + {r}D), (1D - (p + {q}D) / (p + {q}D + {r}D)) * (p + {q}D) FROM g WHERE n < {n}L)
        SELECT * FROM g""")


def schedule(spark, start: float = 100.0, final: float = 0.1, steps: int = 5) -> DataFrame:
    """FLT-07: ``step, beta``."""
    beta = F.lit(start) * F.pow(F.lit(final / start), F.col("id") / F.lit(max(1, steps - 1)))
    return spark.range(steps).select(F.col("id").alias("step"), (beta if steps > 1 else F.lit(final)).alias("beta"))


def weight(chi2: Column, beta: float, prob_cut: float = 1e-3) -> Column:
    """FLT-09 as an expression, for one measurement, where the spread cancels."""
    inside = F.exp(-F.least(chi2 / (2.0 * beta), F.lit(50.0)))
    outside = F.exp(-F.least(F.log(F.lit(1.0 / max(prob_cut, 1e-12))) * 2.0 / (2.0 * beta), F.lit(50.0)))
    return inside / (inside + outside)


def window_ids(position: Column, size: int = 32, step: int = 16) -> Column:
    """WIN-07: ids of the overlapping count windows that a position (from 0) lies in."""
    last = F.floor(position / step)
    first = F.greatest(F.lit(0), F.floor((position - size) / step) + 1)
    return F.sequence(first.cast("long"), last.cast("long"))


def windows(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 32, step: int = 16, partial: bool = True) -> DataFrame:
    """FLT-11, FLT-13: ``key, window_id, values``; the last, partial window of a key stays with ``partial``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    spread = df.withColumn("place", place).withColumn("window_id", F.explode(window_ids(F.col("place"), size, step)))
    held = spread.groupBy(key, "window_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col(value).cast("double").alias("v")))).alias("rows"))
    held = held.select(key, "window_id", F.transform("rows", lambda x: x["v"]).alias("values"), F.size("rows").alias("n"))
    # a window past the first that only repeats the tail of the one before adds nothing to flush
    return held.filter((F.col("n") == size) | (F.lit(partial) & ((F.col("window_id") == 0) | (F.col("n") > size - step))))


def annealed_windows(df: DataFrame, key: str, order: Sequence[str], value: str, r: float = 1e-3, q: float = 1e-5, p0: float = 1.0, shared: bool = False, outlier: float = 0.1, size: int = 32, step: int = 16) -> DataFrame:
    """FLT-12: joint annealing of each count window: ``key, window_id, n, n_outliers, converged, iterations, weights``.

    Each window starts from its first value, so windows are independent of each other and of partitioning.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, w, values in zip(pdf[key], pdf["window_id"], pdf["values"]):
                values = [float(v) for v in values]
                weights, settled, iterations = rec.annealed_window(values, [r] * len(values), values[0], p0, q, shared=shared)
                rows.append((k, w, len(values), sum(x < outlier for x in weights), settled, iterations, weights))
            yield pd.DataFrame(rows, columns=[key, "window_id", "n", "n_outliers", "converged", "iterations", "weights"])

    held = windows(df, key, order, value, size, step).select(key, "window_id", "values")
    return held.mapInPandas(run, f"`{key}` {kind}, window_id long, n long, n_outliers long, converged boolean, iterations long, weights array<double>")
