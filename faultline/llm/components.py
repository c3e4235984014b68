"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long node ids -> ``(node, root)``, root the smallest node of its component.

    Nodes without an edge do not appear.  Loops, repeated edges and both directions are allowed; null ends are
    ignored; no edges give no rows.  Each round is a fixed number of shuffles over the edges, written to the
    shared folder, and halves path lengths at least; minima are pre-aggregated, so hubs do not gather in a task.
    """
    cut = stash(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components",
    )
    before = _mark(cut)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cut.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cut.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(floor.select("a", F.col("m").alias("b")))
            .distinct()
        )
        done, cut = cut, stash(small, "components")
        after = _mark(cut)
        unstash(done)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return cut.select(F.col("a").alias("node"), F.col("b").alias("root"))
