"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of a join counts as small.
SMALL = 100_000


def small_side(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have ``rows`` or fewer, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
