"""Writers (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantize import state_packet


def jsonl(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """SNK-01, SNK-02: JSON lines, in as many files as there are partitions, or in ``files``."""
    (df.coalesce(files) if files else df).write.mode(mode).json(path)


def packets(df: DataFrame, state: str, covariance: str, epoch: str) -> DataFrame:
    """SNK-03: adds the 22-float ``packet``; the exact time stays beside it as a BIGINT."""
    return df.withColumn("packet", state_packet(F.col(state), F.col(covariance), F.col(epoch)))


def state_table(states: DataFrame, path: str, key: str = "alarm_id", latest: str | None = None) -> None:
    """SNK-05: a saved table of agent states, one row per key, for a later run to go on from.

    Of a repeated key, the row with the largest ``latest`` stays; ties, and all repeats without that column, are broken by a
    hash of the whole row, so reruns agree.  ``states`` must not be read from ``path``, which is replaced.
    """
    whole = F.xxhash64(F.to_json(F.struct(*states.columns)))
    order = [F.col(latest).desc_nulls_last()] if latest else []
    first = states.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order, whole)))
    first.filter("__place = 1").drop("__place").write.mode("overwrite").parquet(path)
