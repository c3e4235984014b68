"""Runs a recurrence over ordered rows of many keys.

Rows are hash-partitioned by key and sorted within partitions (spilling as needed); a task walks its rows once,
holding one state, so a key's history never has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.recurrences import Recurrence


def scan(df: DataFrame, key: str, order: Sequence[str], value: str, what: Recurrence) -> DataFrame:
    """``key, *order, value`` of ``df`` plus the recurrence's outputs, each key in the order given."""
    return scan_by(df, key, order, value, {None: what})


def scan_by(df: DataFrame, key: str, order: Sequence[str], value: str, by_class: dict, class_column: str | None = None) -> DataFrame:
    """:func:`scan` with a recurrence per value of ``class_column``; ``None`` is the default (FLT-14)."""
    outputs = by_class[None].outputs
    columns = [key, *order, value, *([class_column] if class_column else [])]
    rows = df.select(*columns).repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, step = object(), (), None
        for pdf in batches:
            made = []
            classes = pdf[class_column].tolist() if class_column else [None] * len(pdf)
            for k, v, c in zip(pdf[key].tolist(), pdf[value].tolist(), classes):
                if k != held:
                    what = by_class.get(c, by_class[None])
                    held, state, step = k, what.start, what.step
                state, out = step(state, v)
                made.append(out)
            yield pd.concat([pdf, pd.DataFrame(made, columns=list(outputs), index=pdf.index, dtype="float64")], axis=1)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInPandas(run, f"{fields}, {', '.join(f'`{c}` double' for c in outputs)}")


