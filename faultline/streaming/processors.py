"""Stateful streams that share their steps with the batch operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.recurrences import Recurrence
from ..operators import quantize


def scan_stream(stream: DataFrame, key: str, order: Sequence[str], value: str, what: Recurrence, reset: str | None = None) -> DataFrame:
    """FLT-01/04/08, WIN-02 on a stream: the outputs of a recurrence for each event, with state kept per key.

    Events of a micro-batch are put in order first; later ones go on from the stored state.  A true ``reset``
    column clears the key's state before its event (FLT-03).
    """
    columns = [key, *order, value, *([reset] if reset else [])]
    fields = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in columns)
    out = f"{fields}, {', '.join(f'`{c}` double' for c in what.outputs)}"
    held = ", ".join(f"s{k} double" for k in range(len(what.start)))

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else what.start
        rows = pd.concat(list(batches)).sort_values(list(order))
        made = []
        for v, clear in zip(rows[value].tolist(), rows[reset].tolist() if reset else [False] * len(rows)):
            now, got = what.step(what.start if clear else now, v)
            made.append(got)
        state.update(tuple(float(x) for x in now))
        yield pd.concat([rows, pd.DataFrame(made, columns=list(what.outputs), index=rows.index, dtype="float64")], axis=1)

    return stream.select(*columns).groupBy(key).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def align_stream(stream: DataFrame, key: str, at: str, source: str, event_time: str, n_sources: int, spread: int, late: str = "10 seconds") -> DataFrame:
    """ALN-02: bundles ``key, at, n_events`` of a stream; the watermark bounds what waits for missing sources.

    Pending events are kept per key until the watermark passes their spread.  A batch of events is merged into
    the pending ones in order of time; a bundle is sent once, when the last source of its window has come.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, at)}
    timed = stream.withWatermark(event_time, late).select(key, at, source, event_time)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, names, sent = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in batches:
            times += pdf[at].astype("int64").tolist()
            names += pdf[source].tolist()
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted(zip(times, names))
        found, first = [], 0
        for n, (t, _) in enumerate(rows):
            if n + 1 < len(rows) and rows[n + 1][0] == t:
                continue  # the last event at a time sees all of them
            while rows[first][0] < t - spread:
                first += 1
            if t not in sent and len({s for _, s in rows[first : n + 1]}) == n_sources:
                found.append((k[0], t, n + 1 - first))
                sent.append(t)
        mark = state.getCurrentWatermarkMs() * 1_000_000 - spread
        kept = [(t, s) for t, s in rows if t >= mark]
        state.update(([t for t, _ in kept], [s for _, s in kept], [t for t in sent if t >= mark]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(t for t, _ in rows) + spread) // 1_000_000 + 1))
        yield pd.DataFrame(found, columns=[key, at, "n_events"])

    return timed.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, n_events long", "times array<bigint>, names array<string>, sent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )


def quantize_batches(stream: DataFrame, key: str, order: Sequence[str], value: str, path: str, checkpoint: str, size: int = 1024, nbits: int = 8):
    """CMP-06 on a stream: each micro-batch quantised in blocks and appended; returns the started query."""

    def write(batch: DataFrame, number: int) -> None:
        coded = quantize.blocks(batch, key, order, value, size, nbits).withColumn("batch", F.lit(number))
        coded.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def depth_stream(stream: DataFrame, source: str, limit: int = 1000) -> DataFrame:
    """ALN-03 on a stream: running pool depth per source (complete mode)."""
    return stream.groupBy(source).agg(F.count("*").alias("depth")).withColumn("over_limit", F.col("depth") > limit)
