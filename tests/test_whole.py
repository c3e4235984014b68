"""Signal queries cover every row."""

from collections import Counter

from pyspark.sql import functions as F

from faultline.operators import align, transforms
from faultline.plans import signals


def write_events(spark, path, sizes):
    rows = [(i, user, kind, float((i * 37) % 101)) for i, (user, kind) in enumerate(k for k, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.select("event_id", "user_id", F.timestamp_seconds("event_id").alias("ts"), "event_type", "value").write.parquet(f"{path}/events.parquet")
    return rows


def test_windows_cover_whole_histories(spark, tmp_path):
    rows = write_events(spark, tmp_path, {(1, "a"): 130, (2, "a"): 45, (3, "a"): 40, (4, "a"): 80})
    got = {(r.user_id, r.window): r for r in signals.dtw_lag(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)}
    assert got[3, 0].distance is None
    values = {u: [v for _, x, _, v in rows if x == u] for u in (1, 2, 4)}
    for (u, w), r in got.items():
        if u != 3:
            distance, path = align.warp(values[u][40 * w : 40 * w + 40], values[u][40 * w + 40 : 40 * w + 80], 10)
            assert (r.distance, r.steps) == (round(distance, 4), len(path))


def test_blocks_cover_every_event(spark, tmp_path):
    rows = write_events(spark, tmp_path, {(1, "click"): 256 * 2 + 9, (1, "view"): 100, (1, "temperature"): 3, (1, "signup"): 512})
    kinds = Counter(k for _, _, k, _ in rows)
    for query in (signals.wavelet_denoise, signals.wavelet_by_class):
        got = query(spark, str(tmp_path)).collect()
        assert Counter(r.event_type for r in got) == kinds and len({(r.event_type, r.block, r.place) for r in got}) == len(rows)
        assert sorted(Counter(r.block for r in got if r.event_type == "click").values()) == [256, 265]
    got = {r.name for r in signals.scalogram(spark, str(tmp_path)).collect()}
    assert got == {"click/0", "click/1", "view/0", "temperature/0", "signup/0", "signup/1"}
    assert transforms.max_level(3, "db4") == 0
