"""Queries agree with their SQL on odd rows, and their plans hold at size."""

import duckdb
from pyspark.sql import functions as F

from faultline.operators import retrieval
from faultline.plans import ORACLES, QUERIES


def agrees(spark, folder, name, *tables):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    return got


def test_keyword_search_of_odd_texts(spark, tmp_path):
    """A null text has no length, an id may repeat, letters are lowered one by one, and blanks are those of the SQL."""
    docs = [(1, "pump seal wear"), (2, None), (3, "pump\x0bseal wear"), (4, " wear "), (5, "ΝΑΟΣ wear"), (6, "νaος İx"), (7, "a b c"), (7, "a seal"), (7, "b seal"), (8, "d"), (9, ""), (10, "e f"), (11, "g h"), (12, None)]
    items = [(1, "pump wear"), (2, " seal seal"), (3, "ναοσ ix"), (4, None), (5, "pump\x0bseal")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.query_id for r in agrees(spark, tmp_path, "bm25_topk", "documents", "benchmark")} == {1, 2, 3, 5}
    agrees(spark, tmp_path, "token_lists", "documents")


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    parts = [(0, 0.1), (0, 1e9 / 7), (0, 1e-9 / 3), (0, 200 / 3)]
    sums = set()
    for order in (parts, parts[::-1], parts[2:] + parts[:2]):
        df = spark.createDataFrame(order, "k int, x double").coalesce(1)
        sums.add(df.groupBy("k").agg(retrieval._exact_sum(F.col("x")).alias("s")).first()["s"])
    assert len(sums) == 1 and abs(sums.pop() - sum(x for _, x in parts)) < 1e-6


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alignment_of_odd_events(spark, tmp_path):
    """Bundles agree with the SQL for crowded, equal, null and far times, and no window's events are gathered."""
    kinds = ["click", "view", "signup", "purchase", "error"]
    times = [0, 0, 1, 3600, 7199, 7200, 7201, 57599, 57600, 57601, 64800, 64801, 9_000_000, None, None]
    rows = [(i, user, kinds[(i * 7 + i // 5) % 5], t) for i, (user, t) in enumerate((u, t) for u in (0, 4, 1, None) for t in times for _ in range(1 if u == 1 else 4))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").withColumn("value", F.lit(1.0))
    df.select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    assert len(agrees(spark, tmp_path, "align_bundles", "events")) > 10
    agrees(spark, tmp_path, "align_rate", "events")
    assert "RangeFrame, -" not in plan_of(QUERIES["align_rate"](spark, str(tmp_path)))


def test_tables_are_read_where_they_lie(spark):
    """No side of a join holds a header per document, which a driver would collect to broadcast it."""
    df = QUERIES["md_rewrite"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan_of(df) and "Aggregate" not in plan_of(df) and df.count() == 200
