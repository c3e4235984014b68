"""Queries of signal filters, alignment, features, baselines, quantisation and simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import recurrences as rec
from ..operators import align, features, filters, quantize, segments, simulate, transforms
from ..session import table
from . import transform_sql
from .registry import ORACLES, query

ORDER = ("ts", "event_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: the user is the tag."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def week() -> Column:
    return F.floor(micros() / F.lit(604_800_000_000))


SEQ = "SELECT user_id, event_id, value AS z, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def kalman_step(x: str, p: str, z: str, q: str, r: str) -> tuple[str, str]:
    gain = f"(({p} + {q}) / ({p} + {q} + {r}))"
    return f"({x} + {gain} * ({z} - {x}))", f"((1 - {gain}) * ({p} + {q}))"


_x0, _p0 = kalman_step("0::DOUBLE", "1::DOUBLE", "z", "1e-5::DOUBLE", "1e-3::DOUBLE")
_x, _p = kalman_step("k.x", "k.p", "s.z", "1e-5::DOUBLE", "1e-3::DOUBLE")
KALMAN = f"""
WITH RECURSIVE s AS ({SEQ}), k AS (
  SELECT user_id, event_id, n, {_x0} AS x, {_p0} AS p FROM s WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.n, {_x}, {_p} FROM k JOIN s ON s.user_id = k.user_id AND s.n = k.n + 1)
"""


@query(f"{KALMAN} SELECT event_id, round(x, 6) AS x, round(p, 9) AS p FROM k")
def kalman1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01."""
    out = filters.kalman(events(spark, sf_dir), "user_id", ORDER, "value")
    return out.select("event_id", F.round("x", 6).alias("x"), F.round("p", 9).alias("p"))


@query(f"{KALMAN} SELECT user_id, round(arg_max(x, n), 6) AS x, round(arg_max(p, n), 9) AS p FROM k GROUP BY user_id")
def kalman_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-03: the last state of each tag, natively."""
    out = filters.final_state(events(spark, sf_dir), "user_id", ORDER, "value")
    return out.select("user_id", F.round("x", 6).alias("x"), F.round("p", 9).alias("p"))


_a0, _b0 = kalman_step("0::DOUBLE", "1::DOUBLE", "x", "1e-6::DOUBLE", "5e-3::DOUBLE")
_a1, _b1 = kalman_step("c.x2", "c.p2", "k.x", "1e-6::DOUBLE", "5e-3::DOUBLE")
@query(
    f"""{KALMAN}, c AS (
  SELECT user_id, event_id, n, {_a0} AS x2, {_b0} AS p2 FROM k WHERE n = 1
  UNION ALL
  SELECT k.user_id, k.event_id, k.n, {_a1}, {_b1} FROM c JOIN k ON k.user_id = c.user_id AND k.n = c.n + 1)
SELECT event_id, round(x2, 6) AS x FROM c"""
)
def kalman2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FLT-05."""
    return filters.two_stage(events(spark, sf_dir), "user_id", ORDER, "value").select("event_id", F.round("x", 6).alias("x"))


STAGES = """CASE WHEN user_id % 2 = 0 THEN 1e-4::DOUBLE ELSE 1e-5 END AS q1, CASE WHEN user_id % 2 = 0 THEN 1e-2::DOUBLE ELSE 1e-3 END AS r1,
  CASE WHEN user_id % 2 = 0 THEN 1e-6::DOUBLE ELSE 1e-5 END AS q2, CASE WHEN user_id % 2 = 0 THEN 5e-3::DOUBLE ELSE 1e-2 END AS r2"""
_c0, _d0 = kalman_step("0::DOUBLE", "1::DOUBLE", "z", "q1", "r1")
_c1, _d1 = kalman_step("k.x", "k.p", "s.z", "s.q1", "s.r1")
_e0, _f0 = kalman_step("0::DOUBLE", "1::DOUBLE", "x", "q2", "r2")
_e1, _f1 = kalman_step("c.x2", "c.p2", "k.x", "k.q2", "k.r2")


@query(
    f"""WITH RECURSIVE s AS (SELECT *, {STAGES} FROM ({SEQ})), k AS (
  SELECT user_id, event_id, n, q2, r2, {_c0} AS x, {_d0} AS p FROM s WHERE n = 1
  UNION ALL SELECT s.user_id, s.event_id, s.n, s.q2, s.r2, {_c1}, {_d1} FROM k JOIN s ON s.user_id = k.user_id AND s.n = k.n + 1),
c AS (SELECT user_id, event_id, n, {_e0} AS x2, {_f0} AS p2 FROM k WHERE n = 1
  UNION ALL SELECT k.user_id, k.event_id, k.n, {_e1}, {_f1} FROM c JOIN k ON k.user_id = c.user_id AND k.n = c.n + 1)
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'pressure' ELSE 'flow' END AS class, x2::FLOAT AS x FROM c"""
)
def kalman_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: stage settings by a tag's class (here user_id mod 2)."""
    rows = events(spark, sf_dir).withColumn("class", F.when(F.col("user_id") % 2 == 0, "pressure").otherwise("flow"))
    out = filters.two_stage_by_class(rows, "user_id", ORDER, "value", "class", {"pressure": {"first": (1e-4, 1e-2, 1.0)}, "flow": {"second": (1e-5, 1e-2, 1.0)}})
    return out.select("event_id", "class", F.col("x").cast("float").alias("x"))


@query(
    """WITH RECURSIVE g AS (
  SELECT 1::BIGINT AS n, (1 + 1e-5::DOUBLE) / (1 + 1e-5::DOUBLE + 1e-3::DOUBLE) AS gain, (1 - (1 + 1e-5::DOUBLE) / (1 + 1e-5::DOUBLE + 1e-3::DOUBLE)) * (1 + 1e-5::DOUBLE) AS p
  UNION ALL
  SELECT n + 1, (p + 1e-5::DOUBLE) / (p + 1e-5::DOUBLE + 1e-3::DOUBLE), (1 - (p + 1e-5::DOUBLE) / (p + 1e-5::DOUBLE + 1e-3::DOUBLE)) * (p + 1e-5::DOUBLE) FROM g WHERE n < 90)
SELECT n, round(gain, 9) AS gain, round(p, 9) AS p FROM g"""
)
def kalman_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06."""
    return rounded(filters.gains(spark, 90), "gain", "p", digits=9)


@query("SELECT i::BIGINT AS step, round(100::DOUBLE * pow(0.001::DOUBLE, i / 4.0::DOUBLE), 9) AS beta FROM range(5) t(i)")
def anneal_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07."""
    return rounded(filters.schedule(spark), "beta", digits=9)


@query(
    """SELECT event_id, round(1 / (1 + exp((least(value / (2 * 17.78279410038923::DOUBLE), 50) - 6.907755278982137::DOUBLE / 17.78279410038923::DOUBLE))), 6) AS weight FROM events"""
)
def anneal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: the weight of a squared residual at the second temperature."""
    return events(spark, sf_dir).select("event_id", F.round(filters.weight(F.col("value"), 17.78279410038923), 6).alias("weight"))


def _annealed(k: int) -> str:
    """SQL for the weight of a squared residual ``chi2`` at step ``k`` of the schedule."""
    beta = repr(rec.annealing_schedule()[k])
    inside, outside = f"exp(-least(chi2 / (2 * {beta}::DOUBLE), 50))", f"exp(-least(-2 * ln(0.001::DOUBLE) / (2 * {beta}::DOUBLE), 50))"
    return f"{inside} / ({inside} + {outside})"


def _anneal_step(rows: str) -> str:
    """SQL for one step over ``rows`` with columns ``x0, ahead, z`` beside the ids."""
    weights = ", ".join(f"{_annealed(k)} AS w{k + 1}" for k in range(4))
    settled = "CASE WHEN abs(w1 - 1) < 1e-3 THEN w1 WHEN abs(w2 - w1) < 1e-3 THEN w2 WHEN abs(w3 - w2) < 1e-3 THEN w3 ELSE w4 END"
    gain = "ahead * w / (ahead * w + 400)"
    return f"""SELECT user_id, event_id, n, x0 + {gain} * (z - x0) AS x, (1 - {gain}) * ahead AS p, w FROM (SELECT *, {settled} AS w FROM (SELECT *, {weights} FROM (SELECT *, (z - x0) * (z - x0) / (ahead + 400) AS chi2 FROM ({rows}))))"""


@query(
    f"""WITH RECURSIVE s AS ({SEQ}), k AS (
  {_anneal_step("SELECT *, 0::DOUBLE AS x0, 10001::DOUBLE AS ahead FROM s WHERE n = 1")}
  UNION ALL
  {_anneal_step("SELECT s.*, k.x AS x0, k.p + 1 AS ahead FROM k JOIN s ON s.user_id = k.user_id AND s.n = k.n + 1")})
SELECT event_id, x::FLOAT AS x, w::FLOAT AS weight, w < 0.1 AS outlier FROM k"""
)
def daf_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08 to FLT-10."""
    out = filters.annealed(events(spark, sf_dir), "user_id", ORDER, "value", q=1.0, r=400.0, p0=1e4)
    return out.select("event_id", F.col("x").cast("float").alias("x"), F.col("weight").cast("float").alias("weight"), (F.col("outlier") > 0).alias("outlier"))


@query(
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
w AS (SELECT user_id, p, value, unnest(range(greatest(0, (p - 32) // 16 + 1 - CASE WHEN p < 32 AND (p - 32) % 16 <> 0 THEN 1 ELSE 0 END), p // 16 + 1)) AS window_id FROM s),
g AS (SELECT user_id, window_id, count(*) AS n, sum(value) AS total FROM w WHERE p >= window_id * 16 AND p < window_id * 16 + 32 GROUP BY ALL)
SELECT user_id, window_id::BIGINT AS window_id, n, round(total, 4) AS total FROM g WHERE n = 32 OR window_id = 0 OR n > 16"""
)
def daf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, FLT-13, WIN-07: overlapping windows, partial last one included."""
    held = filters.windows(events(spark, sf_dir), "user_id", ORDER, "value")
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
    return held.select("user_id", "window_id", F.col("n").cast("long").alias("n"), F.round(total, 4).alias("total"))


def _annealed_windows(spark: SparkSession, sf_dir: str, shared: bool) -> DataFrame:
    out = filters.annealed_windows(events(spark, sf_dir), "user_id", ORDER, "value", r=400.0, q=1.0, p0=1e4, shared=shared)
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    return out.select("user_id", "window_id", "n", "n_outliers", "converged", "iterations", F.round(total, 6).alias("weight"))


@query(transform_sql.window_annealing(32, 16, 1.0, 400.0, 1e4, rec.annealing_schedule()[:4], shared=False))
def daf_window_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, each value against its own cut."""
    return _annealed_windows(spark, sf_dir, shared=False)


@query(transform_sql.window_annealing(32, 16, 1.0, 400.0, 1e4, rec.annealing_schedule()[:4], shared=True))
def daf_window_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, all values against the joint sum."""
    return _annealed_windows(spark, sf_dir, shared=True)


EWMA = f"""
WITH RECURSIVE s AS ({SEQ}), k AS (
  SELECT user_id, event_id, n, z, z AS m, 1::DOUBLE AS v FROM s WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.event_id, s.n, s.z, 0.05::DOUBLE * s.z + 0.95::DOUBLE * k.m, 0.05::DOUBLE * (s.z - k.m) * (s.z - k.m) + 0.95::DOUBLE * k.v
  FROM k JOIN s ON s.user_id = k.user_id AND s.n = k.n + 1)
"""


@query(f"""{EWMA} SELECT event_id, m::FLOAT AS mean, v::FLOAT AS variance, (CASE WHEN n >= 20 THEN (z - m) / sqrt(v) ELSE 0 END)::FLOAT AS z,
  CASE WHEN n >= 20 THEN abs((z - m) / sqrt(v)) > 3 ELSE false END AS flag FROM k""")
def ewma_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, WIN-03."""
    out = features.baseline(events(spark, sf_dir), "user_id", ORDER, "value", min_window=20)
    return out.select("event_id", *(F.col(c).cast("float").alias(c) for c in ("mean", "variance", "z")), (F.col("flag") > 0).alias("flag"))


@query(f"{EWMA} SELECT event_id, (m - 3 * sqrt(v))::FLOAT AS lower, (m + 3 * sqrt(v))::FLOAT AS upper FROM k")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04."""
    out = features.baseline(events(spark, sf_dir), "user_id", ORDER, "value")
    return out.select("event_id", F.col("lower").cast("float").alias("lower"), F.col("upper").cast("float").alias("upper"))


@query(f"""{EWMA} SELECT event_id, m::FLOAT AS mean, v::FLOAT AS variance, (CASE WHEN n >= 20 THEN (z - m) / sqrt(v) ELSE 0 END)::FLOAT AS z FROM k""")
def ewma_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02, WIN-03, cut into weeks, for tags too long for one task."""
    out = segments.baseline(events(spark, sf_dir), "user_id", ORDER, "value", week(), min_window=20)
    return out.select("event_id", *(F.col(c).cast("float").alias(c) for c in ("mean", "variance", "z")))


@query(ORACLES["kalman2"].replace("round(x2, 6)", "x2::FLOAT"))
def kalman_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FLT-06, cut into weeks, for tags too long for one task."""
    out = segments.two_stage(events(spark, sf_dir), "user_id", ORDER, "value", week())
    return out.select("event_id", F.col("x").cast("float").alias("x"))


@query(
    """WITH st AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd FROM events GROUP BY event_type),
g AS (SELECT *, k, (lo - (hi - lo) * 0.1::DOUBLE) + k * ((hi + (hi - lo) * 0.1::DOUBLE) - (lo - (hi - lo) * 0.1::DOUBLE)) / 99.0::DOUBLE AS x, sd * pow(n::DOUBLE, -0.2::DOUBLE) AS bw FROM st, (SELECT unnest(range(100))::INT AS k))
SELECT g.event_type, g.k, round(any_value(x), 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - e.value) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) AS density
FROM g JOIN events e ON e.event_type = g.event_type GROUP BY g.event_type, g.k"""
)
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11."""
    out = features.density(events(spark, sf_dir), "event_type", "value")
    return out.select("event_type", F.col("point").alias("k"), F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(
    """WITH s AS (SELECT user_id, event_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n,
  avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING) AS m, stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING) AS sd,
  avg(value) OVER (PARTITION BY user_id) AS gm, stddev_pop(value) OVER (PARTITION BY user_id) AS gs FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, max(CASE WHEN rn = 60 THEN m END) OVER (PARTITION BY user_id) AS fm, max(CASE WHEN rn = 60 THEN sd END) OVER (PARTITION BY user_id) AS fs FROM s)
SELECT event_id, (CASE WHEN n < 60 THEN gm WHEN rn < 60 THEN fm ELSE m END)::FLOAT AS mean, (CASE WHEN n < 60 THEN gs WHEN rn < 60 THEN fs ELSE sd END)::FLOAT AS std FROM f"""
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, AGG-01."""
    out = features.rolling(events(spark, sf_dir), ["user_id"], list(ORDER), "value", "value")
    return out.select("event_id", F.col("value_rolling_mean").cast("float").alias("mean"), F.col("value_rolling_std").cast("float").alias("std"))


@query(ORACLES["rolling_stats"])
def rolling_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, cut into segments, for tags too long for one task."""
    out = segments.rolling(events(spark, sf_dir), "user_id", list(ORDER), "value", "value", week())
    return out.select("event_id", F.col("value_rolling_mean").cast("float").alias("mean"), F.col("value_rolling_std").cast("float").alias("std"))


@query("SELECT event_id, (avg(value) OVER w)::FLOAT AS window_mean, count(value) OVER w AS window_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 10079 PRECEDING)")
def window_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05."""
    out = features.running_window_mean(events(spark, sf_dir), "user_id", list(ORDER), "value")
    return out.select("event_id", F.col("window_mean").cast("float").alias("window_mean"), "window_n")


@query(
    """SELECT l_orderkey, l_linenumber, round(a, 6) AS abundance, round(greatest(0, a - 1.5), 6) AS lower_bound, round(least(100, a + 1.5), 6) AS upper_bound
FROM (SELECT *, least(greatest(95 + 3 * (1 - l_quantity / 200.0::DOUBLE) - 2 * ((l_extendedprice / 5000.0::DOUBLE) / 15.0::DOUBLE - 1), 0), 100) AS a FROM lineitem)"""
)
def soft_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEN-01 to SEN-03."""
    out = lines(spark, sf_dir).withColumn("a", features.abundance(F.col("l_quantity"), F.col("l_extendedprice") / 5000.0))
    lo, hi = features.abundance_bounds(F.col("a"))
    return out.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("abundance"), F.round(lo, 6).alias("lower_bound"), F.round(hi, 6).alias("upper_bound"))


@query(
    """SELECT event_id, CASE WHEN n < 60 THEN 50 ELSE round(least(greatest(95 + 3 * (1 - t / 200.0::DOUBLE) - 2 * (p / 15.0::DOUBLE - 1), 0), 100), 9) END::DOUBLE AS abundance
FROM (SELECT event_id, avg(value) OVER w AS t, avg(event_id % 20) OVER w AS p, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING))"""
)
def lookback_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06."""
    rows = events(spark, sf_dir).withColumn("p", F.col("event_id") % 20)
    return features.lookback_abundance(rows, "user_id", list(ORDER), "value", "p").select("event_id", F.round("abundance", 9).alias("abundance"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as multi-source readings of a line (user_id mod 4), with a delay per source."""
    sources = spark.createDataFrame([("click", 0, 1), ("view", 1000, 2), ("signup", 0, 3), ("purchase", -500, 4), ("error", 0, 5)], "source string, delay_ns long, priority int")
    rows = events(spark, sf_dir).select((F.col("user_id") % 4).alias("line"), F.col("event_type").alias("source"), (micros() * 1000).alias("ntp_ns"), "event_id")
    return align.keyed(rows, sources)


BUNDLES = """
WITH e AS (SELECT user_id % 4 AS line, event_type AS source, epoch_us(ts) * 1000 + CASE event_type WHEN 'view' THEN 1000 WHEN 'purchase' THEN -500 ELSE 0 END AS aligned_ns FROM events),
w AS (SELECT line, aligned_ns, count(DISTINCT source) OVER f AS k, count(*) OVER f AS n_events FROM e WINDOW f AS (PARTITION BY line ORDER BY aligned_ns RANGE BETWEEN 7200000000000 PRECEDING AND CURRENT ROW)),
b AS (SELECT DISTINCT line, aligned_ns, n_events FROM w WHERE k = 5)
"""


@query(f"{BUNDLES} SELECT * FROM b")
def align_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-05, ALN-01: a spread of two hours."""
    return align.bundles(aligned(spark, sf_dir), ["line"], "aligned_ns", "source", 5, 7_200_000_000_000)


@query(
    f"""{BUNDLES.replace("WITH e AS", "WITH RECURSIVE e AS")}, g AS (SELECT line, min(aligned_ns) AS at_ns FROM b GROUP BY line
  UNION ALL SELECT g.line, (SELECT min(b.aligned_ns) FROM b WHERE b.line = g.line AND b.aligned_ns > g.at_ns + 7200000000000) FROM g WHERE g.at_ns IS NOT NULL)
SELECT b.* FROM b JOIN g ON g.line = b.line AND g.at_ns = b.aligned_ns"""
)
def align_bundles_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN-01, bundles that do not overlap."""
    return align.bundles(aligned(spark, sf_dir), ["line"], "aligned_ns", "source", 5, 7_200_000_000_000, non_overlapping=True)


@query(f"{BUNDLES} SELECT (SELECT count(*) FROM e) AS fed, (SELECT count(*) FROM b) AS bundles, (SELECT count(*) FROM b) / (SELECT count(*) FROM e)::DOUBLE AS rate")
def align_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN-04."""
    rows = aligned(spark, sf_dir)
    return align.alignment_rate(rows, align.bundles(rows, ["line"], "aligned_ns", "source", 5, 7_200_000_000_000))


@query("SELECT event_type AS source, count(*) AS depth, count(*) > 1000 AS over_limit FROM events GROUP BY event_type")
def pool_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN-03."""
    return align.pool_depth(events(spark, sf_dir).withColumnRenamed("event_type", "source"), "source")


def window_pairs(readings: DataFrame, n: int = 40) -> DataFrame:
    """Each window of ``n`` values of a user beside the next, ``key (user_id, window), a, b``; the last may be shorter.

    A user with one window has a row whose ``b`` is null.
    """
    place = F.row_number().over(filters.Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    rows = readings.withColumn("place", place).withColumn("window", F.floor(F.col("place") / n))
    held = rows.groupBy("user_id", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"]).alias("a"))
    pairs = held.withColumn("b", F.lead("a").over(filters.Window.partitionBy("user_id").orderBy("window")))
    return pairs.filter("b is not null or window = 0").select("user_id", "window", "a", "b")


@query(transform_sql.warping(40, 10))
def dtw_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALN-05 to ALN-07: each window of 40 values of a user against the next, over the whole history, in a band; null where there is no next."""
    pairs = window_pairs(events(spark, sf_dir)).withColumn("key", F.concat_ws("/", "user_id", "window"))
    met = align.dtw(pairs.filter("b is not null"), "key", "a", "b", window=10).select("key", F.round("distance", 4).alias("distance"), F.round("lag_mean", 6).alias("lag_mean"), F.round("lag_std", 6).alias("lag_std"), "steps")
    return pairs.select("user_id", "window", "key").join(met, "key", "left").drop("key")


@query(
    """SELECT event_id, last_known FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_known FROM events) WHERE event_type = 'purchase'"""
)
def as_of_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error value known at each purchase of a user."""
    rows = events(spark, sf_dir)
    out = align.as_of(rows.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), rows.filter("event_type = 'error'").select("user_id", "ts", "value"), ["user_id"], "ts", "value")
    return out.select("event_id", F.col("asof_value").alias("last_known"))


GAPS = """
WITH d AS (SELECT l_returnflag AS k, l_extendedprice::FLOAT AS v, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT *, v - lag(v) OVER (PARTITION BY k ORDER BY v) AS gap FROM d),
r AS (SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY gap DESC NULLS LAST, v DESC) <= 15 AS cut FROM g),
c AS (SELECT *, sum(cut::INT) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING)::INT AS code FROM r),
q AS (SELECT *, ((min(v) OVER (PARTITION BY k, code) + max(v) OVER (PARTITION BY k, code)) / 2.0::FLOAT)::FLOAT AS centre, sum(n) OVER (PARTITION BY k, code)::BIGINT AS cnt FROM c)
"""


@query(f"{GAPS} SELECT DISTINCT k AS l_returnflag, code, round(centre::DOUBLE, 3) AS centre, cnt FROM q")
def quantize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-01, CMP-02, CMP-07, AGG-02."""
    out = quantize.dictionary(lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice", 4)
    return out.select("l_returnflag", "code", F.round(F.col("centre").cast("double"), 3).alias("centre"), "cnt").distinct()


@query(
    f"""{GAPS} SELECT k AS l_returnflag, sum(n)::BIGINT AS n, count(DISTINCT code) AS clusters, round(sqrt(sum(n * pow(v::DOUBLE - centre::DOUBLE, 2)) / sum(n)), 4) AS rms_error,
  (ceil(sum(n) * 4 / 8.0) + 8 * count(DISTINCT code))::BIGINT AS stored_bytes, round((ceil(sum(n) * 4 / 8.0) + 8 * count(DISTINCT code)) / (sum(n) * 4.0::DOUBLE), 8) AS ratio FROM q GROUP BY k"""
)
def quantize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-03, AGG-03."""
    out = quantize.statistics(lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice", 4)
    return rounded(rounded(out, "rms_error", digits=4), "ratio", digits=8)


@query(f"{GAPS} SELECT l_orderkey, l_linenumber, code, round(centre::DOUBLE, 3) AS restored FROM lineitem JOIN q ON q.k = l_returnflag AND q.v = l_extendedprice::FLOAT")
def quantize_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-05."""
    out = quantize.encode(lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice", 4)
    return out.select("l_orderkey", "l_linenumber", "code", F.round(F.col("centre").cast("double"), 3).alias("restored"))


@query("SELECT event_id, (ntile(8) OVER (PARTITION BY event_type ORDER BY value, event_id) - 1)::INT AS bin FROM events")
def quantize_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-04."""
    return quantize.equal_frequency(events(spark, sf_dir).withColumn("by", F.struct("value", "event_id")), ["event_type"], "by", 8, quantize.value_bucket(F.col("value"))).select("event_id", "bin")


@query(
    """WITH b AS (SELECT event_id, event_type, value::FLOAT AS v, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 1024)::BIGINT AS block FROM events),
d AS (SELECT DISTINCT event_type, block, v FROM b),
g AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type, block ORDER BY v) AS gap FROM d),
r AS (SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY event_type, block ORDER BY gap DESC NULLS LAST, v DESC) <= 255 AS cut FROM g),
c AS (SELECT *, sum(cut::INT) OVER (PARTITION BY event_type, block ORDER BY v ROWS UNBOUNDED PRECEDING)::INT AS code FROM r)
SELECT b.event_id, b.block, c.code FROM b JOIN c USING (event_type, block, v)"""
)
def block_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-06, WIN-08."""
    return quantize.blocks(events(spark, sf_dir), "event_type", ORDER, "value", bucket=week()).select("event_id", "block", "code")


@query(
    """SELECT vec_id, len(p) AS size, list_sum(list_transform(p, lambda x, i: x * i))::FLOAT AS weighted FROM (SELECT vec_id, list_transform([1, 6, 7, 11, 12, 13, 16, 17, 18, 19, 21, 22, 23, 24, 25], lambda i: embedding[i]::DOUBLE) AS p FROM embeddings)"""
)
def tri_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-08: the first 25 components as a 5 x 5 matrix; the packed terms weighted by their place."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("embedding", i * 5 + 1, F.lit(5)))
    packed = quantize.lower_triangle(rows)
    weighted = F.aggregate(F.transform(packed, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(packed).cast("long").alias("size"), weighted.cast("float").alias("weighted"))


@query(
    """SELECT vec_id, round(sum(x), 5) AS total FROM (SELECT vec_id, embedding[(greatest(i, j) * 5 + least(i, j) + 1)::INT]::DOUBLE AS x FROM embeddings, range(5) a(i), range(5) b(j)) GROUP BY vec_id"""
)
def tri_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-08 back: the sum over the whole symmetric matrix."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("embedding", i * 5 + 1, F.lit(5)))
    full = quantize.full_matrix(quantize.lower_triangle(rows), 5)
    total = F.aggregate(F.flatten(full), F.lit(0.0), lambda a, b: a + b.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 5).alias("total"))


@query("SELECT vec_id, 22 AS size, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[25]::DOUBLE, 6) AS last_cov FROM embeddings")
def state_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, CMP-08."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("embedding", i * 5 + 1, F.lit(5)))
    packet = quantize.state_packet(F.slice("embedding", 1, 5), rows, F.lit(1.7e9))
    out = table(spark, sf_dir, "embeddings").select("vec_id", packet.alias("p"))
    return out.select("vec_id", F.size("p").alias("size"), F.round(F.get("p", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.get("p", F.lit(19)).cast("double"), 6).alias("last_cov"))


WIDE = {"PT-301": "l_tax * 10", "PT-302": "l_discount * 30", "FT-301": "l_quantity", "FT-302": "l_quantity / 5", "FT-303": "l_tax - 0.04", "TE-301": "-180 - l_discount * 50", "TE-310": "-175 - l_tax * 20", "FV-301": "l_linenumber"}


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", *(F.expr(e).cast("double").alias(t) for t, e in WIDE.items()))


@query(
    """WITH w AS (SELECT l_suppkey, l_orderkey, l_linenumber, (l_tax * 10)::DOUBLE AS p1, (l_discount * 30)::DOUBLE AS p2, l_quantity AS f1, l_quantity / 5 AS f2, l_tax - 0.04::DOUBLE AS f3, -180 - l_discount * 50 AS t1, -175 - l_tax * 20 AS t10, l_linenumber::DOUBLE AS v1 FROM lineitem),
f AS (SELECT *, p2 - p1 AS dp, f2 / CASE WHEN abs(f3) < 1e-6 THEN 1e-6::DOUBLE ELSE f3 END AS rr FROM w)
SELECT l_orderkey, l_linenumber, round(dp, 5) + 0.0 AS delta_p, round(rr, 2) + 0.0 AS reflux_ratio, round(t10 - t1, 5) + 0.0 AS temp_gradient, round(dp * rr, 2) + 0.0 AS dp_x_reflux, round(dp * f1, 4) + 0.0 AS dp_x_flow, round(t1 * v1, 4) + 0.0 AS temp_x_valve FROM f"""
)
def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-01 to FEA-03, FEA-05, FEA-06."""
    groups = ("pressure_drop", "reflux_ratio", "temperature_gradient", "interaction_terms")
    out = features.features(wide(spark, sf_dir), ["l_suppkey"], ["l_orderkey", "l_linenumber"], groups).drop("l_suppkey")
    digits = {"delta_p": 5, "reflux_ratio": 2, "temp_gradient": 5, "dp_x_reflux": 2, "dp_x_flow": 4, "temp_x_valve": 4}
    return out.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n,
  avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS 59 PRECEDING) AS m, l_suppkey, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS gm FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)),
f AS (SELECT *, max(CASE WHEN rn = 60 THEN m END) OVER (PARTITION BY l_suppkey) AS fm FROM s)
SELECT l_orderkey, l_linenumber, (CASE WHEN n < 60 THEN gm WHEN rn < 60 THEN fm ELSE m END)::FLOAT AS flow_mean FROM f"""
)
def features_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-04: rolling statistics of three tags; the flow's mean is compared."""
    out = features.features(wide(spark, sf_dir), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], ("rolling_statistics",))
    return out.select("l_orderkey", "l_linenumber", F.col("`FT-301_rolling_mean`").cast("float").alias("flow_mean"))


@query("SELECT event_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS \"view\" FROM events GROUP BY event_id")
def pivot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEA-06: long readings to a column per tag."""
    return features.pivot_tags(events(spark, sf_dir), "event_id", "event_type", "value", ["click", "view"])


PHYSICS = """
WITH z AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, (l_discount * 30 - 1.25) / 0.75 AS a, (l_quantity / 5 - 4.25) / 1.75 AS b, (-l_tax * 100 + 3) / 2.0 AS c, (l_discount * 30 / 2.0) / greatest(l_quantity / 50.0, 0.01) - 1 AS d FROM lineitem)
"""


def physics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    parts = features.indicators(F.col("l_discount") * 30, F.col("l_quantity") / 5, -F.col("l_tax") * 100, F.col("l_quantity"))
    return lines(spark, sf_dir), parts


@query(f"{PHYSICS} SELECT l_orderkey, l_linenumber, round(s, 6) AS score, round(s, 6) > 3 AS anomalous, round(d, 6) + 0.0 AS flooding_index FROM (SELECT *, 0.35 * abs(a) + 0.25 * abs(b) + 0.25 * abs(c) + 0.15 * abs(d) AS s FROM z)")
def physics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-01 to DET-04, AGG-10."""
    rows, parts = physics(spark, sf_dir)
    score = F.round(features.physics_score(parts), 6)
    return rows.select("l_orderkey", "l_linenumber", score.alias("score"), features.is_anomalous(score).alias("anomalous"), F.round(parts["flooding_index"], 6).alias("flooding_index"))


@query(
    f"""{PHYSICS}, r AS (SELECT rid, l_orderkey, l_linenumber, unnest([{{'i': 1, 'n': 'dp_deviation', 'z': a}}, {{'i': 2, 'n': 'reflux_deviation', 'z': b}}, {{'i': 3, 'n': 'temp_gradient_deviation', 'z': c}}, {{'i': 4, 'n': 'flooding_index', 'z': d}}]) AS x FROM z)
SELECT l_orderkey, l_linenumber, coalesce(string_agg(x.n || ': ' || CASE WHEN x.z > 0 THEN 'high' ELSE 'low' END, '; ' ORDER BY round(abs(x.z), 9) DESC, x.i) FILTER (round(abs(x.z), 9) > 1), '') AS explained FROM r GROUP BY rid, l_orderkey, l_linenumber"""
)
def physics_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DET-05: which indicators deviate, in order (the printed figures are cut off for the comparison)."""
    rows, parts = physics(spark, sf_dir)
    texts = features.explanations({n: F.round(z, 9) for n, z in parts.items()})
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform(texts, lambda t: F.regexp_replace(t, " deviation \\(.*", "")), "; ").alias("explained"))


def series(spark: SparkSession, sf_dir: str, n: int = 256) -> DataFrame:
    """Blocks of ``n`` values per event type, in order; a shorter rest is joined to the block before it, if there is one."""
    return blocks(events(spark, sf_dir), n)


def blocks(readings: DataFrame, n: int) -> DataFrame:
    counts = readings.groupBy("event_type").agg(F.greatest(F.floor(F.count("*") / n) - 1, F.lit(0)).alias("last")).withColumnRenamed("event_type", "__type")
    placed = segments.numbered(readings, "event_type", ORDER, week()).withColumn("place", F.col(segments.PLACE) - 1)
    rows = placed.join(counts, F.col("event_type").eqNullSafe(F.col("__type")))
    rows = rows.withColumn("block", F.least(F.floor(F.col("place") / n), F.col("last")))
    held = rows.groupBy("event_type", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"]).alias("signal"))
    return held.withColumn("name", F.concat_ws("/", "event_type", "block"))


def _values(blocks: DataFrame) -> DataFrame:
    """Signals as rows: ``event_type, block, place, value``."""
    spread = blocks.select("event_type", F.col("block").cast("long").alias("block"), F.posexplode("signal").alias("place", "value"))
    return spread.withColumns({"place": F.col("place").cast("long"), "value": F.round("value", 4)})


@query(transform_sql.denoising({None: ("db4", 3, "universal")}))
def wavelet_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV-01 to WAV-07."""
    return _values(transforms.denoise(series(spark, sf_dir), "signal", level=3, clip=True))


#: Signal classes of event types.
CLASSES = {"click": "pressure", "view": "flow", "signup": "temperature", "purchase": "valve"}


@query(transform_sql.denoising({**{k: fixed.WAVELET_CLASSES[c] for k, c in CLASSES.items()}, None: ("db4", 2, "universal")}))
def wavelet_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV-08: settings by signal class."""
    kinds = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    rows = series(spark, sf_dir).withColumn("class", F.try_element_at(kinds, F.col("event_type")))
    return _values(transforms.denoise(rows, "signal", fixed.WAVELET_CLASSES, "class", clip=True))


@query(
    """SELECT event_id, round(s * sqrt(2 * ln(n)), 6) AS universal, round(s * sqrt(ln(n)), 6) AS sure,
  round(CASE WHEN sqrt(greatest(v - s * s, 0)) < 1e-15 THEN s * sqrt(2 * ln(n)) ELSE s * s / sqrt(greatest(v - s * s, 0)) END, 6) AS bayes
FROM (SELECT event_id, value / 100 AS s, 256.0::DOUBLE AS n, 0.09::DOUBLE AS v FROM events)"""
)
def wavelet_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WAV-05 as an expression."""
    s, n, v = F.col("value") / 100, F.lit(256.0), F.lit(0.09)
    return events(spark, sf_dir).select("event_id", *(F.round(transforms.threshold_column(s, n, v, m), 6).alias(m) for m in ("universal", "sure", "bayes")))


@query(transform_sql.scalograms(16))
def scalogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-01 to SCL-03."""
    out = transforms.scalogram(series(spark, sf_dir), "name", "signal", 16, logged=True)
    return out.select("name", "scale", F.round("freq", 9).alias("freq"), F.round(F.array_max("magnitudes"), 6).alias("peak"))


@query("SELECT p AS pos, d::INT AS dim, round(CASE WHEN d % 2 = 0 THEN sin(p * exp((d - d % 2) * (-ln(10000.0::DOUBLE) / 16))) ELSE cos(p * exp((d - d % 2) * (-ln(10000.0::DOUBLE) / 16))) END, 9) AS value FROM range(50) a(p), range(16) b(d)")
def position_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NN-01."""
    return rounded(transforms.positions(spark, 50, 16), "value", digits=9)


SIM = """
WITH RECURSIVE a AS (SELECT 0::BIGINT AS episode, 0.8::DOUBLE AS f, 1.0::DOUBLE AS r, 1.0::DOUBLE AS d UNION ALL SELECT 1, 1.0, 1.0, 1.0 UNION ALL SELECT 2, 1.2, 0.5, 1.4),
s AS (SELECT episode, 0::BIGINT AS step, 50::DOUBLE AS feed, 4::DOUBLE AS reflux, 120::DOUBLE AS duty, 97::DOUBLE AS ab FROM a
  UNION ALL
  SELECT s.episode, step + 1, feed + (f * 50 - feed) / 10, reflux + (r * 4 - reflux) / 10, duty + (d * 120 - duty) / 10,
    least(100, greatest(0, ab + ((97 - 0.5 * (2 * ((reflux + (r * 4 - reflux) / 10) / 4 - 1) - 1.5 * ((duty + (d * 120 - duty) / 10) / 120 - 1))) - ab) / 45))
  FROM s JOIN a ON a.episode = s.episode WHERE step < 60)
SELECT episode, step, round(feed, 6) AS feed, round(reflux, 6) AS reflux, round(duty, 6) AS duty, round(1.2 + 0.5 * (feed / 50 - 1) - 0.3 * (reflux / 4 - 1), 6) AS dp, round(ab, 6) AS abundance,
  round(CASE WHEN ab BETWEEN 95 AND 100 THEN 1 ELSE 0 END - 0.1, 6)::DOUBLE AS reward FROM s WHERE step > 0
"""


@query(SIM)
def column_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL-01, RL-02, without noise."""
    starts = simulate.initial(spark, 3)
    mult = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("episode") + 1).cast("int"))
    starts = starts.withColumns({"feed_mult": mult(0.8, 1.0, 1.2), "reflux_mult": mult(1.0, 1.0, 0.5), "duty_mult": mult(1.0, 1.0, 1.4)})
    out = simulate.trajectories(starts, 60)
    names = ("feed", "reflux", "duty", "dp", "abundance", "reward")
    return rounded(out.select("episode", "step", *names), *names)


ROLLOUT = "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount * 30 > 2.5 THEN -1 WHEN 94 + l_tax * 30 < 95 THEN -0.5 * (1 - pow(0.99::DOUBLE, 50)) / 0.01 ELSE 0.1 * (1 - pow(0.99::DOUBLE, 50)) / 0.01 END, 6) AS value FROM lineitem"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = simulate.rollout_value(F.col("l_discount") * 30, F.lit(94) + F.col("l_tax") * 30)
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"))


@query(ROLLOUT)
def rollout_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL-03, RL-04."""
    return rollouts(spark, sf_dir)


@query(f"SELECT 100::BIGINT AS visits, max(value) AS best_value, round(avg(value), 6) AS mean_value FROM ({ROLLOUT})")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15."""
    return rounded(simulate.search_statistics(rollouts(spark, sf_dir), "value"), "mean_value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage filter, moving baseline and route of every event: the shortest way from sample to alarm."""
    from ..operators import safety

    smooth = filters.two_stage(events(spark, sf_dir), "user_id", ORDER, "value").select("user_id", "ts", "event_id", "x")
    scored = features.baseline(smooth, "user_id", ORDER, "x", min_window=20)
    severity = F.least(F.floor(F.abs("z")), F.lit(4)).cast("int")
    routed = scored.select("event_id", F.col("x").cast("float").alias("x"), F.col("z").cast("float").alias("z"), (F.col("user_id") % 50).cast("int").alias("device_type"), (F.col("event_id") % 2000).cast("int").alias("sensor_id"), severity.alias("severity"))
    rules = spark.createDataFrame([(1, 3, None, None, False), (2, 3, 101, 0, True)], safety.RULES)
    return safety.guard(routed, rules)


@query(
    f"""{KALMAN}, c AS (
  SELECT user_id, event_id, n, {_a0} AS x2, {_b0} AS p2 FROM k WHERE n = 1
  UNION ALL SELECT k.user_id, k.event_id, k.n, {_a1}, {_b1} FROM c JOIN k ON k.user_id = c.user_id AND k.n = c.n + 1),
w AS (SELECT user_id, event_id, n, x2, x2 AS m, 1::DOUBLE AS v FROM c WHERE n = 1
  UNION ALL SELECT c.user_id, c.event_id, c.n, c.x2, 0.05::DOUBLE * c.x2 + 0.95::DOUBLE * w.m, 0.05::DOUBLE * (c.x2 - w.m) * (c.x2 - w.m) + 0.95::DOUBLE * w.v FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1),
z AS (SELECT event_id, x2, CASE WHEN n >= 20 THEN (x2 - m) / sqrt(v) ELSE 0 END AS z, (user_id % 50)::INT AS device_type, (event_id % 2000)::INT AS sensor_id FROM w),
y AS (SELECT *, least(floor(abs(z)), 4)::INT AS severity, NOT (device_type = 3 AND NOT (sensor_id = 101 AND least(floor(abs(z)), 4) = 0)) AS allowed FROM z)
SELECT event_id, x2::FLOAT AS x, z::FLOAT AS z, device_type, sensor_id, severity, allowed, CASE WHEN NOT allowed THEN 'block' WHEN severity <= 0 THEN 'pass' ELSE 'llm' END AS route FROM y"""
)
def alarm_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over its whole table."""
    return flagship(spark, sf_dir)


#: Recurrences by name, for streams.
RECURRENCES = {"kalman": rec.kalman(), "cascade": rec.kalman_cascade(), "annealed": rec.annealed_kalman(), "ewma": rec.ewma()}
