"""Feature engineering, soft sensor, anomaly scores and adaptive baselines (FEA, SEN, DET, WIN, AGG-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recurrences as rec
from ..functions.sizes import small_side
from .scan import scan

#: Feature groups, in column order, and the tags whose rolling statistics are taken.
GROUPS = ("pressure_drop", "reflux_ratio", "temperature_gradient", "rolling_statistics", "interaction_terms")
ROLLING_TAGS = ("PT-301", "FT-301", "TE-301")


def pivot_tags(long: DataFrame, seq: str, tag: str, value: str, tags: Sequence[str]) -> DataFrame:
    """Long readings to one column per tag (a fixed list, so no extra pass finds the tags)."""
    return long.groupBy(seq).pivot(tag, list(tags)).agg(F.first(value))


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, name: str, window: int = 60) -> DataFrame:
    """WIN-01, AGG-01: trailing mean and population deviation; adds ``{name}_rolling_mean`` and ``_std``.

    The first ``window - 1`` rows take the first full window's values; a series shorter than the window takes
    its global ones.
    """
    part = Window.partitionBy(*keys)
    ordered = part.orderBy(*order)
    trailing = ordered.rowsBetween(-(window - 1), 0)
    x = F.col(value) if isinstance(value, str) else value
    out = df.withColumn("__x", x.cast("double")).withColumn("__rn", F.row_number().over(ordered)).withColumn("__n", F.count("*").over(part))
    for part_name, f in (("mean", F.avg), ("std", F.stddev_pop)):
        own = f"__{part_name}"
        out = out.withColumn(own, f("__x").over(trailing))
        lead = F.max(F.when(F.col("__rn") == window, F.col(own))).over(part)
        whole = f("__x").over(part)
        out = out.withColumn(f"{name}_rolling_{part_name}", F.when(F.col("__n") < window, whole).when(F.col("__rn") < window, lead).otherwise(F.col(own))).drop(own)
    return out.drop("__x", "__rn", "__n")


def _tag(df: DataFrame, tag: str, default: float) -> Column:
    return F.coalesce(F.col(f"`{tag}`").cast("double"), F.lit(default)) if tag in df.columns else F.lit(float(default))


def delta_p(df: DataFrame, top: str = "PT-301", bottom: str = "PT-302") -> Column:
    """FEA-01: bottom minus top pressure, 0 if a tag has no column."""
    return _tag(df, bottom, 0.0) - _tag(df, top, 0.0) if top in df.columns and bottom in df.columns else F.lit(0.0)


def reflux_ratio(df: DataFrame) -> Column:
    """FEA-02: FT-302 over FT-303 (1 where it has no column), the divisor kept away from 0."""
    below = _tag(df, "FT-303", 1.0)
    return _tag(df, "FT-302", 0.0) / F.when(F.abs(below) < 1e-6, F.lit(1e-6)).otherwise(below)


def temperature_gradient(df: DataFrame) -> Column:
    """FEA-03: TE-310 minus TE-301; a tag without a column counts as 0."""
    return _tag(df, "TE-310", 0.0) - _tag(df, "TE-301", 0.0)


def feature_names(groups: Sequence[str] = GROUPS) -> list[str]:
    """FEA-06: the feature columns of the enabled groups, in order."""
    names = {
        "pressure_drop": ["delta_p"],
        "reflux_ratio": ["reflux_ratio"],
        "temperature_gradient": ["temp_gradient"],
        "rolling_statistics": [f"{t}_rolling_{s}" for t in ROLLING_TAGS for s in ("mean", "std")],
        "interaction_terms": ["dp_x_reflux", "dp_x_flow", "temp_x_valve"],
    }
    return [n for g in GROUPS if g in groups for n in names[g]]


def features(wide: DataFrame, keys: Sequence[str], order: Sequence[str], groups: Sequence[str] = GROUPS, window: int = 60) -> DataFrame:
    """FEA-01 to FEA-06: ``keys, order`` and the enabled features of a wide frame (a column per tag)."""
    if not wide.columns or not groups or not set(groups) <= set(GROUPS):
        raise ValueError(f"enable at least one of the feature groups {GROUPS}")
    dp, rr = delta_p(wide), reflux_ratio(wide)
    flow, valve = _tag(wide, "FT-301", 1.0), _tag(wide, "FV-301", 1.0)
    made = {"delta_p": dp, "reflux_ratio": rr, "temp_gradient": temperature_gradient(wide), "dp_x_reflux": dp * rr, "dp_x_flow": dp * flow, "temp_x_valve": _tag(wide, "TE-301", 1.0) * valve}
    names = feature_names(groups)
    out = wide
    if "rolling_statistics" in groups:
        for tag in ROLLING_TAGS:
            out = rolling(out, keys, order, _tag(wide, tag, 0.0), tag, window)
    return out.select(*keys, *order, *((made[n].alias(n) if n in made else F.col(f"`{n}`")) for n in names))


# soft sensor


def abundance(temperature: Column, pressure: Column) -> Column:
    """SEN-01, SEN-02: linear surrogate, cut to 0-100; 50 where an input is missing."""
    base = F.lit(95.0) + F.lit(3.0) * (F.lit(1.0) - temperature / 200.0) - F.lit(2.0) * (pressure / 15.0 - F.lit(1.0))
    # least and greatest skip nulls, so a missing input is told apart first
    return F.when(base.isNull(), F.lit(50.0)).otherwise(F.least(F.greatest(base, F.lit(0.0)), F.lit(100.0)))


def abundance_bounds(estimate: Column, margin: float = 1.5) -> tuple[Column, Column]:
    """SEN-03: the margin around an estimate, inside 0-100."""
    return F.greatest(F.lit(0.0), estimate - margin), F.least(F.lit(100.0), estimate + margin)


def lookback_abundance(df: DataFrame, key: str, order: Sequence[str], temperature: str, pressure: str, window: int = 60) -> DataFrame:
    """WIN-06: the surrogate on the mean of the last ``window`` rows, 50 until there are as many."""
    trailing = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    estimate = abundance(F.avg(temperature).over(trailing), F.avg(pressure).over(trailing))
    full = F.count("*").over(trailing) >= window
    return df.withColumn("abundance", F.when(full, estimate).otherwise(F.lit(50.0)))


# physics-based detector

#: Nominal ranges, defaults of missing inputs and weights of the four indicators.
RANGES = {"dp": (0.5, 2.0), "reflux_ratio": (2.5, 6.0), "temp_gradient": (-5.0, -1.0)}
DEFAULTS = {"dp": 1.0, "reflux_ratio": 4.0, "temp_gradient": -3.0, "flow_rate": 50.0}
WEIGHTS = {"dp_deviation": 0.35, "reflux_deviation": 0.25, "temp_gradient_deviation": 0.25, "flooding_index": 0.15}
DP_MAX, FLOW_NOMINAL, N_SIGMA = 2.0, 50.0, 3.0


def range_z(value: Column, lo: float, hi: float) -> Column:
    """DET-01: distance from the middle of a range in half spans, 0 for an empty range."""
    half = (hi - lo) / 2.0
    return (value - F.lit((lo + hi) / 2.0)) / F.lit(half) if half else F.lit(0.0)


def flooding_index(dp: Column, flow: Column) -> Column:
    """DET-02: relative pressure drop over relative flow, less 1."""
    return (dp / DP_MAX) / F.greatest(flow / FLOW_NOMINAL, F.lit(0.01)) - F.lit(1.0)


def indicators(dp: Column, reflux: Column, gradient: Column, flow: Column) -> dict[str, Column]:
    """The four indicators by name; null inputs take their defaults."""
    dp, reflux, gradient, flow = (F.coalesce(c, F.lit(d)) for c, d in zip((dp, reflux, gradient, flow), DEFAULTS.values()))
    return {"dp_deviation": range_z(dp, *RANGES["dp"]), "reflux_deviation": range_z(reflux, *RANGES["reflux_ratio"]), "temp_gradient_deviation": range_z(gradient, *RANGES["temp_gradient"]), "flooding_index": flooding_index(dp, flow)}


def physics_score(parts: dict[str, Column]) -> Column:
    """DET-03, AGG-10: weighted sum of absolute indicators."""
    total = F.lit(0.0)
    for name, z in parts.items():
        total = total + F.lit(WEIGHTS[name]) * F.abs(z)
    return total


def is_anomalous(score: Column) -> Column:
    """DET-04."""
    return score > N_SIGMA


def explanations(parts: dict[str, Column]) -> Column:
    """DET-05: texts of indicators beyond 1, the largest first, ties in the order of the indicators."""
    items = F.array(*(F.struct((-F.abs(z)).alias("by"), F.lit(k).alias("k"), F.lit(name).alias("name"), z.alias("z")) for k, (name, z) in enumerate(parts.items())))
    telling = F.filter(F.array_sort(items), lambda x: F.abs(x["z"]) > 1.0)
    side = lambda x: F.when(x["z"] > 0, "high").otherwise("low")
    figure = lambda x: x["z"].cast("decimal(24,2)").cast("string")  # noqa: E731  faster than a format
    return F.transform(telling, lambda x: F.concat(x["name"], F.lit(": "), side(x), F.lit(" deviation (z="), figure(x), F.lit(")")))


# adaptive baseline


def baseline(df: DataFrame, key: str, order: Sequence[str], value: str, **params) -> DataFrame:
    """WIN-02 to WIN-05: adds ``mean, variance, z, flag, lower, upper`` of the moving baseline."""
    return scan(df, key, order, value, rec.ewma(**params))


def density(df: DataFrame, key: str, value: str, points: int = 100, least: int = 10) -> DataFrame:
    """AGG-11: Gaussian kernel density per key on a padded grid: ``key, point, x, density``.

    The bandwidth is population deviation times ``n ** -0.2``.  Keys with fewer than ``least`` values get the
    unit grid with density 1; equal values only have no bandwidth and a null density.  Equal values are counted first, so the work is grid points times distinct values.
    """
    rows = df.select(F.col(key), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd"))
    pad = (F.col("hi") - F.col("lo")) * 0.1
    stats = stats.withColumn("bw", F.nullif("sd", F.lit(0.0)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    counted = rows.groupBy(key, "v").agg(F.count("*").alias("c"))
    # the grid is spread per value and summed before the shuffle, so a key with most values is no hot spot
    met = counted.join(small_side(stats), key).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.when(F.col("n") < least, F.col("point") / F.lit(float(points - 1))).otherwise((F.col("lo") - pad) + F.col("point") * ((F.col("hi") + pad) - (F.col("lo") - pad)) / F.lit(float(points - 1)))
    met = met.withColumn("x", at)
    sums = met.groupBy(key, "point", "x", "n", "bw").agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col("v")) / F.col("bw"), F.lit(2.0)))).alias("s"))
    dens = F.col("s") / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2.0 * 3.141592653589793)))
    return sums.select(key, "point", "x", F.when(F.col("n") < least, F.lit(1.0)).otherwise(dens).alias("density"))


def running_window_mean(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = 10_080) -> DataFrame:
    """WIN-05: mean and count over a bounded trailing window."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("window_mean", F.avg(value).over(w)).withColumn("window_n", F.count(value).over(w))
