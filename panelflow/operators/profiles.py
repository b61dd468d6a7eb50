"""Typical profiles and distribution statistics.

Grouped statistics are single hash aggregates (partial + final); exact
percentiles use ``percentile`` (NumPy's linear interpolation) with an
opt-in approximate mode.  Per-hour outputs are completed against a
24-hour spine (a fixed 24-row table, broadcast by construction).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.features import day_type_label
from panelflow.functions.numeric import clip, safe_div
from panelflow.operators.quantiles import quantile_columns

TYPICAL_KEYS = ["ntis_link_number", "ntis_link_description", "direction", "hour", "day_type",
                "start_latitude", "start_longitude", "end_latitude", "end_longitude", "link_length"]
TYPICAL_METRICS = ["total_traffic_flow", "speed_reduction", "journey_delay",
                   "traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct"]
COUNT_COLS = ["traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3", "traffic_flow_value4"]
PCT_COLS = ["traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct"]


def _pct(x: str, probs, approx: bool) -> Column:
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile_approx(x, arr, 10000) if approx else F.percentile(x, arr)


def typical_profile(df: DataFrame, keys=TYPICAL_KEYS, metrics=TYPICAL_METRICS, approx: bool = False) -> DataFrame:
    """Per key combination: mean, std (sample), min, max, p05, p95 of each
    metric.  Rows with a NULL key are dropped (as a grouping that skips
    missing keys)."""
    d = df.withColumn("day_type", day_type_label()) if "day_type" not in df.columns else df
    d = d.dropna(subset=list(keys))
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
                 _pct(m, (0.05, 0.95), approx).alias(f"_{m}_p")]
    g = d.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[c for m in metrics for c in (
        F.col(f"{m}_mean"), F.col(f"{m}_std"), F.col(f"{m}_min"), F.col(f"{m}_max"),
        F.col(f"_{m}_p")[0].alias(f"{m}_p05"), F.col(f"_{m}_p")[1].alias(f"{m}_p95"))])


def metric_summary(df: DataFrame, columns=None, suffix: str = "_mean", approx: bool = False, by=()) -> DataFrame:
    """For every ``*_mean`` column (or the given ones): min, max, mean,
    std, p5/25/50/75/95 and non-null count, one row per metric (long form
    via unpivot, then one grouped aggregate).  A metric spans all rows, so
    its exact quantiles come from the distributed ``exact_quantiles``.
    ``by`` (columns of a small domain, as the direction) gives one such
    table per group; rows with a NULL there are left out."""
    by = list(by)
    cols = columns or [c for c in df.columns if c.endswith(suffix)]
    d = df.dropna(subset=by) if by else df
    long = d.select(
        *by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "metric", "value")
    keys = [*by, "metric"]
    names = ["p5", "p25", "p50", "p75", "p95"]
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    g = long.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.count("value").alias("count"))
    if approx:
        q = long.groupBy(*keys).agg(_pct("value", probs, True).alias("_p")).select(
            *keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    else:
        q = quantile_columns(long, "value", probs, names, by=keys)
    return g.join(q, keys, "left").select(*keys, "min", "max", "mean", "std", *names, "count")


def condition_rows(df: DataFrame, conditions) -> DataFrame:
    """Each row once per condition it meets (conditions may overlap):
    ``conditions`` is a list of (name, boolean column)."""
    arr = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions]),
                   lambda x: x.isNotNull())
    return df.withColumn("condition", F.explode(arr))


DAY_CONDITION_NAMES = ("weekday", "weekend", "school_holiday")


def day_conditions():
    """weekday (neither flag), weekend, school holiday (may overlap weekend)."""
    return [
        ("weekday", (F.col("is_weekend") == 0) & (F.col("is_school_holiday") == 0)),
        ("weekend", F.col("is_weekend") == 1),
        ("school_holiday", F.col("is_school_holiday") == 1),
    ]


def hour_spine(spark, names) -> DataFrame:
    rows = [(n, h) for n in names for h in range(24)]
    return F.broadcast(spark.createDataFrame(rows, "condition string, hour int"))


def exclude_match_periods(df: DataFrame) -> DataFrame:
    out = df
    for flag in ("is_pre_match", "is_post_match"):
        if flag in df.columns:
            out = out.where(F.coalesce(F.col(flag) == 0, F.lit(True)))
    return out


NETWORK_METRICS = ("total_traffic_flow", "speed_reduction", "normalized_time")


def segment_hour_stats(df: DataFrame, key: str = "segment_id", metrics=NETWORK_METRICS) -> DataFrame:
    """Per (condition, hour, key) outside match periods: mean, std and count
    of each metric (one hash aggregate)."""
    d = condition_rows(exclude_match_periods(df).where(F.col(key).isNotNull() & F.col("hour").isNotNull()),
                       day_conditions())
    return d.groupBy("condition", "hour", key).agg(*[c for m in metrics for c in (
        F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_count"))])


def network_hourly(df: DataFrame, key: str = "segment_id",
                   metrics=(("total_traffic_flow", "flow"), ("speed_reduction", "speed"),
                            ("normalized_time", "time"))) -> DataFrame:
    """Network-wide hourly profile per day condition: per (condition,
    hour, key) means, then mean and std across keys of those means and the
    number of keys; every hour 0-23 present (n_segments 0 when empty).
    weekday/weekend always appear, school_holiday only when it has rows."""
    d = condition_rows(exclude_match_periods(df).where(F.col(key).isNotNull() & F.col("hour").isNotNull()),
                       day_conditions())
    per_key = d.groupBy("condition", "hour", key).agg(*[F.avg(m).alias(m) for m, _ in metrics])
    net = per_key.groupBy("condition", "hour").agg(
        *[c for m, short in metrics for c in (F.avg(m).alias(f"{short}_mean"), F.stddev_samp(m).alias(f"{short}_std"))],
        F.count(F.lit(1)).alias("n_segments"))
    # 24-hour spine for all three conditions (a 72-row literal), then drop
    # the school-holiday rows when that condition has no data at all: the
    # test runs over the small joined table, not over the input again
    spine = hour_spine(df.sparkSession, DAY_CONDITION_NAMES)
    out = spine.join(net, ["condition", "hour"], "left")
    has_sh = F.max(F.when((F.col("condition") == "school_holiday") & F.col("n_segments").isNotNull(), 1)
                   ).over(Window.partitionBy())
    out = (out.withColumn("_has_sh", has_sh)
              .where((F.col("condition") != "school_holiday") | F.col("_has_sh").isNotNull()).drop("_has_sh"))
    # +-1 std band around the network mean (plot bounds)
    out = out.withColumns({c: F.col(f"{short}_mean") + sign * F.col(f"{short}_std")
                           for _, short in metrics
                           for c, sign in ((f"{short}_lo", F.lit(-1.0)), (f"{short}_hi", F.lit(1.0)))})
    return out.withColumn("n_segments", F.coalesce("n_segments", F.lit(0).cast("long")))


def vehicle_mix_hourly(df: DataFrame, pct_cols=PCT_COLS, count_cols=COUNT_COLS) -> DataFrame:
    """Per condition and hour: mean, std and count of each share and each
    count column, plus a 95 % band of the share mean (mean +- 1.96 std /
    sqrt(max(n, 1)), clipped to [0, 100]).  24 rows per condition."""
    d = condition_rows(df.where(F.col("hour").isNotNull()), day_conditions())
    aggs = []
    for c in list(count_cols) + list(pct_cols):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_count")]
    g = d.groupBy("condition", "hour").agg(*aggs)
    bands = {}
    for c in pct_cols:
        se = safe_div(F.col(f"{c}_std"), F.sqrt(F.greatest(F.col(f"{c}_count"), F.lit(1)).cast("double")))
        bands[f"{c}_lo"] = clip(F.col(f"{c}_mean") - F.lit(1.96) * se, 0.0, 100.0)
        bands[f"{c}_hi"] = clip(F.col(f"{c}_mean") + F.lit(1.96) * se, 0.0, 100.0)
    g = g.withColumns(bands)
    spine = hour_spine(df.sparkSession, DAY_CONDITION_NAMES)
    out = spine.join(g, ["condition", "hour"], "left")
    # an hour without rows has count 0 (means and stds stay NULL)
    return out.withColumns({f"{c}_count": F.coalesce(F.col(f"{c}_count"), F.lit(0).cast("long"))
                            for c in list(count_cols) + list(pct_cols)})


def hourly_means(df: DataFrame, cols=COUNT_COLS, by=("hour",)) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


def vehicle_share_total(df: DataFrame, cols=COUNT_COLS) -> DataFrame:
    """Total per class and its share of the sum over all classes."""
    tot = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
    long = tot.unpivot([], list(cols), "vehicle_class", "total")
    # grand total over the 4-row long table (a window, not a second pass)
    grand = F.sum("total").over(Window.partitionBy())
    return long.select("vehicle_class", "total", (safe_div(F.col("total"), grand) * 100).alias("share_pct"))


def describe(df: DataFrame, cols, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles, max per column (exact quartiles
    from the distributed ``exact_quantiles``: a column spans all rows)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    g = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    names = ["q25", "q50", "q75"]
    if approx:
        q = long.groupBy("column").agg(_pct("value", (0.25, 0.5, 0.75), True).alias("_q")).select(
            "column", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        q = quantile_columns(long, "value", [0.25, 0.5, 0.75], names, by=["column"])
    return g.join(q, "column", "left").select("column", "count", "mean", "std", "min", *names, "max")


def histogram(df: DataFrame, col: str, bins: int = 30, by=()) -> DataFrame:
    """Equal-width histogram over non-missing values: bounds from a one-row
    aggregate (broadcast), bucket = width_bucket clamped so the maximum
    falls in the last bin.  Constant data -> one bin."""
    d = df.where(F.col(col).isNotNull())
    bounds = d.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = d.join(F.broadcast(bounds), list(by)) if by else d.crossJoin(F.broadcast(bounds))
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.width_bucket(F.col(col), F.col("_lo"), F.col("_hi"), F.lit(bins)), F.lit(bins))
               ).otherwise(F.lit(1))
    g = j.withColumn("bin", b.cast("int")).groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return g.select(*by, "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("_lo") + F.col("bin") * width).alias("bin_hi"), "count")


def auto_bins(df: DataFrame, col: str) -> DataFrame:
    """Number of equal bins by the narrower of two rules, Sturges' and
    Freedman-Diaconis': one row with ``lo``, ``hi``, ``bins``."""
    d = df.where(F.col(col).isNotNull())
    q = quantile_columns(d, col, [0.25, 0.75], ["q1", "q3"])
    st = d.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(q))
    span, n = F.col("hi") - F.col("lo"), F.col("n").cast("double")
    sturges = safe_div(span, F.log2(n) + 1)
    fd = F.lit(2.0) * (F.col("q3") - F.col("q1")) / F.cbrt(n)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return st.select("lo", "hi", F.when(span > 0, F.ceil(span / width)).otherwise(F.lit(1)).cast("int").alias("bins"))


def auto_histogram(df: DataFrame, col: str) -> DataFrame:
    """Histogram with ``auto_bins``; the maximum falls in the last bin."""
    j = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(auto_bins(df, col)))
    place = F.floor(safe_div(F.col(col) - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("bins")) + 1
    b = F.coalesce(F.least(place, F.col("bins")), F.lit(1)).cast("int")
    g = j.withColumn("bin", b).groupBy("bin", "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return g.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (F.col("lo") + F.col("bin") * width).alias("bin_hi"), "count")


def boxplot_stats(df: DataFrame, col: str, by=("hour",), k: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at the most extreme
    values within q1 - k*IQR .. q3 + k*IQR, and the outlier count.  Made for
    few and large groups (hours, conditions: at most 72 groups), so
    quartiles come from the distributed ``exact_quantiles`` and their table
    is broadcast: no shuffle puts an hour's rows into one task."""
    d = df.where(F.col(col).isNotNull())
    q = quantile_columns(d, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=list(by))
    j = d.join(F.broadcast(q), list(by))
    lo = F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))
    v = F.col(col)
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def kde_on_grid(df: DataFrame, col: str, grid_points: int = 50) -> DataFrame:
    """Gaussian kernel density on an even grid (Scott's bandwidth) over all
    values.  Equal values are counted first, so each distinct value meets
    the ``grid_points`` grid rows (a fixed, broadcast table) once; sums are
    combined before the shuffle, which carries one row per grid point and
    task.  Without a spread of values the density is NULL."""
    values = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v"))
                .agg(F.count(F.lit(1)).alias("_w")))
    st = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"),
                F.stddev_samp(col).alias("_sd"))
    step = safe_div(F.col("_hi") - F.col("_lo"), F.lit(float(max(grid_points - 1, 1))))
    grid = st.select("_n", (F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_bw"),
                     F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid_points - 1)),
                                           lambda g: F.struct(g.cast("long").alias("i"),
                                                              (F.col("_lo") + step * g).alias("x")))).alias("_g"))
    grid = grid.where(F.col("_n") > 0).select("_n", "_bw", "_g.i", "_g.x")
    z = safe_div(F.col("x") - F.col("_v"), F.col("_bw"))
    dens = safe_div(F.col("_w") * F.exp(F.lit(-0.5) * z * z), F.col("_bw") * F.lit((2 * math.pi) ** 0.5))
    g = values.crossJoin(F.broadcast(grid)).groupBy("i", "x", "_n").agg(F.sum(dens).alias("_s"))
    return g.select("i", "x", (F.col("_s") / F.col("_n")).alias("density"))
