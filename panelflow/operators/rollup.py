"""Time roll-ups and gap handling (hourly aggregation, gap filter,
resample with forward fill)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelflow.functions.numeric import first_non_null, safe_div
from panelflow.functions.timecols import floor_hour

FLOW_SUM_COLS = ["total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2",
                 "traffic_flow_value3", "traffic_flow_value4"]
MEAN_COLS = ["fused_travel_time", "fused_average_speed"]


def hourly_rollup(df: DataFrame, keys=("segment_id",), ts_col: str = "datetime",
                  sum_cols=FLOW_SUM_COLS, mean_cols=MEAN_COLS, first_cols=(),
                  order_col: str = "row_seq", full_count: int = 4) -> DataFrame:
    """One row per key and hour.

    Sums (all-missing -> 0), means, first non-missing value of attribute
    columns (by ``order_col``), ``data_completeness`` = readings in the hour
    and ``is_interpolated`` = completeness < ``full_count``.

    Raw rows meet only hash aggregation with map-side partial aggregation:
    a "first" of a string needs a variable-width buffer, which would force
    a sort-based aggregate over the raw input, so string attributes are
    made grouping keys of a first level (with fixed-width buffers: sums,
    counts, earliest order) and resolved on its small output, where every
    row of a (key, hour, attributes) group shares the attribute values.
    """
    d = df.withColumn("_hour", floor_hour(ts_col))
    types = dict(d.dtypes)
    str_first = [c for c in first_cols if types[c] == "string"]
    num_first = [c for c in first_cols if c not in str_first]
    o = F.col(order_col)
    if not str_first:
        aggs = ([F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sum_cols]
                + [F.avg(c).alias(c) for c in mean_cols]
                + [first_non_null(c, order_col).alias(c) for c in num_first]
                + [F.count(F.lit(1)).alias("data_completeness")])
        out = d.groupBy(*keys, "_hour").agg(*aggs)
    else:
        lvl1 = d.groupBy(*keys, "_hour", *str_first).agg(
            *[F.sum(c).alias(f"_s_{c}") for c in sum_cols],
            *[x for c in mean_cols for x in (F.sum(c).alias(f"_ms_{c}"), F.count(c).alias(f"_mc_{c}"))],
            *[x for c in num_first for x in (first_non_null(c, order_col).alias(f"_f_{c}"),
                                              F.min(F.when(F.col(c).isNotNull(), o)).alias(f"_fo_{c}"))],
            F.min(o).alias("_o"), F.count(F.lit(1)).alias("_n"))
        out = lvl1.groupBy(*keys, "_hour").agg(
            *[F.coalesce(F.sum(f"_s_{c}"), F.lit(0.0)).alias(c) for c in sum_cols],
            *[safe_div(F.sum(f"_ms_{c}"), F.sum(f"_mc_{c}")).alias(c) for c in mean_cols],
            *[F.min_by(f"_f_{c}", f"_fo_{c}").alias(c) for c in num_first],
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in str_first],
            F.sum("_n").alias("data_completeness"))
        out = out.select(*keys, "_hour", *sum_cols, *mean_cols, *first_cols, "data_completeness")
    return (out.withColumn("is_interpolated", (F.col("data_completeness") < full_count).cast("int"))
               .withColumnRenamed("_hour", ts_col))


def gap_hours(df: DataFrame, keys=("segment_id",), ts_col: str = "datetime") -> DataFrame:
    """Hours since the previous row of the same key (NULL on the first).

    The window is partitioned by key over the *hourly* table, so a key
    holds at most one row per hour of the covered span (8,784 a year)
    however large the raw data is.
    """
    w = Window.partitionBy(*keys).orderBy(ts_col)
    prev = F.lag(ts_col).over(w)
    diff = F.timestamp_diff("SECOND", prev, F.col(ts_col)) / F.lit(3600.0)
    return df.withColumn("time_diff", diff)


def gap_filter(df: DataFrame, keys=("segment_id",), ts_col: str = "datetime",
               max_gap_hours: float = 6) -> DataFrame:
    """Drop the row that follows a gap of more than ``max_gap_hours``; the
    first row of each key is kept."""
    return (gap_hours(df, keys, ts_col)
            .where(F.coalesce(F.col("time_diff"), F.lit(0.0)) <= F.lit(float(max_gap_hours)))
            .drop("time_diff"))


def hour_spine(df: DataFrame, ts_col: str = "datetime", step: str = "1 hour", by=()) -> DataFrame:
    """Every hour from the first to the last hour of ``df`` (of each series).
    Its size is the covered span, not the data volume."""
    bounds = df.groupBy(*by).agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi"))
    return bounds.select(*by, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias(ts_col))


def forward_fill(df: DataFrame, cols, ts_col: str = "datetime", by=(), chunk: str = "MM") -> DataFrame:
    """Each column carried forward from its last non-missing value, per series.

    A series is cut into chunks of time.  Inside a chunk a running window
    carries values on; what a chunk starts with is the last value of an
    earlier one, from a window over one row per chunk.  So no window is longer
    than a chunk's rows, however long the series or however few there are."""
    by = list(by)
    d = df.withColumn("_chunk", F.trunc(F.col(ts_col).cast("date"), chunk))
    last = d.groupBy(*by, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts_col))).alias(f"_last{i}") for i, c in enumerate(cols)])
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_b{i}" for i in range(len(by))]
    carried = last.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_chunk").alias("_at"), *[
        F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_carry{i}") for i in range(len(cols))])
    same = F.col("_chunk") == F.col("_at")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    within = Window.partitionBy(*by, "_chunk").orderBy(ts_col).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_carry{i}")) for i, c in enumerate(cols)}
    return d.join(carried, same).select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def resample_hourly(df: DataFrame, ts_col: str = "datetime", mean_cols=(), mode_cols=(),
                    rename=None, ffill: bool = True, by=()) -> DataFrame:
    """Hourly resample of a series (with ``by``: of each series): means, mode
    (lowest value on a tie), every empty hour between first and last present,
    then each column carried forward from its last non-missing value."""
    rename, by = rename or {}, list(by)
    aggs = ([F.avg(c).alias(rename.get(c, c)) for c in mean_cols]
            + [F.mode(c, deterministic=True).alias(rename.get(c, c)) for c in mode_cols])
    hourly = df.withColumn("_hour", floor_hour(ts_col)).groupBy(*by, "_hour").agg(*aggs)
    hourly = hourly.withColumnRenamed("_hour", ts_col)
    spine = hour_spine(hourly, ts_col, by=by)
    if by:
        same = F.col(f"_s.{ts_col}") == F.col(f"_h.{ts_col}")
        for c in by:
            same = same & F.col(f"_s.{c}").eqNullSafe(F.col(f"_h.{c}"))
        out = spine.alias("_s").join(hourly.alias("_h"), same, "left").select(
            "_s.*", *[f"_h.`{c}`" for c in hourly.columns if c not in (*by, ts_col)])
    else:
        out = spine.join(hourly, ts_col, "left")
    if ffill:
        cols = [rename.get(c, c) for c in list(mean_cols) + list(mode_cols)]
        out = forward_fill(out.select(*by, ts_col, *cols), cols, ts_col, by)
    return out
