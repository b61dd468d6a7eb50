"""Feature frame: direction, event labels, weather, day flags,
interactions, one-hot match columns and targets, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.functions import features as fx
from panelflow.functions.text import direction_of
from panelflow.functions.timecols import floor_hour
from panelflow.operators import intervals



def add_direction(df: DataFrame, description_col: str = "ntis_link_description") -> DataFrame:
    """Direction class; ``unknown`` when the frame has no description."""
    if description_col not in df.columns:
        return df.withColumn("direction", F.lit("unknown"))
    return df.withColumn("direction", direction_of(F.col(description_col)))


def join_weather(df: DataFrame, weather: DataFrame, ts_col: str = "datetime",
                 weather_ts: str = "datetime") -> DataFrame:
    """Left equi-join on the floored hour; rows without weather pass
    through with NULLs.  AQE broadcasts the weather side from its measured
    size; the series is read afresh on each call."""
    renamed = weather.withColumnRenamed(weather_ts, "_w_hour")
    out = df.withColumn("_w_hour", floor_hour(ts_col)).join(renamed, "_w_hour", "left")
    return out.drop("_w_hour")


def feature_frame(hourly: DataFrame, windows: DataFrame, weather: DataFrame | None = None,
                  ts_col: str = "datetime") -> DataFrame:
    """hourly -> direction -> last-writer labels (half-open windows) ->
    weather -> day flags -> hour and interactions -> one-hot -> targets."""
    df = add_direction(hourly)
    df = intervals.label_last_writer(df, windows, ts_col, closed="left")
    if weather is not None:
        df = join_weather(df, weather, ts_col)
    df = fx.add_day_flags(df)
    df = fx.add_targets(df, ts_col=ts_col)
    df = fx.add_interactions(df)
    return fx.one_hot_match(df, drop=False)
