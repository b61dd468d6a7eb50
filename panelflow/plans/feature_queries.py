"""Registered queries: weather, feature frame, profiles and
distribution statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.operators import features as feat
from panelflow.operators import profiles, rollup
from panelflow.plans import catalog as base
from panelflow.plans.registry import query, round_floats
from panelflow.session import cut_lineage, input_signature, memo_plan, memo_small
from panelflow.sources import testdata as td

FEATURE_COLS = ["segment_id", "datetime", "direction", "match_period", "match_team", "temperature",
                "weather_code", "wind_speed", "is_weekend", "is_school_holiday", "hour", "hour_weekend",
                "hour_school_holiday", "speed_mph", "traffic_1_pct", "traffic_2_pct", "traffic_3_pct",
                "traffic_4_pct", "speed_reduction", "normalized_time", "journey_delay", "is_pre_match",
                "is_post_match", "is_no_match_period", "is_united_match", "is_city_match", "is_no_match_team"]


def weather(spark, sf):
    """Hourly weather series (small: one row per hour of the span),
    materialized once per input version."""
    def build():
        w = rollup.resample_hourly(td.weather_raw(spark, sf), mean_cols=["temperature_2m", "wind_speed_10m"],
                                   mode_cols=["weather_code"],
                                   rename={"temperature_2m": "temperature", "wind_speed_10m": "wind_speed"})
        return cut_lineage(w)
    return memo_small(spark, ("weather", sf, input_signature(spark, f"{sf}/events.parquet")), build)


def feature_frame(spark, sf):
    def build():
        first_cols = [c for c in td.FIRST_COLS if c not in ("road", "carriageway")]
        h = rollup.gap_filter(base.hourly(spark, sf, "user40", base.ROLLUP_FULL, first_cols), max_gap_hours=base.GAP_HOURS)
        return feat.feature_frame(h, base.windows(spark, sf), weather(spark, sf))
    return memo_plan(spark, ("features", sf, base.events_signature(spark, sf)), build)


@query("weather_resample_ffill")
def q_weather(spark, sf):
    return round_floats(weather(spark, sf))


@query("weather_by_station")
def q_weather_by_station(spark, sf):
    """The hourly series of 40 stations, each filled from its own values."""
    w = td.weather_raw(spark, sf, station=True)
    return round_floats(rollup.resample_hourly(w, mean_cols=["temperature_2m", "wind_speed_10m"], mode_cols=["weather_code"], by=["station"]))


@query("features")
def q_features(spark, sf):
    return round_floats(feature_frame(spark, sf).select(*FEATURE_COLS))


@query("typical_profile")
def q_typical_profile(spark, sf):
    return round_floats(profiles.typical_profile(feature_frame(spark, sf)))


@query("metric_summary")
def q_metric_summary(spark, sf):
    return round_floats(profiles.metric_summary(profiles.typical_profile(feature_frame(spark, sf))))


@query("network_hourly")
def q_network_hourly(spark, sf):
    return round_floats(profiles.network_hourly(feature_frame(spark, sf)))


@query("vehicle_mix_hourly")
def q_vehicle_mix_hourly(spark, sf):
    return round_floats(profiles.vehicle_mix_hourly(feature_frame(spark, sf)))


@query("vehicle_share_total")
def q_vehicle_share_total(spark, sf):
    return round_floats(profiles.vehicle_share_total(feature_frame(spark, sf)))


@query("hourly_vehicle_counts")
def q_hourly_vehicle_counts(spark, sf):
    return round_floats(profiles.hourly_means(feature_frame(spark, sf)))


@query("describe_flows")
def q_describe_flows(spark, sf):
    return round_floats(profiles.describe(feature_frame(spark, sf),
                                          ["total_traffic_flow"] + profiles.COUNT_COLS))


@query("histogram30")
def q_histogram30(spark, sf):
    return round_floats(profiles.histogram(feature_frame(spark, sf), "total_traffic_flow", 30))


@query("boxplot_hourly")
def q_boxplot_hourly(spark, sf):
    return round_floats(profiles.boxplot_stats(feature_frame(spark, sf), "total_traffic_flow", ("hour",)))


@query("boxplot_condition_hourly")
def q_boxplot_condition_hourly(spark, sf):
    d = profiles.condition_rows(feature_frame(spark, sf), profiles.day_conditions())
    return round_floats(profiles.boxplot_stats(d, "traffic_1_pct", ("condition", "hour")))


@query("kde_density")
def q_kde(spark, sf):
    return round_floats(profiles.kde_on_grid(feature_frame(spark, sf), "speed_reduction", 50))


@query("day_flags")
def q_day_flags(spark, sf):
    from panelflow.functions.features import day_type_label
    f = feature_frame(spark, sf)
    return f.select("segment_id", "datetime", "is_weekend", "is_school_holiday", "hour", "hour_weekend",
                    "hour_school_holiday", day_type_label().alias("day_type"))


@query("onehot_match")
def q_onehot_match(spark, sf):
    return feature_frame(spark, sf).select(
        "segment_id", "datetime", "match_period", "match_team", "is_pre_match", "is_post_match",
        "is_no_match_period", "is_united_match", "is_city_match", "is_no_match_team")


@query("speed_delay_targets")
def q_speed_delay_targets(spark, sf):
    return round_floats(feature_frame(spark, sf).select(
        "segment_id", "datetime", "speed_mph", "traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct",
        "speed_reduction", "normalized_time", "journey_delay"))


@query("metric_summary_by_direction")
def q_metric_summary_by_direction(spark, sf):
    return round_floats(profiles.metric_summary(profiles.typical_profile(feature_frame(spark, sf)), by=["direction"]))


@query("segment_hour_stats")
def q_segment_hour_stats(spark, sf):
    return round_floats(profiles.segment_hour_stats(feature_frame(spark, sf)))


@query("boxplot_segment_means")
def q_boxplot_segment_means(spark, sf):
    """Per condition and hour over the segments' mean flow and time."""
    s = profiles.segment_hour_stats(feature_frame(spark, sf)).withColumnsRenamed(
        {f"{m}_mean": m for m in profiles.NETWORK_METRICS})
    long = s.select("condition", "hour", "total_traffic_flow", "normalized_time").unpivot(
        ["condition", "hour"], ["total_traffic_flow", "normalized_time"], "metric", "value")
    return round_floats(profiles.boxplot_stats(long, "value", ("metric", "condition", "hour")))


@query("boxplot_vehicle_counts")
def q_boxplot_vehicle_counts(spark, sf):
    """Per hour over the counts of each vehicle class."""
    long = feature_frame(spark, sf).select("hour", *profiles.COUNT_COLS).unpivot(
        ["hour"], profiles.COUNT_COLS, "vehicle_class", "value")
    return round_floats(profiles.boxplot_stats(long, "value", ("vehicle_class", "hour")))
