"""Feature and target expressions (day flags, interactions, one-hot
encodings, unit conversions, vehicle shares, speed and delay targets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.functions.numeric import _c, non_negative, np_round, safe_div

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Day-type ids counted as weekend (Saturday, Sunday, bank holiday) and as
# school holiday (first, mid-week and last day of a holiday, Christmas
# period, Christmas / New Year's day).
WEEKEND_DAY_TYPES = (5, 6, 12)
SCHOOL_HOLIDAY_DAY_TYPES = (7, 9, 11, 13, 14)
KMH_TO_MPH = 0.621371
FREE_FLOW_MPH = 70
METRES_PER_MILE = 1609.34
# One-hot output names for the match period and team columns.
PERIOD_CATEGORIES = (("pre_match", "is_pre_match"), ("post_match", "is_post_match"),
                     ("no_match", "is_no_match_period"))
TEAM_CATEGORIES = (("Man United", "is_united_match"), ("Man City", "is_city_match"),
                   ("no_match", "is_no_match_team"))
# ---------------------------------------------------------------------------


def is_weekend_flag(day_type_id="day_type_id") -> Column:
    return _c(day_type_id).isin(*WEEKEND_DAY_TYPES).cast("int")


def is_school_holiday_flag(day_type_id="day_type_id") -> Column:
    return _c(day_type_id).isin(*SCHOOL_HOLIDAY_DAY_TYPES).cast("int")


def add_day_flags(df: DataFrame, day_type_col: str = "day_type_id", drop: bool = True) -> DataFrame:
    """is_weekend / is_school_holiday from the day-type id; the id column is
    required (raises otherwise) and dropped afterwards by default."""
    if day_type_col not in df.columns:
        raise ValueError(f"'{day_type_col}' column is required")
    out = df.withColumns({
        "is_weekend": F.coalesce(is_weekend_flag(day_type_col), F.lit(0)),
        "is_school_holiday": F.coalesce(is_school_holiday_flag(day_type_col), F.lit(0)),
    })
    return out.drop(day_type_col) if drop else out


def add_interactions(df: DataFrame, hour_col: str = "hour") -> DataFrame:
    """hour x is_weekend and hour x is_school_holiday."""
    need = [hour_col, "is_weekend", "is_school_holiday"]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns for interactions: {missing}")
    return df.withColumns({
        "hour_weekend": F.col(hour_col) * F.col("is_weekend"),
        "hour_school_holiday": F.col(hour_col) * F.col("is_school_holiday"),
    })


def day_type_label(is_weekend="is_weekend", is_school_holiday="is_school_holiday") -> Column:
    """weekend > school_holiday > weekday."""
    return (F.when(_c(is_weekend) == 1, F.lit("weekend"))
            .when(_c(is_school_holiday) == 1, F.lit("school_holiday"))
            .otherwise(F.lit("weekday")))


def one_hot(df: DataFrame, column: str, categories, drop: bool = True) -> DataFrame:
    """One int column per listed category (a fixed list, so a category
    absent from the data still gets its column)."""
    out = df.withColumns({name: F.coalesce((F.col(column) == F.lit(value)).cast("int"), F.lit(0))
                          for value, name in categories})
    return out.drop(column) if drop else out


def one_hot_match(df: DataFrame, period_col: str = "match_period", team_col: str = "match_team",
                  period_categories=PERIOD_CATEGORIES, team_categories=TEAM_CATEGORIES,
                  drop: bool = True) -> DataFrame:
    return one_hot(one_hot(df, period_col, period_categories, drop), team_col, team_categories, drop)


def kmh_to_mph(speed_kmh="fused_average_speed") -> Column:
    return np_round(_c(speed_kmh) * F.lit(KMH_TO_MPH), 2)


def share_columns(values, prefix: str = "traffic_", suffix: str = "_pct") -> dict:
    """value_i / (sum of values, NULLs skipped) * 100, rounded to 2; a zero
    or all-missing total gives NULL."""
    total = None
    for v in values:
        term = F.coalesce(_c(v), F.lit(0.0))
        total = term if total is None else total + term
    return {f"{prefix}{i}{suffix}": np_round(safe_div(_c(v), total) * F.lit(100.0), 2)
            for i, v in enumerate(values, start=1)}


def speed_reduction(speed_mph="speed_mph", free_flow: float = FREE_FLOW_MPH) -> Column:
    return np_round(non_negative(F.lit(float(free_flow)) - _c(speed_mph)), 2)


def normalized_time(travel_time_s="fused_travel_time", length_m="link_length") -> Column:
    """Minutes per mile; NULL when the length is not positive."""
    miles = _c(length_m) / F.lit(METRES_PER_MILE)
    return np_round(F.when(miles > 0, safe_div(_c(travel_time_s) / F.lit(60.0), miles)), 2)


def journey_delay(norm_time="normalized_time", free_flow: float = FREE_FLOW_MPH) -> Column:
    return np_round(non_negative(_c(norm_time) - F.lit(60.0 / free_flow)), 2)


def add_targets(df: DataFrame, flow_values=("traffic_flow_value1", "traffic_flow_value2",
                                            "traffic_flow_value3", "traffic_flow_value4"),
                ts_col: str = "datetime") -> DataFrame:
    """hour, speed_mph, vehicle shares, speed_reduction, normalized_time
    (kept when already present) and journey_delay."""
    out = df.withColumn("hour", F.hour(ts_col))
    out = out.withColumn("speed_mph", kmh_to_mph("fused_average_speed"))
    out = out.withColumns(share_columns(list(flow_values)))
    out = out.withColumn("speed_reduction", speed_reduction("speed_mph"))
    if "normalized_time" not in df.columns:
        out = out.withColumn("normalized_time", normalized_time())
    return out.withColumn("journey_delay", journey_delay("normalized_time"))
