"""Views of the driver's tables in the panel data model.

The test tables are generic (an ``events`` stream, TPC-H-like tables), so
each view maps their columns onto the panel schema with plain
expressions.  Every view is computed by Spark from the tables and grows
with them; nothing is generated on the driver.  ``plans.oracle`` holds
the same mappings as SQL text for the independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelflow.functions.timecols import round_to_15min

SEGMENT_KEYS = {
    # 5 segments: heavy segments, used for roll-up and completeness
    "event_type": lambda: F.col("event_type"),
    # 40 segments: used for gap handling, impact ranking and top-k
    "user40": lambda: (F.col("user_id") % 40).cast("string"),
}

# Link descriptions assigned by user_id % 7 (cover every direction class).
DESCRIPTIONS = [
    "M60 anti-clockwise between J1 and J2",
    "M60 clockwise between J3 and J4",
    "A57 eastbound slip road",
    "A6 westbound junction 5",
    "M62 northbound within Manchester roundabout",
    "A34 southbound main carriageway",
    "M60 anticlockwise J12 exit",
]
CARRIAGEWAYS = ["mainCarriageway", "slipRoad", " ", None, "mainCarriageway"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of(props: str = "props") -> Column:
    return F.regexp_extract(F.col(props), r'"k":\s*(\d+)', 1).try_cast("int")


def _case(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string") if v is None else F.lit(v)
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr


def readings(spark: SparkSession, sf_dir: str, segment: str = "event_type") -> DataFrame:
    """15-minute readings (cleaned schema) from ``events``."""
    ev = table(spark, sf_dir, "events")
    k = k_of()
    uid = F.col("user_id")
    lon = F.lit(-2.56) + (uid % 13) * F.lit(0.05)
    lat = F.lit(53.31) + ((uid / 13).cast("long") % 8) * F.lit(0.045)
    return ev.select(
        SEGMENT_KEYS[segment]().alias("segment_id"),
        F.col("event_id").alias("row_seq"),
        F.col("ts").alias("raw_ts"),
        F.concat(F.lit("R"), (uid % 3).cast("string")).alias("road"),
        round_to_15min("ts").alias("datetime"),
        (k % 15).cast("double").alias("day_type_id"),
        _case(uid % 5, CARRIAGEWAYS).alias("carriageway"),
        uid.alias("ntis_link_number"),
        _case(uid % 7, DESCRIPTIONS).alias("ntis_link_description"),
        F.when(uid % 20 == 0, F.lit(0.0)).otherwise(F.lit(400.0) + (uid % 20) * F.lit(100.0)).alias("link_length"),
        (F.lit(30.0) + F.col("value")).alias("fused_travel_time"),
        F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(F.lit(40.0) + k * F.lit(0.7)).alias("fused_average_speed"),
        F.col("value").alias("total_traffic_flow"),
        (k % 7).cast("double").alias("traffic_flow_value1"),
        (k % 5).cast("double").alias("traffic_flow_value2"),
        (k % 3).cast("double").alias("traffic_flow_value3"),
        (k % 2).cast("double").alias("traffic_flow_value4"),
        lat.alias("start_latitude"),
        lon.alias("start_longitude"),
        (lat + F.lit(0.01)).alias("end_latitude"),
        (lon + F.lit(0.01)).alias("end_longitude"),
    )


FIRST_COLS = ["road", "day_type_id", "carriageway", "ntis_link_number", "ntis_link_description",
              "link_length", "start_latitude", "start_longitude", "end_latitude", "end_longitude"]


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw fixture list (Date, Kick-off Time, Team, Fixture, seq) from the
    calendar days present in ``events``: team A plays on even day numbers,
    team B on multiples of 3; day numbers = 10 mod 11 get an unparsable
    kick-off for team A (dropped downstream).  One pass over ``events``;
    the day table (one row per calendar day) is small."""
    ev = table(spark, sf_dir, "events")
    days = ev.select(F.col("ts").cast("date").alias("d")).distinct()
    dn = F.datediff("d", F.min("d").over(Window.partitionBy()))
    days = days.withColumn("dn", dn)
    date = F.date_format("d", "yyyy-MM-dd")
    a = F.when(F.col("dn") % 2 == 0, F.struct(
        date.alias("Date"),
        F.when(F.col("dn") % 11 == 10, F.lit("TBC")).otherwise(
            F.format_string("%02d:00:00", F.lit(12) + (F.col("dn") * 5) % 9)).alias("Kick-off Time"),
        F.lit("Man United").alias("Team"),
        F.concat(F.lit("United fixture "), F.col("dn").cast("string")).alias("Fixture"),
        (F.col("dn") * 2).cast("long").alias("seq")))
    b = F.when(F.col("dn") % 3 == 0, F.struct(
        date.alias("Date"),
        F.format_string("%02d:00:00", F.lit(12) + (F.col("dn") * 7) % 9).alias("Kick-off Time"),
        F.lit("Man City").alias("Team"),
        F.concat(F.lit("City fixture "), F.col("dn").cast("string")).alias("Fixture"),
        (F.col("dn") * 2 + 1).cast("long").alias("seq")))
    return days.select(F.explode(F.filter(F.array(a, b), lambda x: x.isNotNull())).alias("f")).select("f.*")


def weather_raw(spark: SparkSession, sf_dir: str, station: bool = False) -> DataFrame:
    """Sub-hourly weather readings, one per event.  Some hours of the day
    have no value (as a station that is down), so that there are gaps to
    fill: temperature and wind at 5, 11, 17 and 23 h, codes at 2 and 5 h.
    With ``station``, events are dealt to 40 stations by user."""
    ev = table(spark, sf_dir, "events")
    k, hour = k_of(), F.hour("ts")
    measured = hour % 6 != 5
    return ev.select(
        *([(F.col("user_id") % 40).alias("station")] if station else []),
        F.col("ts").alias("datetime"),
        F.when(measured, F.col("value")).alias("temperature_2m"),
        F.when(~hour.isin(2, 5), (k % 5).cast("double")).alias("weather_code"),
        F.when(measured, k * F.lit(0.1)).alias("wind_speed_10m"),
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large panel for the bench: one segment per supplier from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("segment_id"),
        F.col("l_orderkey").alias("row_seq"),
        F.col("l_shipdate").alias("datetime"),
        F.col("l_quantity").alias("total_traffic_flow"),
        F.col("l_extendedprice").alias("fused_average_speed"),
    )
