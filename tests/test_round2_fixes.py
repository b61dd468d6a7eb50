"""Cases of the round-1 verdict: rewritten inputs, clock texts, NaN, ragged rows, sinks."""

import os

from pyspark.sql import functions as F

from panelflow.functions import timecols as tc
from panelflow.operators import features, intervals
from panelflow.sources import archive, raw, sinks


def test_rewritten_windows_and_weather_are_read_afresh(spark, tmpdir_path):
    rows = spark.sql("select timestamp_ntz '2024-05-04 13:30:00' as datetime")
    for team in ("Man City", "Man United"):
        spark.createDataFrame([("2024-05-04", "15:00", team, "f")], "`Date` string, `Kick-off Time` string, `Team` string, `Fixture` string") \
            .write.mode("overwrite").parquet(f"{tmpdir_path}/w")
        spark.createDataFrame([(team,)], "name string").selectExpr("timestamp_ntz '2024-05-04 13:00:00' as datetime", "name") \
            .write.mode("overwrite").parquet(f"{tmpdir_path}/weather")
        fixtures = spark.read.parquet(f"{tmpdir_path}/w")
        kick = tc.combine_date_time(F.col("Date"), F.col("Kick-off Time"))
        windows = fixtures.select(
            F.col("Team").alias("match_team"), F.col("Fixture").alias("fixture"), F.lit(1).alias("seq"),
            F.timestamp_add("HOUR", F.lit(-3), kick).alias("start_pre_match"), kick.alias("end_pre_match"),
            F.timestamp_add("HOUR", F.lit(2), kick).alias("start_post_match"), F.timestamp_add("HOUR", F.lit(4), kick).alias("end_post_match"))
        assert intervals.label_last_writer(rows, windows).first()["match_team"] == team
        assert features.join_weather(rows, spark.read.parquet(f"{tmpdir_path}/weather")).first()["name"] == team


def test_clock_texts(spark):
    got = spark.createDataFrame([("9:07:00",), ("20:15",), ("9:05",), ("12:00:00",), ("xx",)], "t string") \
        .select(tc.combine_date_time(F.lit("2024-01-02"), "t").cast("string").alias("d"), tc.round_time_text_to_15min("t").alias("r")).collect()
    assert [r["d"] for r in got] == ["2024-01-02 09:07:00", "2024-01-02 20:15:00", "2024-01-02 09:05:00", "2024-01-02 12:00:00", None]
    assert [r["r"] for r in got] == ["09:00:00", "20:15:00", "09:00:00", "12:00:00", "xx"]


def test_nan_and_infinity_are_null(spark):
    df = spark.createDataFrame([("NaN",), ("inf",), ("-Infinity",), ("1.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(raw.finite(F.col("v").try_cast("double"))).collect()] == [None, None, None, 1.5, None]


def test_ragged_rows_are_kept_and_counted(spark):
    rows = spark.createDataFrame([("a", "m", 1, ["x", "y"], ["1", "2"], None), ("a", "m", 2, ["x", "y"], ["3"], None),
                                  ("a", "m", 3, ["x", "y"], ["4", "5", "6"], None)], archive.ROWS_SCHEMA)
    got = [(r["x"], r["y"]) for r in archive.rows_to_columns(rows, ["x", "y"]).orderBy("row_no").collect()]
    assert got == [("1", "2"), ("3", None), ("4", "5")]
    assert archive.ragged_tally(rows).first()["n_ragged"] == 2


def test_quarantine_keeps_the_inputs_parallelism(spark, tmpdir_path):
    df = spark.range(0, 1600, 1, 16).withColumnRenamed("id", "k")
    flags = df.select("k", (F.col("k") % 2).alias("is_kept"))
    path = sinks.quarantine(df, flags, "k", f"{tmpdir_path}/q")
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert len(files) > 2 and spark.read.parquet(path).count() == 1600
