import datetime as dt

from pyspark.sql import functions as F

from panelflow.operators import ml, profiles, quality, rollup, splits
from panelflow.sources import sinks
from panelflow.streaming import hourly as sh

HOURLY = "segment_id string, datetime timestamp_ntz, total_traffic_flow double, data_completeness long"


def test_stream_gap_filter_takes_late_files_in_a_later_run(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), float(h), 1) for h in (22, 21, 20, 1, 0, 12)]
    first, late = spark.createDataFrame(rows[:3], HOURLY), spark.createDataFrame(rows[3:], HOURLY)
    src, out = sinks.staging_path(spark, "t-src"), sinks.staging_path(spark, "t-out")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for part in (first, late):
            part.write.mode("append").parquet(src)
            got = sh.stream_gap_filter(spark, src, first.schema, out_path=out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = rollup.gap_filter(first.unionByName(late))
    assert sorted(map(tuple, got.select(*first.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_split_by_group_refuses_small_groups(spark):
    d = spark.range(1200).select(F.when(F.col("id") < 1000, "a").otherwise("b").alias("g"), F.col("id").alias("t"))
    got = {(r["g"], r["split"]): r["count"] for r in
           splits.chronological_split(d, ["t"], by=["g"]).groupBy("g", "split").count().collect()}
    assert got == {("a", "train"): 700, ("a", "val"): 150, ("a", "test"): 150}


def test_best_round_and_ranges():
    assert ml.best_round([5, 4, 3, 4, 4, 1], patience=2) == 3
    assert ml.best_round([5, 4, 3, 4, 4, 1], patience=5) == 6
    assert ml.SEARCH_SPACE["max_iter"][:2] == (100, 1000) and ml.ROUNDS == 300


def test_density_of_one_value_and_of_none(spark):
    one = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r["density"] for r in profiles.kde_on_grid(one, "v", 5).collect()} == {None}
    assert profiles.kde_on_grid(one.where("v > 1"), "v", 5).count() == 0


def test_duplicate_summary_with_files_without_id(spark):
    d = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), (None, "d"), (None, "e")], "i string, f string")
    r = quality.duplicate_summary(d, "i", "f").first()
    assert (r["n_files"], r["n_files_without_id"], r["n_unique_ids"], r["n_duplicate_ids"]) == (5, 2, 2, 1)
