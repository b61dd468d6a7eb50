"""One test per documented choice where the source behaves oddly
(README "Choices where the source behaves oddly")."""

import datetime as dt

from pyspark.sql import functions as F

from panelflow.functions import features as fx
from panelflow.functions import text as tx
from panelflow.operators import intervals, quality


def test_onehot_uses_fixed_categories_even_when_absent(spark):
    df = spark.createDataFrame([("pre_match", "Man City")], "match_period string, match_team string")
    r = fx.one_hot_match(df).first().asDict()
    assert r == {"is_pre_match": 1, "is_post_match": 0, "is_no_match_period": 0,
                 "is_united_match": 0, "is_city_match": 1, "is_no_match_team": 0}


def test_short_name_tests_anticlockwise_first_and_matches_junctions(spark):
    df = spark.createDataFrame([("M60 anti-clockwise J1 to J27",)], "s string")
    r = df.select(tx.clean_segment_name("s"), tx.direction_code("s"), tx.junctions_of("s")).first()
    assert tuple(r) == ("M60 ACW J1-J27", "ACW", "J1")


def test_segment_types_report_junction_and_roundabout(spark):
    rows = [(1, 1, None, "junction 3", 1.0), (2, 1, None, "big roundabout", 1.0)]
    df = spark.createDataFrame(rows, "k int, seq int, carriageway string, ntis_link_description string, f double")
    types = {r.segment_type for r in quality.segment_type_catalogue(df, "k").collect()}
    assert {"junction", "roundabout", "unknown"} <= types


def test_label_join_closure_differs_between_feature_and_impact_paths(spark):
    k = dt.datetime(2024, 1, 1, 15)
    w = spark.createDataFrame([("A", "f", k - dt.timedelta(hours=2), k, k + dt.timedelta(hours=2),
                                k + dt.timedelta(hours=4), 1)],
                              "match_team string, fixture string, start_pre_match timestamp_ntz, "
                              "end_pre_match timestamp_ntz, start_post_match timestamp_ntz, "
                              "end_post_match timestamp_ntz, seq long")
    df = spark.createDataFrame([(k,)], "datetime timestamp_ntz")      # exactly at the pre-window end
    assert intervals.label_last_writer(df, w).first().match_period == "no_match"       # half-open
    assert intervals.flag_match_periods(df, w, teams=("A", "B")).first().is_pre_match == 1  # closed


def test_speed_reduction_keeps_missing_speed_missing(spark):
    df = spark.createDataFrame([(None,), (120.0,)], "speed_mph double")
    assert [r[0] for r in df.select(fx.speed_reduction("speed_mph")).collect()] == [None, 0.0]
    assert F is not None
