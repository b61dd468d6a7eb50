import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from panelflow.functions import features as fx
from panelflow.functions import text as tx
from panelflow.functions.geo import STUDY_AREA_POLYGON, inside_polygon, parse_coordinate_pair
from panelflow.functions.numeric import np_round
from panelflow.functions.timecols import floor_hour, round_time_text_to_15min, round_to_15min


def test_np_round_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.uniform(-1000, 1000, 2000).round(3)) + [0.125, 0.135, 2.675, -0.125, 1.005]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_round_to_15min_edges(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 7, 59),), (dt.datetime(2024, 1, 1, 10, 8, 0),),
            (dt.datetime(2024, 1, 1, 23, 59, 0),), (dt.datetime(2024, 1, 1, 23, 52, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    same = [r[0] for r in df.select(round_to_15min("ts")).collect()]
    carry = [r[0] for r in df.select(round_to_15min("ts", carry_day=True)).collect()]
    assert same == [dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 1, 10, 15),
                    dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 23, 45)]
    assert carry[2] == dt.datetime(2024, 1, 2, 0, 0)


def test_round_time_text(spark):
    df = spark.createDataFrame([("10:07:30",), ("23:58:00",), ("xx",)], "t string")
    assert [r[0] for r in df.select(round_time_text_to_15min("t")).collect()] == ["10:00:00", "00:00:00", "xx"]


def test_floor_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 1, 45, 10),)], "ts timestamp_ntz")
    assert df.select(floor_hour("ts")).first()[0] == dt.datetime(2024, 3, 31, 1, 0)


def test_parse_coordinates(spark):
    df = spark.createDataFrame([("53.4 ; -2.2",), ("53.4",), ("abc ; 1",), (None,), (" 1 ; 2 ; 3",)], "c string")
    lat, lon = parse_coordinate_pair(F.col("c"))
    got = [tuple(r) for r in df.select(lat, lon).collect()]
    assert got == [(53.4, -2.2), (None, None), (None, None), (None, None), (1.0, 2.0)]


def test_snake_case():
    assert tx.snake_case("  Local Date ") == "local_date"
    assert tx.snake_case("NTIS Link Number") == "ntis_link_number"
    assert tx.snake_case("Fused-Average  Speed (km/h)") == "fused_average_speed_km_h"


def test_snake_case_col_matches_python(spark):
    names = ["  Local Date ", "A__b--C", "x (y)/z", "__lead trail__"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tx.snake_case_col("n")).collect()] == [tx.snake_case(n) for n in names]


def test_direction_rules(spark):
    cases = {"M60 anti-clockwise J1": "anticlockwise", "M60 Anticlockwise": "anticlockwise",
             "M60 clockwise J3": "clockwise", "A57 eastbound": "eastbound", "A6 westbound": "westbound",
             "M62 Northbound": "northbound", "A34 southbound": "southbound", "somewhere": "other"}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert [r[0] for r in df.select(tx.direction_of("d")).collect()] == list(cases.values())


def test_segment_type(spark):
    df = spark.createDataFrame([("mainCarriageway", "x"), (" ", "a slip road"), (None, "junction 4"),
                                (None, "x roundabout"), (None, "main road"), (None, "other"), ("nan", "slip")],
                               "cw string, d string")
    got = [r[0] for r in df.select(tx.segment_type_of("cw", "d")).collect()]
    assert got == ["mainCarriageway", "slipRoad", "junction", "roundabout", "mainCarriageway", "unknown", "slipRoad"]


def test_ids_and_names(spark):
    df = spark.createDataFrame([("M60 J1 1234", "link_99.csv", "https://x.org/a/b/file", "a/b:c?")],
                               "f string, n string, u string, s string")
    r = df.select(tx.trailing_id("f"), tx.file_link_id("n"), tx.archive_name_from_url("u"),
                  tx.safe_file_name("s")).first()
    assert tuple(r) == ("1234", "99", "file.zip", "a_bc")


def test_clean_segment_name_intended(spark):
    df = spark.createDataFrame([("M60 anti-clockwise between J12 and J13 4411",), ("M60 clockwise J5 roundabout",),
                                ("plain",)], "s string")
    got = [r[0] for r in df.select(tx.clean_segment_name("s", include_id=True)).collect()]
    assert got == ["M60 ACW J12-J13 (4411)", "M60 CW J5 Roundabout", "plain"]
    j = [r[0] for r in df.select(tx.junctions_of("s")).collect()]
    assert j == ["J12-J13", "J5", ""]


def _ray_cast(x, y, poly):
    n, inside = len(poly), False
    p1x, p1y = poly[0]
    for i in range(n + 1):
        p2x, p2y = poly[i % n]
        if y > min(p1y, p2y) and y <= max(p1y, p2y) and x <= max(p1x, p2x):
            xinters = None
            if p1y != p2y:
                xinters = (y - p1y) * (p2x - p1x) / (p2y - p1y) + p1x
            if p1x == p2x or (xinters is not None and x <= xinters):
                inside = not inside
        p1x, p1y = p2x, p2y
    return inside


def test_inside_polygon_matches_loop(spark):
    rnd = random.Random(3)
    pts = [(rnd.uniform(-2.6, -1.9), rnd.uniform(53.3, 53.65)) for _ in range(800)]
    pts += [(STUDY_AREA_POLYGON[2][0], STUDY_AREA_POLYGON[2][1]), (-2.25, STUDY_AREA_POLYGON[4][1]), (0.0, 0.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = [r[0] for r in df.select(inside_polygon("x", "y")).collect()]
    assert got == [_ray_cast(x, y, STUDY_AREA_POLYGON) for x, y in pts]


def test_targets_and_flags(spark):
    df = spark.createDataFrame([(112.65, 0.0, 60.0, 5.0, 1.0, 2.0, 3.0, 4.0, dt.datetime(2024, 1, 1, 8)),
                                (None, 1000.0, 60.0, 12.0, 0.0, 0.0, 0.0, 0.0, dt.datetime(2024, 1, 1, 9))],
                               "fused_average_speed double, link_length double, fused_travel_time double, "
                               "day_type_id double, traffic_flow_value1 double, traffic_flow_value2 double, "
                               "traffic_flow_value3 double, traffic_flow_value4 double, datetime timestamp_ntz")
    out = fx.add_interactions(fx.add_targets(fx.add_day_flags(df))).collect()
    a, b = out
    assert a["speed_mph"] == float(np.round(112.65 * 0.621371, 2)) and a["speed_reduction"] == 0.0
    assert a["normalized_time"] is None and a["journey_delay"] is None
    assert [a[f"traffic_{i}_pct"] for i in range(1, 5)] == [10.0, 20.0, 30.0, 40.0]
    assert b["traffic_1_pct"] is None and b["speed_mph"] is None and b["speed_reduction"] is None
    assert (a["is_weekend"], a["is_school_holiday"], b["is_weekend"], b["hour_weekend"]) == (1, 0, 1, 9)
    assert b["normalized_time"] == float(np.round((60 / 60) / (1000 / 1609.34), 2))


def test_parsing_is_zone_free(spark):
    from panelflow.functions.timecols import combine_date_time
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.createDataFrame([("2024-03-31", "01:30:00"), ("2024-13-01", "00:00:00"), ("2024-01-01", "xx")],
                                   "d string, t string")
        got = [r[0] for r in df.select(combine_date_time("d", "t")).collect()]
        assert got == [dt.datetime(2024, 3, 31, 1, 30), None, None]
        r = spark.createDataFrame([(dt.datetime(2024, 3, 31, 1, 40),)], "ts timestamp_ntz")
        assert r.select(round_to_15min("ts"), floor_hour("ts")).first() == (
            dt.datetime(2024, 3, 31, 1, 45), dt.datetime(2024, 3, 31, 1, 0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
