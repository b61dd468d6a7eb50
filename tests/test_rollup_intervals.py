import datetime as dt
import random

import pandas as pd

from panelflow.operators import intervals, rollup

T0 = dt.datetime(2024, 1, 1)


def _h(h, m=0):
    return T0 + dt.timedelta(hours=h, minutes=m)


READ_SCHEMA = ("segment_id string, row_seq long, datetime timestamp_ntz, total_traffic_flow double, "
               "traffic_flow_value1 double, traffic_flow_value2 double, traffic_flow_value3 double, "
               "traffic_flow_value4 double, fused_travel_time double, fused_average_speed double, road string")


def _rows():
    rows, seq = [], 0
    # hour 0: 4 readings, hour 1: 3, hour 2: 1 (with all-null flow), then gaps of 6 h (kept) and 7 h (dropped)
    for h, mins in ((0, (0, 15, 30, 45)), (1, (0, 15, 30)), (2, (0,)), (8, (0,)), (15, (0,)), (16, (0,))):
        for m in mins:
            flow = None if h == 2 else 10.0 + m
            rows.append(("a", seq, _h(h, m), flow, 1.0, 2.0, None, 0.0, 30.0, 50.0 + m,
                         None if seq == 0 else f"R{seq}"))
            seq += 1
    return rows


def test_hourly_rollup_and_gap(spark):
    df = spark.createDataFrame(_rows(), READ_SCHEMA)
    h = rollup.hourly_rollup(df, first_cols=["road"], full_count=4)
    got = {r["datetime"]: r for r in h.collect()}
    assert got[_h(0)]["data_completeness"] == 4 and got[_h(0)]["is_interpolated"] == 0
    assert got[_h(1)]["data_completeness"] == 3 and got[_h(1)]["is_interpolated"] == 1
    assert got[_h(0)]["total_traffic_flow"] == 10 + 25 + 40 + 55
    assert got[_h(2)]["total_traffic_flow"] == 0.0          # all missing -> 0
    assert got[_h(0)]["traffic_flow_value3"] == 0.0
    assert got[_h(0)]["fused_average_speed"] == 50 + 22.5
    assert got[_h(0)]["road"] == "R1"                       # first non-missing
    kept = sorted(r["datetime"] for r in rollup.gap_filter(h, max_gap_hours=6).collect())
    assert kept == [_h(0), _h(1), _h(2), _h(8), _h(16)]     # 8 follows a 6 h gap, 15 follows 7 h


def test_resample_mode_and_ffill(spark):
    rows = [(_h(0, 5), 10.0, 3.0, 1.0), (_h(0, 35), 20.0, 2.0, 3.0), (_h(0, 50), 30.0, 3.0, 5.0),
            (_h(1, 10), 5.0, 1.0, 1.0), (_h(1, 20), 7.0, 2.0, 1.0), (_h(5, 0), 1.0, 9.0, 2.0)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, t double, code double, w double")
    out = rollup.resample_hourly(df, mean_cols=["t", "w"], mode_cols=["code"]).orderBy("datetime").collect()
    assert [r["datetime"] for r in out] == [_h(i) for i in range(6)]
    assert out[0]["t"] == 20.0 and out[0]["code"] == 3.0
    assert out[1]["code"] == 1.0                            # tie -> lowest
    assert out[3]["t"] == 6.0 and out[3]["code"] == 1.0     # forward filled
    assert out[5]["code"] == 9.0


def _windows_df(spark, wins):
    return spark.createDataFrame(wins, "match_team string, fixture string, start_pre_match timestamp_ntz, "
                                       "end_pre_match timestamp_ntz, start_post_match timestamp_ntz, "
                                       "end_post_match timestamp_ntz, seq long")


def _random_windows(rnd, n):
    wins = []
    for i in range(n):
        k = _h(rnd.randint(2, 60), rnd.choice([0, 15, 30, 45]))
        wins.append((rnd.choice(["A", "B"]), f"f{i}", k - dt.timedelta(hours=2), k, k + dt.timedelta(hours=2),
                     k + dt.timedelta(hours=4), i))
    return wins


def _loop_last_writer(times, wins, closed):
    out = {}
    for t in times:
        period, team = "no_match", "no_match"
        for w in sorted(wins, key=lambda x: x[6]):
            for s, e, p in ((w[2], w[3], "pre_match"), (w[4], w[5], "post_match")):
                if s <= t and (t < e if closed == "left" else t <= e):
                    period, team = p, w[0]
        out[t] = (period, team)
    return out


def test_interval_join_equals_plain_loop(spark):
    rnd = random.Random(11)
    wins = _random_windows(rnd, 25)
    times = sorted({_h(0, 15 * i) for i in range(300)} | {w[j] for w in wins for j in (2, 3, 4, 5)})
    df = spark.createDataFrame([(t,) for t in times], "datetime timestamp_ntz")
    w = _windows_df(spark, wins)
    for closed in ("left", "both"):
        got = {r["datetime"]: (r["match_period"], r["match_team"])
               for r in intervals.label_last_writer(df, w, closed=closed).collect()}
        assert got == _loop_last_writer(times, wins, closed)


def test_flags_closed_accumulate(spark):
    rnd = random.Random(5)
    wins = _random_windows(rnd, 20)
    times = sorted({_h(0, 15 * i) for i in range(300)})
    df = spark.createDataFrame([(t,) for t in times], "datetime timestamp_ntz")
    got = {r["datetime"]: r for r in intervals.flag_match_periods(df, _windows_df(spark, wins), teams=("A", "B")).collect()}
    for t in times:
        pre = any(w[2] <= t <= w[3] for w in wins)
        post = any(w[4] <= t <= w[5] for w in wins)
        team = "no_match"
        for w in sorted(wins, key=lambda x: x[6]):
            if w[2] <= t <= w[3] or w[4] <= t <= w[5]:
                team = w[0]
        r = got[t]
        assert (r["is_pre_match"], r["is_post_match"], r["match_team"]) == (int(pre), int(post), team)
        assert r["is_team_0"] == int(team == "A") and r["is_match_period"] == int(pre or post)


def test_match_windows_drop_unparsable(spark):
    fx = spark.createDataFrame([("2024-01-02", "15:00:00", "A", "x", 1), ("2024-01-03", "TBC", "B", "y", 2)],
                               "Date string, `Kick-off Time` string, Team string, Fixture string, seq long")
    w = intervals.match_windows(fx).collect()
    assert len(w) == 1 and w[0]["start_pre_match"] == dt.datetime(2024, 1, 2, 13) \
        and w[0]["end_post_match"] == dt.datetime(2024, 1, 2, 19)
    assert intervals.dropped_fixture_count(fx).first()["dropped"] == 1


def test_baseline_intended_mode(spark):
    rows = [(_h(0), 1), (_h(1), 0), (_h(24), 0), (_h(25), 0)]   # Monday 0h has a match; Tuesday 0h does not
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, is_match_period int")
    exact = {r["datetime"]: r["is_baseline"] for r in intervals.mark_baseline(df).collect()}
    intended = {r["datetime"]: r["is_baseline"] for r in intervals.mark_baseline(df, intended=True).collect()}
    assert exact == {_h(0): 0, _h(1): 1, _h(24): 1, _h(25): 1}
    assert intended == {_h(0): 0, _h(1): 0, _h(24): 0, _h(25): 0}
    assert pd.Timestamp(_h(24)).dayofweek == 1
