"""Forward fill of many series; roll-ups carry only the columns asked for."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelflow.operators import rollup
from panelflow.plans import catalog as base
from panelflow.plans import feature_queries as fq
from panelflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk", ["MM", "YEAR", "WEEK"])
def test_forward_fill_is_pandas_forward_fill(spark, chunk):
    rng = random.Random(0)
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=7 * i), None if rng.random() < 0.9 else float(i), None if rng.random() < 0.97 else f"c{i}")
            for s in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, datetime timestamp_ntz, x double, c string").repartition(5)
    got = rollup.forward_fill(df, ["x", "c"], by=["s"], chunk=chunk).toPandas()
    want = pd.DataFrame(rows, columns=["s", "datetime", "x", "c"])
    for s, part in want.groupby("s", dropna=False):
        mine = got[got.s.isna() if s is None or s != s else got.s == s].sort_values("datetime")
        filled = part.sort_values("datetime")
        assert mine["x"].tolist() == pytest.approx(filled["x"].ffill().tolist(), nan_ok=True)
        assert [v or None for v in mine["c"]] == [v if v == v else None for v in filled["c"].ffill()]


def test_series_are_filled_from_their_own_values(spark):
    t = [dt.datetime(2024, 1, 31, 20) + dt.timedelta(hours=i) for i in range(8)]
    df = spark.createDataFrame([(1, t[0], 1.0), (1, t[7], None), (2, t[2], None), (2, t[4], 5.0)], "st int, datetime timestamp_ntz, v double")
    got = rollup.resample_hourly(df, mean_cols=["v"], by=["st"]).orderBy("st", "datetime").collect()
    assert [(r["st"], r["v"]) for r in got] == [(1, 1.0)] * 8 + [(2, None), (2, None), (2, 5.0)]


def windows_of(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


def test_no_unpartitioned_window_over_hourly_rows(spark):
    w = rollup.resample_hourly(fq.td.weather_raw(spark, SF), mean_cols=["temperature_2m"])
    lines = windows_of(w)
    assert len(lines) == 2 and sum("_chunk" in line.split("], [")[1] for line in lines) >= 1
    for line in lines:          # the one without a key is over one row per chunk
        assert "_chunk" in line


def test_rollups_carry_only_the_columns_asked_for(spark):
    for name in ("gap_filter", "impact_complete_hours"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") and "ntis_link_description" not in plan and "carriageway" not in plan
    plan = fq.feature_frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "carriageway#" not in plan
    assert set(base.td.FIRST_COLS) <= set(base.hourly(spark, SF).columns)
    assert base.hourly(spark, SF, first_cols=()).where(F.lit(False)).count() == 0
