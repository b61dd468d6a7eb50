"""Registered queries against their DuckDB SQL on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as E

sys.path.insert(0, "tools")
from check_oracle import TABLES, canon  # noqa: E402

SF = "/root/testdata/sf0.001"
FAST = ["hourly_rollup", "gap_filter", "interval_label_last_writer", "interval_flags_closed", "impact_top20",
        "weather_resample_ffill", "features", "network_hourly", "vehicle_mix_hourly", "typical_profile",
        "missing_flow_by_type", "geofence_tally", "duplicate_ids", "missing_days", "name_parsing",
        "coordinate_parse", "segment_labels", "split_kfold", "regression_metrics", "qq_points",
        "supplier_panel_profile"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert canon(sp) == canon(dk)
