"""Registered streaming queries: the test tables are staged as Parquet
files (written by Spark) and consumed by a file-source stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelflow.operators import rollup
from panelflow.plans import catalog as base
from panelflow.plans.registry import query, round_floats
from panelflow.sources import sinks
from panelflow.sources import testdata as td
from panelflow.streaming import hourly as sh


@query("stream_hourly_rollup")
def q_stream_hourly_rollup(spark, sf):
    r = td.readings(spark, sf, "event_type").select("segment_id", "datetime", *rollup.FLOW_SUM_COLS,
                                                   *rollup.MEAN_COLS)
    src = sinks.write_partitioned(r, sinks.staging_path(spark, "stream-src"))
    out = sh.stream_hourly_rollup(spark, src, r.schema)
    return round_floats(out)


@query("stream_gap_filter")
def q_stream_gap_filter(spark, sf):
    h = base.hourly(spark, sf, "user40", base.IMPACT_FULL, ()).select(
        "segment_id", "datetime", "total_traffic_flow", "data_completeness")
    src = sinks.write_partitioned(h, sinks.staging_path(spark, "stream-hourly-src"))
    out = sh.stream_gap_filter(spark, src, h.schema, max_gap_hours=base.GAP_HOURS)
    return round_floats(out.select("segment_id", "datetime", "total_traffic_flow", "data_completeness"))
