"""Oracle SQL for the file round-trip queries (computed straight from the
tables: the round trip must not change the result)."""

from __future__ import annotations

from panelflow.plans.oracle_quality import _inside_sql
from panelflow.plans.oracle import FIRST_COLS, MEAN_COLS, ORACLE, SUM_COLS, readings_cte, rounded

_firsts = ",\n         ".join(
    f"arg_min({c}, date_trunc('second', raw_ts)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in FIRST_COLS)
_sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in SUM_COLS)
_means = ", ".join(f"avg({c}) AS {c}" for c in MEAN_COLS)

ORACLE["raw_ingest_roundtrip"] = rounded("WITH " + readings_cte("event_type").replace(
    "event_id AS row_seq,", "event_id AS row_seq, ts AS raw_ts,") + f""",
r2 AS (SELECT * REPLACE (CAST(ntis_link_number AS VARCHAR) AS segment_id,
                         nullif(trim(carriageway), '') AS carriageway) FROM readings)
SELECT segment_id, date_trunc('hour', datetime) AS datetime, {_sums}, {_means},
       {_firsts}, count(*) AS data_completeness, CAST(count(*) < 4 AS INTEGER) AS is_interpolated
FROM r2 GROUP BY 1, 2""", SUM_COLS + MEAN_COLS + ["day_type_id", "link_length", "start_latitude",
                                                "start_longitude", "end_latitude", "end_longitude"])

ORACLE["section_report"] = "WITH " + readings_cte("event_type") + """
SELECT CAST(ntis_link_number AS VARCHAR) AS segment_id, count(*) AS n_rows,
       count(DISTINCT CAST(datetime AS DATE)) AS n_days,
       strftime(min(CAST(datetime AS DATE)), '%Y-%m-%d') AS first_day,
       strftime(max(CAST(datetime AS DATE)), '%Y-%m-%d') AS last_day,
       date_diff('day', min(CAST(datetime AS DATE)), max(CAST(datetime AS DATE))) + 1
         - count(DISTINCT CAST(datetime AS DATE)) AS n_missing_days
FROM readings GROUP BY 1"""

from panelflow.plans.oracle import gap_cte, hourly_cte  # noqa: E402

_SC = ["total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3", "traffic_flow_value4"]
ORACLE["stream_hourly_rollup"] = rounded("WITH " + readings_cte("event_type") + """
SELECT segment_id, date_trunc('hour', datetime) AS datetime, """ + ", ".join(
    f"coalesce(sum({c}), 0) AS {c}" for c in _SC) + """, avg(fused_travel_time) AS fused_travel_time,
       avg(fused_average_speed) AS fused_average_speed, count(*) AS data_completeness,
       CAST(count(*) < 4 AS INTEGER) AS is_interpolated
FROM readings GROUP BY 1, 2""", _SC + ["fused_travel_time", "fused_average_speed"])

ORACLE["stream_gap_filter"] = ORACLE["gap_filter"]

ORACLE["supplier_panel_rollup"] = rounded("""
SELECT CAST(l_suppkey AS VARCHAR) AS segment_id, date_trunc('hour', l_shipdate) AS datetime,
       coalesce(sum(l_quantity), 0) AS total_traffic_flow, avg(l_extendedprice) AS fused_average_speed,
       count(*) AS data_completeness, CAST(count(*) < 4 AS INTEGER) AS is_interpolated
FROM lineitem GROUP BY 1, 2""", ["total_traffic_flow", "fused_average_speed"])

ORACLE["supplier_panel_profile"] = rounded("""
SELECT CAST(l_suppkey AS VARCHAR) AS segment_id, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS weekday, count(*) AS n,
       avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, quantile_cont(l_quantity, 0.25) AS q1,
       quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3
FROM lineitem GROUP BY 1, 2""", ["mean", "std", "q1", "median", "q3"])

from panelflow.plans.oracle_features import _dir  # noqa: E402

ORACLE["direction_sink_roundtrip"] = rounded("WITH " + readings_cte("event_type") + f""",
d AS (SELECT road, {_dir('ntis_link_description')} AS direction, total_traffic_flow FROM readings)
SELECT road, direction, count(*) AS n_rows, sum(total_traffic_flow) AS total_flow
FROM d WHERE direction <> 'other' GROUP BY 1, 2""", ["total_flow"])

ORACLE["quarantine_restore"] = rounded("WITH " + readings_cte("event_type") + f""",
f AS (SELECT ntis_link_number, arg_min(start_longitude, row_seq) AS sx, arg_min(start_latitude, row_seq) AS sy,
             arg_min(end_longitude, row_seq) AS ex, arg_min(end_latitude, row_seq) AS ey FROM readings GROUP BY 1),
k AS (SELECT ntis_link_number, CAST({_inside_sql('sx', 'sy')} OR {_inside_sql('ex', 'ey')} AS INTEGER) AS is_kept FROM f)
SELECT coalesce(is_kept, -1) AS is_kept, count(*) AS n_rows, count(DISTINCT ntis_link_number) AS n_links, sum(total_traffic_flow) AS total_flow
FROM readings JOIN k USING (ntis_link_number) GROUP BY ROLLUP (is_kept)""", ["total_flow"])

ORACLE["filtered_copy"] = rounded("WITH " + readings_cte("event_type") + """
SELECT count(*) AS n_all, CAST(count_if(contains(carriageway, 'mainCarriageway')) AS BIGINT) AS n_filtered,
       CAST(count_if(contains(carriageway, 'mainCarriageway')) AS BIGINT) AS n_in_copy,
       sum(total_traffic_flow) FILTER (contains(carriageway, 'mainCarriageway')) AS flow_in_copy FROM readings""",
    ["flow_in_copy"])

ORACLE["json_report"] = rounded("WITH " + readings_cte("event_type") + """
SELECT segment_id, count(*) AS n, avg(total_traffic_flow) AS mean, min(total_traffic_flow) AS min,
       max(total_traffic_flow) AS max FROM readings GROUP BY 1""", ["mean", "min", "max"])

ORACLE["union_typed_files"] = rounded("WITH " + readings_cte("event_type") + """
SELECT segment_id, row_seq, datetime, total_traffic_flow FROM readings""", ["total_traffic_flow"])

ORACLE["archive_ingest"] = rounded("WITH " + readings_cte("event_type") + """
SELECT segment_id, row_seq, total_traffic_flow, nullif(carriageway, '') AS carriageway FROM readings""",
    ["total_traffic_flow"])

ORACLE["sorted_sink"] = "WITH " + readings_cte("event_type") + """
SELECT segment_id, count(*) AS n_rows, 0::BIGINT AS n_unsorted, 0::BIGINT AS n_overlapping, true AS files_in_bound
FROM readings GROUP BY 1"""

ORACLE["header_aware_scan"] = rounded("WITH " + readings_cte("event_type") + """
SELECT segment_id, row_seq, total_traffic_flow AS flow, CASE WHEN row_seq % 3 = 2 THEN road END AS road,
       CASE WHEN row_seq % 3 <> 1 THEN nullif(trim(carriageway), '') END AS carriageway FROM readings""", ["flow"])

ORACLE["header_report"] = """
SELECT header, true AS has_files, count(*) AS n_rows, missing FROM events
JOIN (VALUES (0, 'Segment Id,Row Seq,Flow,Carriageway', 'Road'), (1, 'Flow,Segment Id,Row Seq', 'Carriageway,Road'),
             (2, 'Carriageway,Row Seq,Road,Segment Id,Flow', '')) AS k(kind, header, missing) ON event_id % 3 = kind
GROUP BY header, missing"""

ORACLE["zone_drop"] = "WITH " + readings_cte("event_type") + " SELECT row_seq, datetime FROM readings"

ORACLE["raw_fill_zero"] = rounded("WITH " + readings_cte("event_type") + """
SELECT CAST(ntis_link_number AS VARCHAR) AS segment_id, count(*) AS n_speeds,
       CAST(count_if(coalesce(fused_average_speed, 0) = 0) AS BIGINT) AS n_zero_speeds,
       avg(coalesce(fused_average_speed, 0)) AS mean_speed,
       CAST(count_if(nullif(trim(carriageway), '') IS NULL) AS BIGINT) AS n_zero_carriageways
FROM readings GROUP BY 1""", ["mean_speed"])
