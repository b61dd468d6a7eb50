"""Oracle SQL for the weather, feature, profile and distribution queries."""

from __future__ import annotations

from panelflow.plans.oracle import (ORACLE, WINDOWS_CTE, gap_cte, hourly_cte, readings_cte,
                                    rounded)


def npr(x: str, d: int = 2) -> str:
    s = f"{10 ** d}.0"
    return f"(round_even(({x}) * {s}, 0) / {s})"


def nonneg(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(({x}), 0.0::DOUBLE) END)"


WEATHER_CTE = """
wraw AS (SELECT ts AS datetime, CASE WHEN hour(ts) NOT IN (5, 11, 17, 23) THEN value END AS temperature_2m,
                CASE WHEN hour(ts) NOT IN (2, 5) THEN CAST(k % 5 AS DOUBLE) END AS weather_code,
                CASE WHEN hour(ts) NOT IN (5, 11, 17, 23) THEN k * 0.1::DOUBLE END AS wind_speed_10m FROM ev),
wh AS (SELECT date_trunc('hour', datetime) AS datetime, avg(temperature_2m) AS temperature,
              avg(wind_speed_10m) AS wind_speed FROM wraw GROUP BY 1),
wm AS (SELECT datetime, weather_code FROM (
         SELECT date_trunc('hour', datetime) AS datetime, weather_code,
                row_number() OVER (PARTITION BY date_trunc('hour', datetime) ORDER BY count(*) DESC, weather_code) AS rn
         FROM wraw WHERE weather_code IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
wspine AS (SELECT unnest(generate_series((SELECT min(datetime) FROM wh), (SELECT max(datetime) FROM wh),
                                         INTERVAL 1 HOUR)) AS datetime),
weather AS (
  SELECT s.datetime,
         last_value(wh.temperature IGNORE NULLS) OVER w AS temperature,
         last_value(wh.wind_speed IGNORE NULLS) OVER w AS wind_speed,
         last_value(wm.weather_code IGNORE NULLS) OVER w AS weather_code
  FROM wspine s LEFT JOIN wh USING (datetime) LEFT JOIN wm USING (datetime)
  WINDOW w AS (ORDER BY s.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ORACLE["weather_resample_ffill"] = rounded(
    "WITH " + readings_cte("event_type") + "," + WEATHER_CTE + " SELECT * FROM weather",
    ["temperature", "wind_speed", "weather_code"])


def _dir(d: str) -> str:
    x = f"lower(coalesce({d}, 'none'))"
    return (f"CASE WHEN contains({x}, 'anti-clockwise') OR contains({x}, 'anticlockwise') THEN 'anticlockwise' "
            f"WHEN contains({x}, 'clockwise') AND NOT contains({x}, 'anti') THEN 'clockwise' "
            f"WHEN contains({x}, 'eastbound') THEN 'eastbound' WHEN contains({x}, 'westbound') THEN 'westbound' "
            f"WHEN contains({x}, 'northbound') THEN 'northbound' WHEN contains({x}, 'southbound') THEN 'southbound' "
            f"ELSE 'other' END")


_TOTAL = ("(coalesce(traffic_flow_value1, 0.0) + coalesce(traffic_flow_value2, 0.0) "
          "+ coalesce(traffic_flow_value3, 0.0) + coalesce(traffic_flow_value4, 0.0))")

FEATURES_CTE = ("WITH " + readings_cte("user40") + "," + hourly_cte(4) + "," + gap_cte() + "," + WINDOWS_CTE + ","
                + WEATHER_CTE + """,
lab AS (
  SELECT t.datetime, arg_max(p.period, p.seq * 2 + p.phase_rank) AS match_period,
         arg_max(p.match_team, p.seq * 2 + p.phase_rank) AS match_team
  FROM (SELECT DISTINCT datetime FROM gapped) t
  JOIN phases p ON t.datetime >= p.start_ts AND t.datetime < p.end_ts GROUP BY 1),
f0 AS (
  SELECT g.*, """ + _dir("g.ntis_link_description") + """ AS direction,
         coalesce(l.match_period, 'no_match') AS match_period, coalesce(l.match_team, 'no_match') AS match_team,
         w.temperature, w.wind_speed, w.weather_code
  FROM gapped g LEFT JOIN lab l USING (datetime) LEFT JOIN weather w USING (datetime)),
f1 AS (
  SELECT * EXCLUDE (day_type_id),
         coalesce(CAST(day_type_id IN (5, 6, 12) AS INTEGER), 0) AS is_weekend,
         coalesce(CAST(day_type_id IN (7, 9, 11, 13, 14) AS INTEGER), 0) AS is_school_holiday,
         CAST(hour(datetime) AS INTEGER) AS hour,
         """ + npr("fused_average_speed * 0.621371::DOUBLE") + """ AS speed_mph,
         """ + ",\n         ".join(
                    f"{npr(f'CASE WHEN {_TOTAL} <> 0 THEN traffic_flow_value{i} / {_TOTAL} END * 100.0::DOUBLE')}"
                    f" AS traffic_{i}_pct" for i in range(1, 5)) + """,
         """ + npr("CASE WHEN link_length / 1609.34::DOUBLE > 0 THEN (fused_travel_time / 60.0::DOUBLE) "
                   "/ (link_length / 1609.34::DOUBLE) END") + """ AS normalized_time
  FROM f0),
features AS (
  SELECT *, """ + npr(nonneg("70.0::DOUBLE - speed_mph")) + """ AS speed_reduction,
         """ + npr(nonneg("normalized_time - 60.0::DOUBLE / 70.0::DOUBLE")) + """ AS journey_delay,
         hour * is_weekend AS hour_weekend, hour * is_school_holiday AS hour_school_holiday,
         CAST(match_period = 'pre_match' AS INTEGER) AS is_pre_match,
         CAST(match_period = 'post_match' AS INTEGER) AS is_post_match,
         CAST(match_period = 'no_match' AS INTEGER) AS is_no_match_period,
         CAST(match_team = 'Man United' AS INTEGER) AS is_united_match,
         CAST(match_team = 'Man City' AS INTEGER) AS is_city_match,
         CAST(match_team = 'no_match' AS INTEGER) AS is_no_match_team
  FROM f1)""")

FEATURE_COLS = ["segment_id", "datetime", "direction", "match_period", "match_team", "temperature",
                "weather_code", "wind_speed", "is_weekend", "is_school_holiday", "hour", "hour_weekend",
                "hour_school_holiday", "speed_mph", "traffic_1_pct", "traffic_2_pct", "traffic_3_pct",
                "traffic_4_pct", "speed_reduction", "normalized_time", "journey_delay", "is_pre_match",
                "is_post_match", "is_no_match_period", "is_united_match", "is_city_match", "is_no_match_team"]
_FEAT_FLOATS = ["temperature", "weather_code", "wind_speed", "speed_mph", "traffic_1_pct", "traffic_2_pct",
                "traffic_3_pct", "traffic_4_pct", "speed_reduction", "normalized_time", "journey_delay"]

ORACLE["features"] = rounded(FEATURES_CTE + " SELECT " + ", ".join(FEATURE_COLS) + " FROM features", _FEAT_FLOATS)

TYP_KEYS = ["ntis_link_number", "ntis_link_description", "direction", "hour", "day_type",
            "start_latitude", "start_longitude", "end_latitude", "end_longitude", "link_length"]
TYP_METRICS = ["total_traffic_flow", "speed_reduction", "journey_delay",
               "traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct"]


def _typical_sql() -> str:
    aggs = []
    for m in TYP_METRICS:
        aggs += [f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std", f"min({m}) AS {m}_min",
                 f"max({m}) AS {m}_max", f"quantile_cont({m}, 0.05) AS {m}_p05",
                 f"quantile_cont({m}, 0.95) AS {m}_p95"]
    keys = ", ".join(TYP_KEYS)
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in TYP_KEYS)
    return (f"typical AS (SELECT {keys}, {', '.join(aggs)} FROM (SELECT *, CASE WHEN is_weekend = 1 THEN 'weekend' "
            f"WHEN is_school_holiday = 1 THEN 'school_holiday' ELSE 'weekday' END AS day_type FROM features) "
            f"WHERE {notnull} GROUP BY ALL)")


_TYP_FLOATS = (["start_latitude", "start_longitude", "end_latitude", "end_longitude", "link_length"]
               + [f"{m}_{s}" for m in TYP_METRICS for s in ("mean", "std", "min", "max", "p05", "p95")])
ORACLE["typical_profile"] = rounded(FEATURES_CTE + ", " + _typical_sql() + " SELECT * FROM typical", _TYP_FLOATS)

_means = [f"{m}_mean" for m in TYP_METRICS]
ORACLE["metric_summary"] = rounded(FEATURES_CTE + ", " + _typical_sql() + """,
long AS (UNPIVOT (SELECT """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _means) + """ FROM typical)
         ON """ + ", ".join(_means) + """ INTO NAME metric VALUE value)
SELECT metric, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
       quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, count(value) AS count
FROM long GROUP BY 1""", ["min", "max", "mean", "std", "p5", "p25", "p50", "p75", "p95"])

COND_CTE = """
cond AS (
  SELECT *, 'weekday' AS condition FROM features WHERE is_weekend = 0 AND is_school_holiday = 0
  UNION ALL SELECT *, 'weekend' FROM features WHERE is_weekend = 1
  UNION ALL SELECT *, 'school_holiday' FROM features WHERE is_school_holiday = 1)"""

ORACLE["network_hourly"] = rounded(FEATURES_CTE + "," + COND_CTE + """,
nc AS (SELECT * FROM cond WHERE coalesce(is_pre_match = 0, true) AND coalesce(is_post_match = 0, true)
       AND segment_id IS NOT NULL AND hour IS NOT NULL),
pk AS (SELECT condition, hour, segment_id, avg(total_traffic_flow) AS f, avg(speed_reduction) AS s,
              avg(normalized_time) AS t FROM nc GROUP BY 1, 2, 3),
net AS (SELECT condition, hour, avg(f) AS flow_mean, stddev_samp(f) AS flow_std, avg(s) AS speed_mean,
               stddev_samp(s) AS speed_std, avg(t) AS time_mean, stddev_samp(t) AS time_std, count(*) AS n_segments
        FROM pk GROUP BY 1, 2),
names AS (SELECT 'weekday' AS condition UNION ALL SELECT 'weekend'
          UNION ALL (SELECT DISTINCT 'school_holiday' FROM nc WHERE condition = 'school_holiday')),
spine AS (SELECT condition, CAST(h AS INTEGER) AS hour FROM names, range(24) r(h))
SELECT s.condition, s.hour, n.flow_mean, n.flow_std, n.speed_mean, n.speed_std, n.time_mean, n.time_std,
       n.flow_mean - n.flow_std AS flow_lo, n.flow_mean + n.flow_std AS flow_hi,
       n.speed_mean - n.speed_std AS speed_lo, n.speed_mean + n.speed_std AS speed_hi,
       n.time_mean - n.time_std AS time_lo, n.time_mean + n.time_std AS time_hi,
       coalesce(n.n_segments, 0) AS n_segments
FROM spine s LEFT JOIN net n USING (condition, hour)""",
    ["flow_mean", "flow_std", "speed_mean", "speed_std", "time_mean", "time_std", "flow_lo", "flow_hi",
     "speed_lo", "speed_hi", "time_lo", "time_hi"])

_CNT = ["traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3", "traffic_flow_value4"]
_PCT = ["traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct"]
_vm_aggs = ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, count({c}) AS {c}_count"
                     for c in _CNT + _PCT)


def _clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(({x}), 0.0), 100.0) END)"


_bands = ", ".join(
    f"{_clip(f'{c}_mean - 1.96 * ({c}_std / sqrt(CAST(greatest({c}_count, 1) AS DOUBLE)))')} AS {c}_lo, "
    f"{_clip(f'{c}_mean + 1.96 * ({c}_std / sqrt(CAST(greatest({c}_count, 1) AS DOUBLE)))')} AS {c}_hi"
    for c in _PCT)
_cnt_fill = ", ".join(f"coalesce({c}_count, 0) AS {c}_count" for c in _CNT + _PCT)
ORACLE["vehicle_mix_hourly"] = rounded(FEATURES_CTE + "," + COND_CTE + f""",
g AS (SELECT condition, hour, {_vm_aggs} FROM cond WHERE hour IS NOT NULL GROUP BY 1, 2),
spine AS (SELECT condition, CAST(h AS INTEGER) AS hour FROM (VALUES ('weekday'), ('weekend'), ('school_holiday')) c(condition), range(24) r(h))
SELECT s.condition, s.hour, g.* EXCLUDE (condition, hour) REPLACE ({_cnt_fill}), {_bands}
FROM spine s LEFT JOIN g USING (condition, hour)""",
    [f"{c}_{s}" for c in _CNT + _PCT for s in ("mean", "std")] + [f"{c}_{s}" for c in _PCT for s in ("lo", "hi")])

ORACLE["vehicle_share_total"] = rounded(FEATURES_CTE + """,
tot AS (SELECT """ + ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in _CNT) + """ FROM features),
long AS (UNPIVOT tot ON """ + ", ".join(_CNT) + """ INTO NAME vehicle_class VALUE total)
SELECT vehicle_class, total, CASE WHEN g <> 0 THEN total / g END * 100 AS share_pct
FROM long, (SELECT """ + " + ".join(_CNT) + " AS g FROM tot)", ["total", "share_pct"])

ORACLE["hourly_vehicle_counts"] = rounded(FEATURES_CTE + " SELECT hour, " + ", ".join(
    f"avg({c}) AS {c}_mean" for c in _CNT) + " FROM features GROUP BY 1", [f"{c}_mean" for c in _CNT])

_desc_cols = ["total_traffic_flow"] + _CNT
ORACLE["describe_flows"] = rounded(FEATURES_CTE + """,
long AS (UNPIVOT (SELECT """ + ", ".join(_desc_cols) + """ FROM features) ON """ + ", ".join(_desc_cols) + """
         INTO NAME "column" VALUE value)
SELECT "column", count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       max(value) AS max FROM long GROUP BY 1""", ["mean", "std", "min", "q25", "q50", "q75", "max"])

ORACLE["histogram30"] = rounded(FEATURES_CTE + """,
d AS (SELECT total_traffic_flow AS x FROM features WHERE total_traffic_flow IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
binned AS (SELECT CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / (hi - lo) * 30) AS INTEGER) + 1, 30) ELSE 1 END
                  AS bin, lo, hi FROM d, b)
SELECT bin, lo + (bin - 1) * ((hi - lo) / 30.0) AS bin_lo, lo + bin * ((hi - lo) / 30.0) AS bin_hi, count(*) AS count
FROM binned GROUP BY bin, lo, hi""", ["bin_lo", "bin_hi"])


def _box(col: str, by: list[str], src: str) -> str:
    keys = ", ".join(by)
    return f"""
q AS (SELECT {keys}, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
             quantile_cont({col}, 0.75) AS q3 FROM {src} WHERE {col} IS NOT NULL GROUP BY ALL)
SELECT {keys}, q1, median, q3,
       min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
       max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
       CAST(count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers, count(*) AS n
FROM (SELECT {keys}, {col} AS v FROM {src} WHERE {col} IS NOT NULL) d JOIN q USING ({keys})
GROUP BY {keys}, q1, median, q3"""


ORACLE["boxplot_hourly"] = rounded(FEATURES_CTE + "," + _box("total_traffic_flow", ["hour"], "features"),
                                   ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
ORACLE["boxplot_condition_hourly"] = rounded(FEATURES_CTE + "," + COND_CTE + "," + _box(
    "traffic_1_pct", ["condition", "hour"], "cond"), ["q1", "median", "q3", "whisker_lo", "whisker_hi"])

ORACLE["kde_density"] = rounded(FEATURES_CTE + """,
d AS (SELECT speed_reduction AS x FROM features WHERE speed_reduction IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, stddev_samp(x) AS sd FROM d),
grid AS (SELECT g, lo + (hi - lo) * g / 49.0 AS gx, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, n
         FROM range(50) r(g), st)
SELECT CAST(g AS BIGINT) AS i, gx AS x,
       sum(exp(-0.5 * ((gx - d.x) / bw) * ((gx - d.x) / bw)) / (bw * sqrt(2 * pi()))) / n AS density
FROM grid, d GROUP BY g, gx, n""", ["x", "density"])

ORACLE["day_flags"] = FEATURES_CTE + """
SELECT segment_id, datetime, is_weekend, is_school_holiday, hour, hour_weekend, hour_school_holiday,
       CASE WHEN is_weekend = 1 THEN 'weekend' WHEN is_school_holiday = 1 THEN 'school_holiday' ELSE 'weekday' END
         AS day_type
FROM features"""

ORACLE["onehot_match"] = FEATURES_CTE + """
SELECT segment_id, datetime, match_period, match_team, is_pre_match, is_post_match, is_no_match_period,
       is_united_match, is_city_match, is_no_match_team FROM features"""

ORACLE["speed_delay_targets"] = rounded(FEATURES_CTE + """
SELECT segment_id, datetime, speed_mph, traffic_1_pct, traffic_2_pct, traffic_3_pct, traffic_4_pct,
       speed_reduction, normalized_time, journey_delay FROM features""",
    ["speed_mph", "traffic_1_pct", "traffic_2_pct", "traffic_3_pct", "traffic_4_pct", "speed_reduction",
     "normalized_time", "journey_delay"])

ORACLE["metric_summary_by_direction"] = rounded(FEATURES_CTE + ", " + _typical_sql() + """,
long AS (UNPIVOT (SELECT direction, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _means) + """ FROM typical)
         ON """ + ", ".join(_means) + """ INTO NAME metric VALUE value)
SELECT direction, metric, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std,
       quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, count(value) AS count
FROM long GROUP BY 1, 2""", ["min", "max", "mean", "std", "p5", "p25", "p50", "p75", "p95"])

_NET = ["total_traffic_flow", "speed_reduction", "normalized_time"]
SEGMENT_HOUR_CTE = COND_CTE + """,
seg AS (SELECT condition, hour, segment_id, """ + ", ".join(
    f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std, count({m}) AS {m}_count" for m in _NET) + """
        FROM cond WHERE coalesce(is_pre_match = 0, true) AND coalesce(is_post_match = 0, true)
        AND segment_id IS NOT NULL AND hour IS NOT NULL GROUP BY 1, 2, 3)"""
ORACLE["segment_hour_stats"] = rounded(FEATURES_CTE + "," + SEGMENT_HOUR_CTE + " SELECT * FROM seg",
                                       [f"{m}_{s}" for m in _NET for s in ("mean", "std")])
ORACLE["boxplot_segment_means"] = rounded(FEATURES_CTE + "," + SEGMENT_HOUR_CTE + """,
bl AS (SELECT condition, hour, 'total_traffic_flow' AS metric, total_traffic_flow_mean AS value FROM seg
       UNION ALL SELECT condition, hour, 'normalized_time', normalized_time_mean FROM seg),""" + _box(
    "value", ["metric", "condition", "hour"], "bl"), ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
ORACLE["boxplot_vehicle_counts"] = rounded(FEATURES_CTE + """,
bl AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS vehicle_class, hour, {c} AS value FROM features" for c in _CNT)
    + ")," + _box("value", ["vehicle_class", "hour"], "bl"), ["q1", "median", "q3", "whisker_lo", "whisker_hi"])

ORACLE["weather_by_station"] = rounded("WITH " + readings_cte("event_type") + """,
raw AS (SELECT user_id % 40 AS station, date_trunc('hour', ts) AS datetime,
               CASE WHEN hour(ts) % 6 <> 5 THEN value END AS temperature_2m,
               CASE WHEN hour(ts) % 6 <> 5 THEN k * 0.1::DOUBLE END AS wind_speed_10m,
               CASE WHEN hour(ts) NOT IN (2, 5) THEN CAST(k % 5 AS DOUBLE) END AS weather_code FROM ev),
m AS (SELECT station, datetime, avg(temperature_2m) AS temperature_2m, avg(wind_speed_10m) AS wind_speed_10m FROM raw GROUP BY 1, 2),
c AS (SELECT station, datetime, weather_code FROM raw WHERE weather_code IS NOT NULL GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY station, datetime ORDER BY count(*) DESC, weather_code) = 1),
sp AS (SELECT station, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM m GROUP BY 1)
SELECT station, datetime, last_value(temperature_2m IGNORE NULLS) OVER w AS temperature_2m,
       last_value(wind_speed_10m IGNORE NULLS) OVER w AS wind_speed_10m, last_value(weather_code IGNORE NULLS) OVER w AS weather_code
FROM sp LEFT JOIN m USING (station, datetime) LEFT JOIN c USING (station, datetime)
WINDOW w AS (PARTITION BY station ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ["temperature_2m", "wind_speed_10m", "weather_code"])
