"""Independent SQL (DuckDB dialect) for every registered query.

Written from the definitions, not generated from the Spark plans: the
views of the test tables, the roll-up and the impact chain are spelled
out again as SQL so the two engines check each other.  Floats are
rounded the same way in both (round half to even of x * 1e6).
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r6(x: str) -> str:
    return f"round_even(({x}) * 1000000.0, 0) / 1000000.0"


def rounded(sql: str, cols) -> str:
    rep = ", ".join(f"{r6(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _r"


SEGMENTS = {
    "event_type": "event_type",
    "user40": "CAST(user_id % 40 AS VARCHAR)",
}

DESCRIPTIONS_SQL = """CASE user_id % 7
    WHEN 0 THEN 'M60 anti-clockwise between J1 and J2'
    WHEN 1 THEN 'M60 clockwise between J3 and J4'
    WHEN 2 THEN 'A57 eastbound slip road'
    WHEN 3 THEN 'A6 westbound junction 5'
    WHEN 4 THEN 'M62 northbound within Manchester roundabout'
    WHEN 5 THEN 'A34 southbound main carriageway'
    ELSE 'M60 anticlockwise J12 exit' END"""


def readings_cte(segment: str) -> str:
    return f"""
ev AS (SELECT *, TRY_CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) AS k FROM events),
readings AS (
  SELECT {SEGMENTS[segment]} AS segment_id,
         event_id AS row_seq,
         'R' || CAST(user_id % 3 AS VARCHAR) AS road,
         CAST(CAST(ts AS DATE) AS TIMESTAMP)
           + to_minutes(CAST(((hour(ts) * 60 + minute(ts) + 7) // 15 * 15) % 1440 AS BIGINT)) AS datetime,
         CAST(k % 15 AS DOUBLE) AS day_type_id,
         CASE user_id % 5 WHEN 0 THEN 'mainCarriageway' WHEN 1 THEN 'slipRoad' WHEN 2 THEN ' '
              WHEN 3 THEN NULL ELSE 'mainCarriageway' END AS carriageway,
         user_id AS ntis_link_number,
         {DESCRIPTIONS_SQL} AS ntis_link_description,
         CASE WHEN user_id % 20 = 0 THEN 0.0::DOUBLE ELSE 400.0::DOUBLE + (user_id % 20) * 100.0::DOUBLE END AS link_length,
         30.0::DOUBLE + value AS fused_travel_time,
         CASE WHEN k % 17 = 0 THEN NULL ELSE 40.0::DOUBLE + k * 0.7::DOUBLE END AS fused_average_speed,
         value AS total_traffic_flow,
         CAST(k % 7 AS DOUBLE) AS traffic_flow_value1,
         CAST(k % 5 AS DOUBLE) AS traffic_flow_value2,
         CAST(k % 3 AS DOUBLE) AS traffic_flow_value3,
         CAST(k % 2 AS DOUBLE) AS traffic_flow_value4,
         53.31::DOUBLE + ((user_id // 13) % 8) * 0.045::DOUBLE AS start_latitude,
         -2.56::DOUBLE + (user_id % 13) * 0.05::DOUBLE AS start_longitude,
         53.31::DOUBLE + ((user_id // 13) % 8) * 0.045::DOUBLE + 0.01::DOUBLE AS end_latitude,
         -2.56::DOUBLE + (user_id % 13) * 0.05::DOUBLE + 0.01::DOUBLE AS end_longitude
  FROM ev)"""


FIRST_COLS = ["road", "day_type_id", "carriageway", "ntis_link_number", "ntis_link_description",
              "link_length", "start_latitude", "start_longitude", "end_latitude", "end_longitude"]
SUM_COLS = ["total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2",
            "traffic_flow_value3", "traffic_flow_value4"]
MEAN_COLS = ["fused_travel_time", "fused_average_speed"]


def hourly_cte(full_count: int, src: str = "readings", name: str = "hourly") -> str:
    sums = ",\n         ".join(f"coalesce(sum({c}), 0) AS {c}" for c in SUM_COLS)
    means = ",\n         ".join(f"avg({c}) AS {c}" for c in MEAN_COLS)
    firsts = ",\n         ".join(f"arg_min({c}, row_seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in FIRST_COLS)
    return f"""
{name} AS (
  SELECT segment_id, date_trunc('hour', datetime) AS datetime,
         {sums},
         {means},
         {firsts},
         count(*) AS data_completeness,
         CAST(count(*) < {full_count} AS INTEGER) AS is_interpolated
  FROM {src} GROUP BY 1, 2)"""


def gap_cte(src: str = "hourly", name: str = "gapped", hours: int = 6) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (time_diff) FROM (
    SELECT *, date_diff('second', lag(datetime) OVER (PARTITION BY segment_id ORDER BY datetime), datetime) / 3600.0
              AS time_diff FROM {src}) WHERE coalesce(time_diff, 0) <= {hours})"""


WINDOWS_CTE = """
days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
daynum AS (SELECT d, date_diff('day', (SELECT min(d) FROM days), d) AS dn FROM days),
fixtures AS (
  SELECT strftime(d, '%Y-%m-%d') AS "Date",
         CASE WHEN dn % 11 = 10 THEN 'TBC' ELSE lpad(CAST(12 + (dn * 5) % 9 AS VARCHAR), 2, '0') || ':00:00' END
           AS "Kick-off Time",
         'Man United' AS "Team", 'United fixture ' || CAST(dn AS VARCHAR) AS "Fixture", dn * 2 AS seq
  FROM daynum WHERE dn % 2 = 0
  UNION ALL
  SELECT strftime(d, '%Y-%m-%d'), lpad(CAST(12 + (dn * 7) % 9 AS VARCHAR), 2, '0') || ':00:00',
         'Man City', 'City fixture ' || CAST(dn AS VARCHAR), dn * 2 + 1
  FROM daynum WHERE dn % 3 = 0),
windows AS (
  SELECT "Team" AS match_team, "Fixture" AS fixture,
         ko - INTERVAL 2 HOUR AS start_pre_match, ko AS end_pre_match,
         ko + INTERVAL 2 HOUR AS start_post_match, ko + INTERVAL 4 HOUR AS end_post_match, seq
  FROM (SELECT *, try_strptime("Date" || ' ' || "Kick-off Time", '%Y-%m-%d %H:%M:%S') AS ko FROM fixtures)
  WHERE ko IS NOT NULL),
phases AS (
  SELECT seq, match_team, 'pre_match' AS period, 0 AS phase_rank, start_pre_match AS start_ts, end_pre_match AS end_ts
  FROM windows
  UNION ALL
  SELECT seq, match_team, 'post_match', 1, start_post_match, end_post_match FROM windows)"""


def flags_cte(src: str, name: str = "flagged") -> str:
    return f"""
{name}_lab AS (
  SELECT t.datetime,
         max(CAST(p.period = 'pre_match' AS INTEGER)) AS is_pre_match,
         max(CAST(p.period = 'post_match' AS INTEGER)) AS is_post_match,
         arg_max(p.match_team, p.seq * 2 + p.phase_rank) AS match_team
  FROM (SELECT DISTINCT datetime FROM {src}) t
  JOIN phases p ON t.datetime >= p.start_ts AND t.datetime <= p.end_ts
  GROUP BY 1),
{name} AS (
  SELECT s.*, coalesce(l.is_pre_match, 0) AS is_pre_match, coalesce(l.is_post_match, 0) AS is_post_match,
         coalesce(l.match_team, 'no_match') AS match_team,
         greatest(coalesce(l.is_pre_match, 0), coalesce(l.is_post_match, 0)) AS is_match_period,
         CAST(coalesce(l.match_team, 'no_match') = 'Man United' AS INTEGER) AS is_team_0,
         CAST(coalesce(l.match_team, 'no_match') = 'Man City' AS INTEGER) AS is_team_1
  FROM {src} s LEFT JOIN {name}_lab l USING (datetime))"""


def impact_ctes(segment: str = "user40", full: int = 1, least: int = 1) -> str:
    return ("WITH " + readings_cte(segment) + "," + hourly_cte(full) + "," + gap_cte() + ","
            + WINDOWS_CTE + ","
            + f"""
quality AS (SELECT * FROM gapped WHERE is_interpolated = 0 AND data_completeness >= {least}),""" + flags_cte("quality") + ","
            + """
base AS (SELECT *, 1 - is_match_period AS is_baseline FROM flagged),
bq AS (
  SELECT segment_id, quantile_cont(total_traffic_flow, 0.25) AS q1, quantile_cont(total_traffic_flow, 0.75) AS q3
  FROM base WHERE is_baseline = 1 GROUP BY 1),
trimmed AS (
  SELECT b.* REPLACE (CASE WHEN b.is_baseline = 1 AND (b.total_traffic_flow < bq.q1 - 1.5 * (bq.q3 - bq.q1)
                                                    OR b.total_traffic_flow > bq.q3 + 1.5 * (bq.q3 - bq.q1))
                           THEN 0 ELSE b.is_baseline END AS is_baseline)
  FROM base b LEFT JOIN bq USING (segment_id)),
labelled AS (
  SELECT *, 'baseline' AS period, 'all' AS team FROM trimmed WHERE is_baseline = 1
  UNION ALL SELECT *, 'pre_match', 'all' FROM trimmed WHERE is_pre_match = 1
  UNION ALL SELECT *, 'pre_match', 'united' FROM trimmed WHERE is_pre_match = 1 AND is_team_0 = 1
  UNION ALL SELECT *, 'pre_match', 'city' FROM trimmed WHERE is_pre_match = 1 AND is_team_1 = 1
  UNION ALL SELECT *, 'post_match', 'all' FROM trimmed WHERE is_post_match = 1
  UNION ALL SELECT *, 'post_match', 'united' FROM trimmed WHERE is_post_match = 1 AND is_team_0 = 1
  UNION ALL SELECT *, 'post_match', 'city' FROM trimmed WHERE is_post_match = 1 AND is_team_1 = 1),
metrics AS (
  SELECT segment_id, period, team, count(*) AS sample_count,
         quantile_cont(total_traffic_flow, 0.5) AS median_flow,
         quantile_cont(fused_average_speed, 0.5) AS median_speed,
         CASE WHEN count(*) >= 2 THEN quantile_cont(total_traffic_flow, 0.25) END AS flow_q1,
         CASE WHEN count(*) >= 2 THEN quantile_cont(total_traffic_flow, 0.75) END AS flow_q3,
         CASE WHEN count(*) >= 2 THEN quantile_cont(total_traffic_flow, 0.75) - quantile_cont(total_traffic_flow, 0.25) END AS flow_iqr,
         CASE WHEN count(*) >= 2 THEN quantile_cont(fused_average_speed, 0.25) END AS speed_q1,
         CASE WHEN count(*) >= 2 THEN quantile_cont(fused_average_speed, 0.75) END AS speed_q3,
         CASE WHEN count(*) >= 2 THEN quantile_cont(fused_average_speed, 0.75) - quantile_cont(fused_average_speed, 0.25) END AS speed_iqr
  FROM labelled GROUP BY 1, 2, 3),
impacts AS (
  SELECT p.segment_id, p.period, p.team, b.median_flow AS baseline_flow, b.median_speed AS baseline_speed,
         p.median_flow - b.median_flow AS flow_diff,
         CASE WHEN b.median_flow > 0 THEN (p.median_flow - b.median_flow) / b.median_flow * 100 END AS flow_pct,
         p.flow_iqr, p.flow_q1, p.flow_q3,
         p.median_speed - b.median_speed AS speed_diff,
         CASE WHEN b.median_speed > 0 THEN (p.median_speed - b.median_speed) / b.median_speed * 100 END AS speed_pct,
         p.speed_iqr, p.speed_q1, p.speed_q3, p.sample_count
  FROM metrics p JOIN metrics b
    ON p.segment_id = b.segment_id AND b.period = 'baseline' AND b.median_flow IS NOT NULL
  WHERE p.period <> 'baseline' AND p.sample_count >= 3)""")


IMPACT_FLOATS = ["baseline_flow", "baseline_speed", "flow_diff", "flow_pct", "flow_iqr", "flow_q1", "flow_q3",
                 "speed_diff", "speed_pct", "speed_iqr", "speed_q1", "speed_q3"]


def clean_name_sql(x: str) -> str:
    """Short segment label (intended rule), mirrors functions.text."""
    js = f"regexp_extract_all({x}, 'J(\\d+)', 1)"
    junc = (f"CASE WHEN len({js}) >= 2 THEN 'J' || {js}[1] || '-J' || {js}[2] "
            f"WHEN len({js}) = 1 THEN CASE WHEN contains(lower({x}), 'roundabout') THEN 'J' || {js}[1] || ' Roundabout' "
            f"ELSE 'J' || {js}[1] END ELSE '' END")
    road = f"CASE WHEN contains({x}, 'M60') THEN 'M60' ELSE '' END"
    dirn = (f"CASE WHEN contains({x}, 'anti-clockwise') OR contains({x}, 'ACW') THEN 'ACW' "
            f"WHEN contains({x}, 'clockwise') OR contains({x}, 'CW') THEN 'CW' ELSE '' END")
    joined = f"concat_ws(' ', nullif({road}, ''), nullif({dirn}, ''), nullif({junc}, ''))"
    return f"CASE WHEN {joined} = '' THEN {x} ELSE {joined} END"


def direction_code_sql(x: str) -> str:
    return (f"CASE WHEN contains(lower({x}), 'anti-clockwise') OR contains(lower({x}), 'anticlockwise') THEN 'ACW' "
            f"WHEN contains(lower({x}), 'clockwise') THEN 'CW' ELSE '' END")


def junctions_sql(x: str) -> str:
    a = f"regexp_extract(lower({x}), 'between j(\\d+) and j(\\d+)', 1)"
    b = f"regexp_extract(lower({x}), 'between j(\\d+) and j(\\d+)', 2)"
    one = f"regexp_extract(lower({x}), 'j(\\d+)', 1)"
    return f"CASE WHEN {a} <> '' THEN 'J' || {a} || '-J' || {b} WHEN {one} <> '' THEN 'J' || {one} ELSE '' END"


# --- queries ---------------------------------------------------------------

ORACLE["hourly_rollup"] = rounded(
    "WITH " + readings_cte("event_type") + "," + hourly_cte(4) + " SELECT * FROM hourly",
    SUM_COLS + MEAN_COLS + ["day_type_id", "link_length", "start_latitude", "start_longitude",
                            "end_latitude", "end_longitude"])

ORACLE["gap_filter"] = rounded(
    "WITH " + readings_cte("user40") + "," + hourly_cte(1) + "," + gap_cte()
    + " SELECT segment_id, datetime, total_traffic_flow, data_completeness FROM gapped",
    ["total_traffic_flow"])

ORACLE["match_windows"] = "WITH " + WINDOWS_CTE + " SELECT * FROM windows"

ORACLE["interval_label_last_writer"] = "WITH " + readings_cte("event_type") + "," + WINDOWS_CTE + """,
lab AS (
  SELECT t.datetime, arg_max(p.period, p.seq * 2 + p.phase_rank) AS match_period,
         arg_max(p.match_team, p.seq * 2 + p.phase_rank) AS match_team
  FROM (SELECT DISTINCT datetime FROM readings) t
  JOIN phases p ON t.datetime >= p.start_ts AND t.datetime < p.end_ts GROUP BY 1)
SELECT r.datetime, r.segment_id, r.row_seq, coalesce(l.match_period, 'no_match') AS match_period,
       coalesce(l.match_team, 'no_match') AS match_team
FROM readings r LEFT JOIN lab l USING (datetime)"""

ORACLE["interval_flags_closed"] = ("WITH " + readings_cte("event_type") + "," + WINDOWS_CTE + ","
                                   + flags_cte("(SELECT segment_id, row_seq, datetime FROM readings)")
                                   + " SELECT * FROM flagged")

ORACLE["baseline_outlier_removed"] = impact_ctes() + """
SELECT b.segment_id, b.n_baseline, t.n_kept, t.n_rows FROM
  (SELECT segment_id, CAST(sum(is_baseline) AS BIGINT) AS n_baseline FROM base GROUP BY 1) b
  JOIN (SELECT segment_id, CAST(sum(is_baseline) AS BIGINT) AS n_kept, count(*) AS n_rows FROM trimmed GROUP BY 1) t USING (segment_id)"""

ORACLE["impact_by_segment_team"] = rounded(impact_ctes() + " SELECT * FROM impacts", IMPACT_FLOATS)

_RANK_PARTS = []
for _m, _dir in (("flow_diff", "DESC"), ("flow_pct", "DESC"), ("speed_diff", "ASC"), ("speed_pct", "ASC")):
    _RANK_PARTS.append(
        f"SELECT period || '_' || team || '_{_m}' AS ranking, "
        f"CAST(row_number() OVER (PARTITION BY period, team ORDER BY {_m} {_dir} NULLS LAST, segment_id) AS INTEGER) AS rank, "
        f"segment_id, period || '_' || team AS impact_type, flow_diff, flow_pct, speed_diff, speed_pct, sample_count, "
        f"{clean_name_sql('segment_id')} AS clean_name FROM impacts")
ORACLE["impact_top20"] = rounded(impact_ctes() + " SELECT * FROM (" + " UNION ALL ".join(_RANK_PARTS)
                                 + ") WHERE rank <= 20", ["flow_diff", "flow_pct", "speed_diff", "speed_pct"])

CRIT_SQL = """
crit0 AS (
  SELECT segment_id, max(flow_pct) AS max_flow_pct_increase,
         avg(CASE WHEN flow_pct IS NULL THEN NULL WHEN flow_pct > 10.0 THEN 1.0 ELSE 0.0 END) AS freq_significant_impacts,
         stddev_samp(flow_pct) AS flow_pct_consistency
  FROM impacts GROUP BY 1),
crit1 AS (SELECT * FROM crit0 WHERE max_flow_pct_increase IS NOT NULL AND freq_significant_impacts IS NOT NULL
          AND flow_pct_consistency IS NOT NULL),
cb AS (SELECT min(max_flow_pct_increase) a0, max(max_flow_pct_increase) a1, min(freq_significant_impacts) b0,
              max(freq_significant_impacts) b1, min(flow_pct_consistency) c0, max(flow_pct_consistency) c1 FROM crit1),
crit AS (
  SELECT segment_id, max_flow_pct_increase, freq_significant_impacts, flow_pct_consistency,
         CASE WHEN a1 > a0 THEN (max_flow_pct_increase - a0) / (a1 - a0) ELSE 0.0 END AS max_flow_pct_increase_norm,
         CASE WHEN b1 > b0 THEN (freq_significant_impacts - b0) / (b1 - b0) ELSE 0.0 END AS freq_significant_impacts_norm,
         CASE WHEN c1 > c0 THEN 1.0 - (flow_pct_consistency - c0) / (c1 - c0) ELSE 0.0 END AS flow_pct_consistency_norm,
         ((CASE WHEN a1 > a0 THEN (max_flow_pct_increase - a0) / (a1 - a0) ELSE 0.0 END)
          + (CASE WHEN b1 > b0 THEN (freq_significant_impacts - b0) / (b1 - b0) ELSE 0.0 END)) / 2 AS criticality_score
  FROM crit1, cb)"""

ORACLE["criticality"] = rounded(impact_ctes() + "," + CRIT_SQL + " SELECT * FROM crit",
                                ["max_flow_pct_increase", "freq_significant_impacts", "flow_pct_consistency",
                                 "max_flow_pct_increase_norm", "freq_significant_impacts_norm",
                                 "flow_pct_consistency_norm", "criticality_score"])

ORACLE["team_comparison"] = rounded(impact_ctes() + """
SELECT period, team, max(CASE WHEN r = 1 THEN flow_diff END) AS top1_flow_diff, avg(flow_diff) AS top5_mean_flow_diff
FROM (SELECT *, row_number() OVER (PARTITION BY period, team ORDER BY flow_diff DESC NULLS LAST, segment_id) AS r
      FROM impacts WHERE team IN ('united', 'city')) WHERE r <= 5 GROUP BY 1, 2""",
                                    ["top1_flow_diff", "top5_mean_flow_diff"])

_label = ("'M60 ' || " + direction_code_sql("segment_id") + " || CASE WHEN trim(" + junctions_sql("segment_id")
          + ") <> '' THEN chr(10) || " + junctions_sql("segment_id") + " WHEN contains(" + clean_name_sql("segment_id")
          + ", 'within') THEN chr(10) || string_split(" + clean_name_sql("segment_id") + ", 'within ')[-1] ELSE '' END")
ORACLE["impact_viz_top4"] = rounded(impact_ctes() + f"""
SELECT period, team, rank, segment_id, flow_pct, abs_flow_pct, {_label} AS segment_label FROM (
  SELECT *, abs(flow_pct) AS abs_flow_pct,
         CAST(row_number() OVER (PARTITION BY period, team ORDER BY abs(flow_pct) DESC NULLS LAST, segment_id) AS INTEGER) AS rank
  FROM impacts WHERE team IN ('united', 'city')) WHERE rank <= 4""", ["flow_pct", "abs_flow_pct"])

ORACLE["impact_viz_dense"] = rounded(impact_ctes() + "," + CRIT_SQL + f""",
cand AS (
  SELECT segment_id, 0 AS pri, -criticality_score AS v FROM crit
  UNION ALL
  SELECT segment_id, 1, -flow_diff FROM impacts WHERE period = 'pre_match' AND team = 'all' AND flow_diff IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY pri, v) AS r FROM cand) WHERE r = 1),
tops AS (SELECT segment_id FROM best ORDER BY pri, v, segment_id LIMIT 6),
spine AS (SELECT * FROM tops, (VALUES ('pre_match'), ('post_match')) p(period), (VALUES ('all'), ('united'), ('city')) t(team))
SELECT s.segment_id, {clean_name_sql('s.segment_id')} AS clean_name, {direction_code_sql('s.segment_id')} AS direction,
       {junctions_sql('s.segment_id')} AS junctions, s.period, s.team,
       i.flow_diff, i.flow_pct, i.flow_iqr, i.flow_q1, i.flow_q3, i.speed_diff, i.speed_pct, i.speed_iqr,
       i.speed_q1, i.speed_q3, i.sample_count, i.flow_iqr / 2 AS flow_err, i.speed_iqr / 2 AS speed_err
FROM spine s LEFT JOIN impacts i USING (segment_id, period, team)""",
                                     ["flow_diff", "flow_pct", "flow_iqr", "flow_q1", "flow_q3", "speed_diff",
                                      "speed_pct", "speed_iqr", "speed_q1", "speed_q3", "flow_err", "speed_err"])

_FIND = []
for _p in ("pre_match", "post_match"):
    _FIND.append(f"""SELECT 'highest_{_p}_flow_increase' AS finding, segment_id, flow_diff AS value, flow_pct AS pct
  FROM (SELECT *, row_number() OVER (ORDER BY flow_diff DESC NULLS LAST, segment_id DESC) r FROM impacts
        WHERE team = 'all' AND period = '{_p}' AND flow_diff IS NOT NULL) WHERE r = 1""")
    _FIND.append(f"""SELECT 'highest_{_p}_speed_reduction', segment_id, -speed_diff, -speed_pct
  FROM (SELECT *, row_number() OVER (ORDER BY speed_diff ASC NULLS LAST, segment_id ASC) r FROM impacts
        WHERE team = 'all' AND period = '{_p}' AND speed_diff IS NOT NULL) WHERE r = 1""")
ORACLE["impact_findings"] = rounded(impact_ctes() + " " + " UNION ALL ".join(_FIND), ["value", "pct"])

ORACLE["impact_complete_hours"] = rounded(impact_ctes("event_type", 4, 3) + " SELECT * FROM impacts", IMPACT_FLOATS)
ORACLE["quality_filter_hours"] = impact_ctes("event_type", 4, 3) + """
SELECT segment_id, count(*) AS n_hours FROM quality GROUP BY 1"""


def _one(x: str) -> str:
    return f"printf('%.1f', round_even(({x}) * 10, 0) / 10)"


ORACLE["findings_report"] = rounded(impact_ctes() + ", head AS (" + " UNION ALL ".join(_FIND) + f"""),
ranked AS (SELECT team, segment_id, flow_diff, row_number() OVER (PARTITION BY team ORDER BY flow_diff DESC, segment_id) AS r
           FROM impacts WHERE period = 'pre_match' AND team IN ('united', 'city') AND flow_diff IS NOT NULL),
g AS (SELECT team, max(segment_id) FILTER (r = 1) AS segment_id, max(flow_diff) AS value, avg(flow_diff) AS m
      FROM ranked WHERE r <= 5 GROUP BY 1)
SELECT finding, segment_id, value, pct,
       finding || ': ' || {_one('value')} || ' (' || {_one('pct')} || '%) at ' || segment_id AS text FROM head
UNION ALL
SELECT 'team_' || g.team, g.segment_id, g.value, (g.m / o.m - 1) * 100,
       g.team || ': highest rise ' || {_one('g.value')} || ' at ' || g.segment_id || ', top 5 mean ' || {_one('g.m')}
FROM g LEFT JOIN g o ON o.team <> g.team""", ["value", "pct"])


from panelflow.plans import oracle_features  # noqa: E402,F401
from panelflow.plans import oracle_quality  # noqa: E402,F401
from panelflow.plans import oracle_ml  # noqa: E402,F401
from panelflow.plans import oracle_io  # noqa: E402,F401
