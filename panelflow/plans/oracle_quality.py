"""Oracle SQL for the audits, geofence, name parsing, splits and the
remaining event-window queries."""

from __future__ import annotations

from panelflow.functions.geo import STUDY_AREA_POLYGON, polygon_edges
from panelflow.plans.oracle import ORACLE, WINDOWS_CTE, hourly_cte, readings_cte, rounded
from panelflow.plans.oracle_features import FEATURES_CTE

ORACLE["most_common_name"] = """
SELECT o_custkey, o_orderpriority, n_rows, first_seen FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n_rows, min(o_orderdate) AS first_seen,
         row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderdate), o_orderpriority) AS r
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2) WHERE r = 1"""

LINK_FILES = """
f AS (SELECT 'section_' || CAST(l_suppkey AS VARCHAR) || '/link_' || CAST(l_partkey AS VARCHAR) || '.csv' AS file_name
      FROM lineitem),
f2 AS (SELECT file_name, nullif(regexp_extract(file_name, '(\\d+)\\.csv$', 1), '') AS link_id FROM f)"""

ORACLE["duplicate_ids"] = "WITH " + LINK_FILES + """,
pairs AS (SELECT DISTINCT link_id, file_name FROM f2 WHERE link_id IS NOT NULL),
n AS (SELECT link_id, count(*) AS n_files FROM pairs GROUP BY 1 HAVING count(*) > 1)
SELECT p.link_id, p.file_name, n.n_files FROM pairs p JOIN n USING (link_id)"""

ORACLE["duplicate_summary"] = "WITH " + LINK_FILES + """,
pairs AS (SELECT DISTINCT file_name, link_id FROM f2),
per_id AS (SELECT link_id, count(*) AS c FROM pairs WHERE link_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(DISTINCT file_name) FROM pairs) AS n_files,
       (SELECT count(DISTINCT file_name) FROM pairs WHERE link_id IS NULL) AS n_files_without_id,
       (SELECT count(*) FROM per_id) AS n_unique_ids,
       (SELECT CAST(count_if(c > 1) AS BIGINT) FROM per_id) AS n_duplicate_ids,
       CAST((SELECT count(DISTINCT file_name) FROM pairs) = 24 AS INTEGER) AS matches_expected"""

ORACLE["missing_days"] = """
WITH days AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_shipdate IS NOT NULL),
span AS (SELECT l_suppkey, min(day) AS lo, max(day) AS hi FROM days GROUP BY 1),
cal AS (SELECT l_suppkey, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT l_suppkey, strftime(day, '%Y-%m-%d') AS day FROM cal
WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.l_suppkey = cal.l_suppkey AND d.day = cal.day)"""

ORACLE["day_coverage"] = """
SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days,
       strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS first_day,
       strftime(max(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS last_day,
       date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) + 1
         - count(DISTINCT CAST(l_shipdate AS DATE)) AS n_missing_days
FROM lineitem GROUP BY 1"""

FLOW_COLS = ["total_traffic_flow", "traffic_flow_value1", "traffic_flow_value2", "traffic_flow_value3",
             "traffic_flow_value4"]
CLASSES = FLOW_COLS[1:]


def segtype_sql(cw: str, desc: str) -> str:
    d = f"lower(coalesce({desc}, ''))"
    return (f"coalesce(CASE WHEN trim({cw}) = '' OR trim({cw}) = 'nan' THEN NULL ELSE trim({cw}) END, "
            f"CASE WHEN contains({d}, 'slip') THEN 'slipRoad' WHEN contains({d}, 'junction') THEN 'junction' "
            f"WHEN contains({d}, 'roundabout') THEN 'roundabout' WHEN contains({d}, 'main') THEN 'mainCarriageway' "
            f"ELSE 'unknown' END)")


_shares = ", ".join(f"avg(CASE WHEN {c} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}_zero_share" for c in FLOW_COLS)
AUDIT_CTE = "WITH " + readings_cte("event_type") + f""",
ag AS (SELECT ntis_link_number, arg_min_null(carriageway, row_seq) AS cw,
              arg_min_null(ntis_link_description, row_seq) AS descr, {_shares} FROM readings GROUP BY 1),
audit AS (SELECT ntis_link_number, {segtype_sql('cw', 'descr')} AS segment_type,
                 {', '.join(f'{c}_zero_share' for c in FLOW_COLS)},
                 CAST(greatest({', '.join(f'{c}_zero_share' for c in FLOW_COLS)}) >= 0.5 AS INTEGER) AS has_missing_flow
          FROM ag)"""

ORACLE["zero_share_audit"] = rounded(AUDIT_CTE + " SELECT * FROM audit", [f"{c}_zero_share" for c in FLOW_COLS])

ORACLE["missing_flow_by_type"] = rounded(AUDIT_CTE + """,
g AS (SELECT segment_type, count(*) AS total, CAST(sum(has_missing_flow) AS BIGINT) AS missing_flow FROM audit GROUP BY 1)
SELECT *, missing_flow / total * 100 AS missing_percent,
       CASE WHEN missing_flow / total * 100 >= 75 THEN 'red' WHEN missing_flow / total * 100 >= 25 THEN 'yellow'
            ELSE 'green' END AS verdict,
       CAST(missing_flow / total * 100 < 25 AND total >= 5 AS INTEGER) AS is_complete_type,
       CAST(missing_flow / total * 100 >= 75 AND total >= 5 AS INTEGER) AS is_missing_type
FROM g""", ["missing_percent"])

_csum = " + ".join(f"coalesce({c}, 0.0)" for c in CLASSES)
_fv_counts = (["count(*) AS n_rows", "CAST(count_if(total_traffic_flow = 0) AS BIGINT) AS zero_flow"]
              + [f"CAST(count_if({c} > total_traffic_flow) AS BIGINT) AS {c}_exceeds" for c in CLASSES]
              + [f"CAST(count_if(abs({_csum} - total_traffic_flow) > 1) AS BIGINT) AS sum_mismatch"])
_fv_pcts = [f"{c} / n_rows * 100 AS {c}_pct" for c in ["zero_flow", *[f"{x}_exceeds" for x in CLASSES], "sum_mismatch"]]
ORACLE["flow_validation"] = rounded("WITH " + readings_cte("event_type") + f""",
g AS (SELECT ntis_link_number, {', '.join(_fv_counts)} FROM readings GROUP BY 1)
SELECT *, {', '.join(_fv_pcts)} FROM g""",
    [f"{c}_pct" for c in ["zero_flow", *[f"{x}_exceeds" for x in CLASSES], "sum_mismatch"]])

_bad = " OR ".join(f"coalesce({c} > total_traffic_flow, false)" for c in CLASSES)
ORACLE["flow_validation_samples"] = rounded("WITH " + readings_cte("event_type") + f"""
SELECT ntis_link_number, sample_rank, row_seq, total_traffic_flow, {', '.join(CLASSES)} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ntis_link_number ORDER BY row_seq) AS INTEGER) AS sample_rank
  FROM readings WHERE {_bad}) WHERE sample_rank <= 3""", ["total_traffic_flow", *CLASSES])

_lv = (["count(*) AS n_rows"] + [f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}_nulls" for c in [*CLASSES, "total_traffic_flow"]]
       + ["CAST(count_if(total_traffic_flow = 0) AS BIGINT) AS zero_total",
          f"CAST(count_if(abs({_csum} - total_traffic_flow) > 1) AS BIGINT) AS sum_mismatch"]
       + [f"CAST(count_if({c} > total_traffic_flow) AS BIGINT) AS {c}_exceeds" for c in CLASSES])
ORACLE["load_validation"] = "WITH " + readings_cte("event_type") + " SELECT " + ", ".join(_lv) + " FROM readings"


def _inside_sql(x: str, y: str) -> str:
    terms = []
    for x1, y1, x2, y2 in polygon_edges(STUDY_AREA_POLYGON):
        if y1 == y2:
            continue
        cond = f"{y} > {min(y1, y2)!r}::DOUBLE AND {y} <= {max(y1, y2)!r}::DOUBLE AND {x} <= {max(x1, x2)!r}::DOUBLE"
        if x1 != x2:
            cond += (f" AND {x} <= ({y} - {y1!r}::DOUBLE) * {x2 - x1!r}::DOUBLE / {y2 - y1!r}::DOUBLE"
                     f" + {x1!r}::DOUBLE")
        terms.append(f"CAST(coalesce({cond}, false) AS INTEGER)")
    return "((" + " + ".join(terms) + ") % 2 = 1)"


GEO_CTE = "WITH " + readings_cte("event_type") + f""",
fr AS (SELECT ntis_link_number,
              arg_min_null(road, row_seq) AS road,
              arg_min_null(start_latitude, row_seq) AS start_latitude,
              arg_min_null(start_longitude, row_seq) AS start_longitude,
              arg_min_null(end_latitude, row_seq) AS end_latitude,
              arg_min_null(end_longitude, row_seq) AS end_longitude FROM readings GROUP BY 1),
geo AS (SELECT *, CAST({_inside_sql('start_longitude', 'start_latitude')} OR
                       {_inside_sql('end_longitude', 'end_latitude')} AS INTEGER) AS is_kept FROM fr)"""

ORACLE["geofence_segments"] = rounded(GEO_CTE + " SELECT * FROM geo",
                                      ["start_latitude", "start_longitude", "end_latitude", "end_longitude"])
ORACLE["geofence_tally"] = rounded(GEO_CTE + """
SELECT road, CAST(count_if(is_kept = 1) AS BIGINT) AS kept, CAST(count_if(is_kept = 0) AS BIGINT) AS discarded,
       count(*) AS total, count_if(is_kept = 0) / count(*) * 100 AS pct_discarded
FROM geo GROUP BY ROLLUP (road)""", ["pct_discarded"])
ORACLE["geofence_filter"] = GEO_CTE + """
SELECT segment_id, count(*) AS n_rows FROM readings
WHERE ntis_link_number IN (SELECT ntis_link_number FROM geo WHERE is_kept = 1) GROUP BY 1"""

ORACLE["ingest_manifest"] = """
WITH m AS (SELECT o_orderpriority AS road, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus <> 'P' AS ok FROM orders)
SELECT road, month, CAST(count_if(ok) AS BIGINT) AS n_success, CAST(count_if(NOT ok) AS BIGINT) AS n_failed,
       coalesce(array_to_string(list_sort(list_distinct(list(month) FILTER (WHERE NOT ok))), ','), '') AS failed_months
FROM m GROUP BY ROLLUP (road, month)"""


def snake_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '\\s+', '_', 'g')"
    s = f"regexp_replace(lower({s}), '[^a-z0-9_]', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    return f"regexp_replace({s}, '^_+|_+$', '', 'g')"


def safe_name_sql(x: str) -> str:
    return f"""regexp_replace(replace({x}, '/', '_'), '[\\\\/*?:"<>|]', '', 'g')"""


ORACLE["name_parsing"] = f"""
SELECT p_partkey,
       {snake_sql("'  ' || p_name || ' / ' || p_type || '-Size '")} AS snake_name,
       nullif(regexp_extract(CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_type || ' ' || CAST(p_partkey AS VARCHAR) END,
                             '\\s+(\\d+)$', 1), '') AS section_id,
       nullif(regexp_extract(p_brand || '_' || CAST(p_partkey AS VARCHAR) || '.csv', '(\\d+)\\.csv$', 1), '') AS link_id,
       {safe_name_sql("p_type || '/' || p_name || '?*'")} AS safe_name
FROM part"""

ORACLE["url_archive_names"] = f"""
SELECT page_id, CASE WHEN suffix(string_split(url, '/')[-1], '.zip') THEN string_split(url, '/')[-1]
                     ELSE string_split(url, '/')[-1] || '.zip' END AS archive_name,
       {safe_name_sql('url')} AS safe_name
FROM pages"""

ORACLE["coordinate_parse"] = rounded("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN printf('%.2f', c_acctbal)
                                  WHEN c_custkey % 10 = 1 THEN 'abc ; ' || CAST(c_nationkey AS VARCHAR)
                                  ELSE printf('%.2f', c_acctbal) || ' ; ' || CAST(c_nationkey AS VARCHAR) END AS txt
           FROM customer),
p AS (SELECT c_custkey, TRY_CAST(trim(string_split(txt, ';')[1]) AS DOUBLE) AS a,
             TRY_CAST(trim(string_split(txt, ';')[2]) AS DOUBLE) AS b FROM c)
SELECT c_custkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS lat,
       CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS lon FROM p""", ["lat", "lon"])


def _dir_full(x: str) -> str:
    lx = f"lower(coalesce({x}, 'none'))"
    return (f"CASE WHEN contains({lx}, 'anti-clockwise') OR contains({lx}, 'anticlockwise') THEN 'anticlockwise' "
            f"WHEN contains({lx}, 'clockwise') AND NOT contains({lx}, 'anti') THEN 'clockwise' "
            f"WHEN contains({lx}, 'eastbound') THEN 'eastbound' WHEN contains({lx}, 'westbound') THEN 'westbound' "
            f"WHEN contains({lx}, 'northbound') THEN 'northbound' WHEN contains({lx}, 'southbound') THEN 'southbound' "
            f"ELSE 'other' END")


def _labels_sql() -> str:
    from panelflow.plans.oracle import clean_name_sql, direction_code_sql, junctions_sql
    last = "string_split(name, ' ')[-1]"
    cn = clean_name_sql("name")
    cn_id = f"CASE WHEN regexp_matches({last}, '^\\d+$') THEN {cn} || ' (' || {last} || ')' ELSE {cn} END"
    label = (f"'M60 ' || {direction_code_sql('name')} || CASE WHEN trim({junctions_sql('name')}) <> '' THEN chr(10) || "
             f"{junctions_sql('name')} WHEN contains(name, 'within') THEN chr(10) || string_split(name, 'within ')[-1] "
             f"ELSE '' END")
    terms = ["connector", "link", "roundabout", "entry", "exit", "onramp", "offramp", "slip"]
    excl = " OR ".join(f"contains(lower(name), '{t}')" for t in terms)
    return (f"SELECT name, {_dir_full('name')} AS direction, {direction_code_sql('name')} AS direction_code, "
            f"{junctions_sql('name')} AS junctions, {cn_id} AS clean_name, {label} AS segment_label, "
            f"CAST({excl} AS INTEGER) AS is_excluded FROM (SELECT DISTINCT concat_ws(' ', ntis_link_description, "
            f"CAST(ntis_link_number AS VARCHAR)) AS name FROM readings)")


ORACLE["segment_labels"] = "WITH " + readings_cte("event_type") + " " + _labels_sql()

ORACLE["direction_counts"] = FEATURES_CTE + " SELECT direction, count(*) AS n_rows FROM features GROUP BY 1"

SPLIT_BASE = FEATURES_CTE + """,
s AS (SELECT segment_id, datetime, total_traffic_flow,
             row_number() OVER (ORDER BY datetime, segment_id) - 1 AS pos, count(*) OVER () AS n FROM features)"""

ORACLE["split_chronological"] = rounded(SPLIT_BASE + """,
c AS (SELECT *, floor(n * 0.7::DOUBLE) AS t_idx, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS v_idx FROM s)
SELECT segment_id, datetime, total_traffic_flow,
       CASE WHEN pos < t_idx THEN 'train' WHEN pos < v_idx THEN 'val' ELSE 'test' END AS split
FROM c WHERE t_idx >= 100 AND v_idx - t_idx >= 50 AND n - v_idx >= 50""", ["total_traffic_flow"])

ORACLE["split_kfold"] = rounded(SPLIT_BASE + """,
c AS (SELECT *, CAST(floor(n * 0.85::DOUBLE) AS BIGINT) AS m FROM s),
c2 AS (SELECT *, m // 5 AS q, m % 5 AS r FROM c),
c3 AS (SELECT *, CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) + 1 ELSE r + (pos - r * (q + 1)) // q + 1 END AS own
       FROM c2 WHERE pos < m)
SELECT segment_id, datetime, total_traffic_flow, CAST(f AS INTEGER) AS fold,
       CASE WHEN own = f THEN 'val' ELSE 'train' END AS role FROM c3, range(1, 6) t(f)
UNION ALL
SELECT segment_id, datetime, total_traffic_flow, CAST(0 AS INTEGER), 'test' FROM c WHERE pos >= m""", ["total_traffic_flow"])

ORACLE["split_timeseries"] = rounded(SPLIT_BASE + """,
c AS (SELECT *, CAST(floor(n * 0.85::DOUBLE) AS BIGINT) AS m FROM s),
c2 AS (SELECT *, m // 6 AS ts FROM c),
c3 AS (SELECT c2.*, CAST(f AS INTEGER) AS fold, m - 5 * ts + (f - 1) * ts AS st FROM c2, range(1, 6) t(f) WHERE pos < m)
SELECT segment_id, datetime, total_traffic_flow, fold,
       CASE WHEN pos < st THEN 'train' ELSE 'val' END AS role FROM c3 WHERE pos < st + ts
UNION ALL
SELECT segment_id, datetime, total_traffic_flow, CAST(0 AS INTEGER), 'test' FROM c WHERE pos >= m""", ["total_traffic_flow"])

ORACLE["match_counts"] = "WITH " + WINDOWS_CTE + """
SELECT CASE WHEN isodow(end_pre_match) >= 6 THEN 'weekend' ELSE 'weekday' END AS match_type, count(*) AS n_matches
FROM windows GROUP BY 1"""

ORACLE["control_periods"] = "WITH " + readings_cte("user40") + "," + hourly_cte(1) + "," + WINDOWS_CTE + """,
ev2 AS (SELECT fixture, end_pre_match AS kickoff,
               CASE WHEN isodow(end_pre_match) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM windows),
rd AS (SELECT DISTINCT datetime, CASE WHEN isodow(datetime) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM hourly)
SELECT e.fixture, e.kickoff, e.day_type, count(DISTINCT r.datetime) AS n_control
FROM ev2 e JOIN rd r ON e.day_type = r.day_type AND hour(e.kickoff) = hour(r.datetime)
GROUP BY 1, 2, 3 HAVING count(DISTINCT r.datetime) >= 3"""

ORACLE["fixture_parse_audit"] = "WITH " + WINDOWS_CTE + """
SELECT CAST(count_if(try_strptime("Date" || ' ' || "Kick-off Time", '%Y-%m-%d %H:%M:%S') IS NULL) AS BIGINT) AS dropped,
       count(*) AS total FROM fixtures"""

ORACLE["segment_type_catalogue"] = "WITH " + readings_cte("event_type") + """,
d AS (SELECT ntis_link_number, lower(coalesce(ntis_link_description, '')) AS ld,
             nullif(trim(carriageway), '') AS cw FROM readings),
allrows AS (
  SELECT ntis_link_number, cw AS segment_type, 'carriageway' AS source FROM d WHERE cw IS NOT NULL
  UNION ALL SELECT ntis_link_number, 'slipRoad', 'description' FROM d WHERE contains(ld, 'slip')
  UNION ALL SELECT ntis_link_number, 'junction', 'description' FROM d WHERE contains(ld, 'junction')
  UNION ALL SELECT ntis_link_number, 'roundabout', 'description' FROM d WHERE contains(ld, 'roundabout')
  UNION ALL SELECT ntis_link_number, 'mainCarriageway', 'description' FROM d WHERE contains(ld, 'main')
  UNION ALL SELECT NULL, 'unknown', 'default')
SELECT segment_type, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
       count(DISTINCT ntis_link_number) AS n_keys
FROM allrows GROUP BY 1"""

ORACLE["snake_case"] = f"""
SELECT p_partkey, '  ' || p_name || ' / ' || p_type || '-Size ' AS header,
       {snake_sql("'  ' || p_name || ' / ' || p_type || '-Size '")} AS snake_name FROM part"""

ORACLE["direction"] = "WITH " + readings_cte("event_type") + f"""
SELECT ntis_link_description, {_dir_full('ntis_link_description')} AS direction, count(*) AS n_rows
FROM readings GROUP BY 1"""

# Name terms that exclude a file from the audit.
_TERMS = ["connector", "link", "roundabout", "entry", "exit", "onramp", "offramp", "slip"]
ORACLE["flow_validation_named"] = rounded("WITH " + readings_cte("event_type") + f""",
g AS (SELECT ntis_link_number, {', '.join(_fv_counts)} FROM readings
      WHERE {' AND '.join(f"NOT contains(lower(ntis_link_description), '{t}')" for t in _TERMS)} GROUP BY 1)
SELECT *, {', '.join(_fv_pcts)} FROM g""",
    [f"{c}_pct" for c in ["zero_flow", *[f"{x}_exceeds" for x in CLASSES], "sum_mismatch"]])

ORACLE["flow_validation_one_file"] = rounded("WITH " + readings_cte("event_type") + f""",
named AS (SELECT * FROM readings WHERE {' AND '.join(f"NOT contains(lower(ntis_link_description), '{t}')" for t in _TERMS)}),
pick AS (SELECT ntis_link_number FROM (SELECT DISTINCT ntis_link_number FROM named) ORDER BY md5('0:' || CAST(ntis_link_number AS VARCHAR)) LIMIT 1),
g AS (SELECT ntis_link_number, {', '.join(_fv_counts)} FROM named JOIN pick USING (ntis_link_number) GROUP BY 1)
SELECT *, {', '.join(_fv_pcts)} FROM g""",
    [f"{c}_pct" for c in ["zero_flow", *[f"{x}_exceeds" for x in CLASSES], "sum_mismatch"]])
