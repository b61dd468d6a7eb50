"""Oracle SQL for the model evaluation aggregates (closed-form fit)."""

from __future__ import annotations

from statistics import NormalDist

from panelflow.plans.oracle import ORACLE, rounded
from panelflow.plans.oracle_features import FEATURES_CTE

PRED_CTE = FEATURES_CTE + """,
s AS (SELECT *, row_number() OVER (ORDER BY datetime, segment_id) - 1 AS pos, count(*) OVER () AS n FROM features),
c AS (SELECT *, floor(n * 0.7::DOUBLE) AS t_idx, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS v_idx FROM s),
sp AS (SELECT * EXCLUDE (pos, n, t_idx, v_idx),
              CASE WHEN pos < t_idx THEN 'train' WHEN pos < v_idx THEN 'val' ELSE 'test' END AS split
       FROM c WHERE t_idx >= 100 AND v_idx - t_idx >= 50 AND n - v_idx >= 50),
fit AS (SELECT regr_slope(total_traffic_flow, hour) AS slope, regr_intercept(total_traffic_flow, hour) AS intercept
        FROM sp WHERE split = 'train'),
pred AS (SELECT sp.*, intercept + slope * hour AS prediction,
                total_traffic_flow - (intercept + slope * hour) AS residual FROM sp, fit)"""

ORACLE["regression_metrics"] = rounded(PRED_CTE + """,
g AS (SELECT split, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual)) AS mae,
             sum(residual * residual) AS ssr, count(*) * var_pop(total_traffic_flow) AS sst, count(*) AS n
      FROM pred WHERE total_traffic_flow IS NOT NULL AND prediction IS NOT NULL GROUP BY 1)
SELECT split, rmse, mae, n, CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM g""",
    ["rmse", "mae", "r2"])

ORACLE["prediction_ranges"] = rounded(PRED_CTE + """,
long AS (UNPIVOT (SELECT prediction, residual FROM pred) ON prediction, residual INTO NAME target VALUE value)
SELECT target, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std,
       quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM long GROUP BY 1""",
    ["min", "max", "mean", "std", "p05", "p95"])

ORACLE["hourly_actual_vs_pred"] = rounded(PRED_CTE + """
SELECT hour, avg(total_traffic_flow) AS actual_mean, avg(prediction) AS predicted_mean FROM pred GROUP BY 1""",
    ["actual_mean", "predicted_mean"])

ORACLE["pred_profile_weekend"] = rounded(PRED_CTE + """
SELECT hour, is_weekend, avg(total_traffic_flow) AS actual_mean, stddev_samp(total_traffic_flow) AS actual_std,
       avg(prediction) AS predicted_mean, stddev_samp(prediction) AS predicted_std, count(*) AS n,
       stddev_samp(total_traffic_flow) / sqrt(CAST(count(*) AS DOUBLE)) AS actual_se
FROM pred GROUP BY 1, 2""", ["actual_mean", "actual_std", "predicted_mean", "predicted_std", "actual_se"])

_FEATS = ["hour", "is_weekend", "is_school_holiday", "hour_weekend", "hour_school_holiday"]
ORACLE["feature_stats"] = rounded(PRED_CTE + """,
long AS (UNPIVOT (SELECT """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATS) + """ FROM sp WHERE split = 'train')
         ON """ + ", ".join(_FEATS) + """ INTO NAME feature VALUE value)
SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std
FROM long GROUP BY 1""", ["min", "max", "mean", "std"])

_M = 99
_probs = [(i - 0.5) / _M for i in range(1, _M + 1)]
_theo = ", ".join(f"({i}, {p!r}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)" for i, p in enumerate(_probs))
_qs = ", ".join(f"quantile_cont(residual, {p!r}::DOUBLE)" for p in _probs)
ORACLE["qq_points"] = rounded(PRED_CTE + f""",
theo AS (SELECT * FROM (VALUES {_theo}) t(i, prob, theoretical)),
q AS (SELECT [{_qs}] AS qs FROM pred)
SELECT CAST(theo.i AS INTEGER) AS i, prob, theoretical, qs[theo.i + 1] AS sample FROM theo, q""",
    ["prob", "theoretical", "sample"])

ORACLE["split_by_direction"] = FEATURES_CTE + """,
s AS (SELECT segment_id, datetime, direction,
             row_number() OVER (PARTITION BY direction ORDER BY datetime, segment_id) - 1 AS pos,
             count(*) OVER (PARTITION BY direction) AS n FROM features),
c AS (SELECT *, floor(n * 0.7::DOUBLE) AS t_idx, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS v_idx FROM s)
SELECT segment_id, datetime, direction,
       CASE WHEN pos < t_idx THEN 'train' WHEN pos < v_idx THEN 'val' ELSE 'test' END AS split
FROM c WHERE t_idx >= 100 AND v_idx - t_idx >= 50 AND n - v_idx >= 50"""

_missing = " OR ".join(f"{c} IS NULL" for c in _FEATS)
ORACLE["model_rows_left_out"] = PRED_CTE + " " + " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, '{t}' AS target, CAST(count_if({_missing} OR {t} IS NULL) AS BIGINT) AS n_left_out FROM sp"
    for t in ("total_traffic_flow", "speed_reduction", "normalized_time"))

# One standardised feature z: ridge shrinks the slope by n / (n + alpha / s2) with s2 = (n - 1) / n = var_pop(z),
# lasso moves cov(z, y) towards 0 by alpha before dividing by s2.
ORACLE["closed_form_models"] = PRED_CTE + """,
t AS (SELECT hour AS x, total_traffic_flow AS y FROM sp WHERE split = 'train' AND total_traffic_flow IS NOT NULL),
m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_samp(x) AS czy,
             var_pop(x) / var_samp(x) AS s2, count(*) AS n FROM t)
SELECT kind, round_even(mx * 10000, 0) / 10000 AS feature_mean, round_even(sx * 10000, 0) / 10000 AS feature_std,
       round_even(coefficient * 10000, 0) / 10000 AS coefficient, round_even(my * 10000, 0) / 10000 AS intercept
FROM (SELECT 'linear' AS kind, mx, sx, my, czy / s2 AS coefficient FROM m
      UNION ALL SELECT 'ridge', mx, sx, my, czy / (s2 + 1.0 / n) FROM m
      UNION ALL SELECT 'lasso', mx, sx, my, sign(czy) * greatest(abs(czy) - 1.0, 0) / s2 FROM m)"""

ORACLE["residual_histogram"] = rounded(PRED_CTE + """,
d AS (SELECT residual AS x FROM pred WHERE residual IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM d),
wd AS (SELECT lo, hi, (hi - lo) / (log2(n) + 1) AS w1, 2 * iqr / cbrt(n) AS w2 FROM st),
nb AS (SELECT lo, hi, CASE WHEN hi > lo THEN ceil((hi - lo) / CASE WHEN w2 > 0 THEN least(w1, w2) ELSE w1 END) ELSE 1 END
              AS bins FROM wd),
b AS (SELECT CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * bins) + 1, bins) ELSE 1 END AS bin, lo, hi, bins
      FROM d, nb)
SELECT CAST(bin AS INTEGER) AS bin, lo + (bin - 1) * ((hi - lo) / bins) AS bin_lo, lo + bin * ((hi - lo) / bins) AS bin_hi,
       count(*) AS count FROM b GROUP BY bin, lo, hi, bins""", ["bin_lo", "bin_hi"])

_TARGETS = ["total_traffic_flow", "speed_reduction", "normalized_time"]
_LONG = PRED_CTE + """,
long AS (UNPIVOT (SELECT split, hour, """ + ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in _TARGETS) + """ FROM sp)
         ON """ + ", ".join(_TARGETS) + """ INTO NAME target VALUE y),
tr AS (SELECT * FROM long WHERE split = 'train' AND hour IS NOT NULL)"""

ORACLE["saved_models"] = _LONG + """,
line AS (SELECT target, regr_slope(y, hour) AS slope, regr_intercept(y, hour) AS intercept FROM tr GROUP BY 1),
e AS (SELECT target, split, y, y - (intercept + slope * hour) AS r FROM long JOIN line USING (target) WHERE hour IS NOT NULL),
g AS (SELECT target, split, sqrt(avg(r * r)) AS rmse, avg(abs(r)) AS mae, sum(r * r) AS ssr,
             count(*) * var_pop(y) AS sst, count(*) AS n FROM e GROUP BY 1, 2)
SELECT 'linear' AS model, target, split, round_even(rmse * 10000, 0) / 10000 AS rmse,
       round_even(mae * 10000, 0) / 10000 AS mae, n,
       round_even((CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END) * 10000, 0) / 10000 AS r2
FROM g"""

# The split with the largest sum of n * mean^2 on both sides has the least squared error.
ORACLE["boosted_split"] = rounded(_LONG + """,
cut AS (SELECT DISTINCT target, hour AS c FROM tr),
side AS (SELECT cut.target, c, avg(y) FILTER (hour <= c) AS lo, avg(y) FILTER (hour > c) AS hi,
                count(*) FILTER (hour <= c) AS n_lo, count(*) FILTER (hour > c) AS n_hi
         FROM cut JOIN tr ON tr.target = cut.target GROUP BY 1, 2),
best AS (SELECT * FROM side WHERE n_hi > 0
         QUALIFY row_number() OVER (PARTITION BY target ORDER BY n_lo * lo * lo + n_hi * hi * hi DESC, c) = 1)
SELECT b.target, h.hour, CASE WHEN h.hour <= b.c THEN b.lo ELSE b.hi END AS prediction
FROM best b CROSS JOIN (SELECT DISTINCT hour FROM sp) h""", ["prediction"])

# Boosted trees with a leaf per hour: after r rounds a share 1 - (1 - rate)^r of the way from the mean to the hour's mean.
_FITS = """, hm AS (SELECT {by} target, hour, avg(y) AS mh FROM {train} GROUP BY ALL),
tm AS (SELECT {by} target, avg(y) AS m FROM {train} GROUP BY ALL)"""

ORACLE["early_stopping_by_hour"] = _LONG + _FITS.format(by="", train="tr") + """,
v AS (SELECT target, y, m, mh FROM long JOIN tm USING (target) JOIN hm USING (target, hour) WHERE split = 'val'),
e AS (SELECT target, r, count(*) AS n, sqrt(avg((y - m - (1 - pow(0.9::DOUBLE, r)) * (mh - m)) ** 2)) AS rmse
      FROM v CROSS JOIN (SELECT unnest(range(1, 301)) AS r) GROUP BY 1, 2)
SELECT target, CAST(arg_min(r, rmse) AS INTEGER) AS rounds, any_value(n) AS n, round_even(min(rmse) * 10000, 0) / 10000 AS rmse
FROM e GROUP BY 1"""

_FOLDS_CTE = FEATURES_CTE + """,
o AS (SELECT *, row_number() OVER (ORDER BY datetime, segment_id) - 1 AS pos, floor(count(*) OVER () * (1.0::DOUBLE - 0.15::DOUBLE)) AS m
      FROM features),
f AS (SELECT *, floor(m / 5) AS q, m % 5 AS r FROM o WHERE pos < m),
ff AS (SELECT *, CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1)) + 1 ELSE r + floor((pos - r * (q + 1)) / q) + 1 END AS fold FROM f)"""

ORACLE["grid_search_by_hour"] = _FOLDS_CTE + """,
lf AS (UNPIVOT (SELECT fold, hour, """ + ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in _TARGETS) + """ FROM ff)
       ON """ + ", ".join(_TARGETS) + """ INTO NAME target VALUE y),
ho AS (SELECT DISTINCT fold AS held FROM ff),
trn AS (SELECT held, target, hour, y FROM lf JOIN ho ON fold <> held)""" + _FITS.format(by="held,", train="trn") + """,
e AS (SELECT fold, lf.target, rate, sqrt(avg((y - m - (1 - pow(1 - rate, 20)) * (mh - m)) ** 2)) AS rmse
      FROM lf JOIN tm ON tm.held = fold AND tm.target = lf.target JOIN hm ON hm.held = fold AND hm.target = lf.target AND hm.hour = lf.hour
      CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE]) AS rate) GROUP BY ALL)
SELECT 24 AS max_depth, rate AS learning_rate, round_even(avg(rmse) * 10000, 0) / 10000 AS rmse FROM e GROUP BY rate"""

_DIR_CTE = FEATURES_CTE + """,
s AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY datetime, segment_id) - 1 AS pos,
             count(*) OVER (PARTITION BY direction) AS n FROM features),
c AS (SELECT *, floor(n * 0.7::DOUBLE) AS t_idx, floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) AS v_idx FROM s),
sp AS (SELECT * EXCLUDE (pos, n, t_idx, v_idx),
              CASE WHEN pos < t_idx THEN 'train' WHEN pos < v_idx THEN 'val' ELSE 'test' END AS split
       FROM c WHERE t_idx >= 100 AND v_idx - t_idx >= 50 AND n - v_idx >= 50),
sizes AS (SELECT direction, count(*) AS n FROM sp GROUP BY 1),
params AS (SELECT direction, CASE WHEN 2 * n >= max(n) OVER () THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS rate FROM sizes)"""

ORACLE["parameter_lookup"] = _DIR_CTE + " SELECT direction, 7 AS max_depth, rate AS learning_rate FROM params"

ORACLE["direction_models_by_hour"] = _DIR_CTE + """,
long AS (UNPIVOT (SELECT direction, split, hour, """ + ", ".join(f"CAST({t} AS DOUBLE) AS {t}" for t in _TARGETS) + """ FROM sp)
         ON """ + ", ".join(_TARGETS) + """ INTO NAME target VALUE y),
tr AS (SELECT * FROM long WHERE split = 'train')""" + _FITS.format(by="direction,", train="tr") + """,
e AS (SELECT long.direction, long.target, split, y, y - m - (1 - pow(1 - rate, 20)) * (coalesce(mh, m) - m) AS r
      FROM long JOIN params USING (direction) JOIN tm USING (direction, target) LEFT JOIN hm USING (direction, target, hour)),
g AS (SELECT direction, target, split, sqrt(avg(r * r)) AS rmse, avg(abs(r)) AS mae, sum(r * r) AS ssr,
             count(*) * var_pop(y) AS sst, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT direction, target, split, round_even(rmse * 10000, 0) / 10000 AS rmse, round_even(mae * 10000, 0) / 10000 AS mae, n,
       round_even((CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END) * 10000, 0) / 10000 AS r2
FROM g"""

ORACLE["importance_first_split"] = PRED_CTE + """,
lt AS (UNPIVOT (SELECT """ + ", ".join(_FEATS + [f"CAST({t} AS DOUBLE) AS {t}" for t in _TARGETS]) + """ FROM sp WHERE split = 'train')
       ON """ + ", ".join(_TARGETS) + """ INTO NAME target VALUE y),
lf AS (UNPIVOT (SELECT target, y, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATS) + """ FROM lt)
       ON """ + ", ".join(_FEATS) + """ INTO NAME feature VALUE x),
vals AS (SELECT target, feature, x, count(*) AS n, sum(y) AS s FROM lf GROUP BY 1, 2, 3),
cuts AS (SELECT target, feature, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS nt, sum(s) OVER a AS st FROM vals
         WINDOW w AS (PARTITION BY target, feature ORDER BY x), a AS (PARTITION BY target, feature)),
best AS (SELECT target, arg_max(feature, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)) AS feature FROM cuts WHERE nt > nl GROUP BY 1)
SELECT b.target, f.feature, CASE WHEN b.feature = f.feature THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance
FROM best b CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{c}'" for c in _FEATS) + """]) AS feature) f"""
