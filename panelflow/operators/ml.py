"""Modelling on MLlib: scaling, linear / ridge / lasso, boosted trees per
target on rows, parameter lookup with fallback, importances, and the
evaluation aggregates (metrics, feature stats, prediction ranges, hourly
profiles, Q-Q points).  Fitting is distributed by MLlib; the only
driver-side loops are over targets (a handful of items).  Boosted trees on
cells, cross-validation and searches are in `cells`.
"""

from __future__ import annotations

import math
import random
from functools import reduce
from multiprocessing.pool import ThreadPool
from statistics import NormalDist

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.functions.numeric import safe_div
from panelflow.operators.quantiles import exact_quantiles, quantile_columns

# Model inputs and outputs.
FEATURES = ["hour", "is_weekend", "is_school_holiday", "hour_weekend", "hour_school_holiday"]
TARGETS = ["total_traffic_flow", "speed_reduction", "normalized_time"]
# Defaults used when neither a direction-specific nor a shared
# value exists, the rounds and shares of the boosted trees, the typical size
# of each target in the search objective.
DEFAULT_PARAMS = {"max_depth": 5, "learning_rate": 0.1}
ROUNDS, PATIENCE, ROW_SHARE, COLUMN_SHARE, MIN_ROWS = 300, 50, 0.9, 0.9, 3
SCALE_HINTS = {"total_traffic_flow": 1000, "speed_reduction": 10, "normalized_time": 1}


# --- evaluation aggregates (pure SQL) ---------------------------------------

def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction", by=()) -> DataFrame:
    """RMSE, MAE and R^2 per group (R^2 = 1 - SSres / (n * var_pop(y));
    a constant label gives 1 when the fit is exact, else 0)."""
    e = F.col(label) - F.col(prediction)
    g = pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_ssr"), (F.count(F.lit(1)) * F.var_pop(label)).alias("_sst"),
        F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).otherwise(
        F.when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.withColumn("r2", r2).drop("_ssr", "_sst")


def closed_form_fit(train: DataFrame, x: str, y: str) -> DataFrame:
    """One-row table (slope, intercept) of the least-squares line y ~ x."""
    return train.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def apply_line(df: DataFrame, fit: DataFrame, x: str, out: str = "prediction") -> DataFrame:
    return df.crossJoin(F.broadcast(fit)).withColumn(out, F.col("intercept") + F.col("slope") * F.col(x)) \
        .drop("slope", "intercept")


def feature_stats(df: DataFrame, cols) -> DataFrame:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    return long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                       F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def prediction_ranges(pred: DataFrame, cols) -> DataFrame:
    """min / max / mean / population std / p05 / p95 per prediction column
    (exact percentiles over all rows, distributed)."""
    long = pred.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "target", "value")
    g = long.groupBy("target").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"))
    q = quantile_columns(long, "value", [0.05, 0.95], ["p05", "p95"], by=["target"])
    return g.join(q, "target", "left").select("target", "min", "max", "mean", "std", "p05", "p95")


def hourly_actual_vs_pred(pred: DataFrame, label: str, prediction: str = "prediction", hour: str = "hour") -> DataFrame:
    return pred.groupBy(hour).agg(F.avg(label).alias("actual_mean"), F.avg(prediction).alias("predicted_mean"))


def weekend_profile(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Mean, std and count by hour and weekend flag; SE of the actual mean."""
    g = pred.groupBy("hour", "is_weekend").agg(
        F.avg(label).alias("actual_mean"), F.stddev_samp(label).alias("actual_std"),
        F.avg(prediction).alias("predicted_mean"), F.stddev_samp(prediction).alias("predicted_std"),
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("actual_se", safe_div(F.col("actual_std"), F.sqrt(F.col("n").cast("double"))))


def qq_points(pred: DataFrame, residual: str, m: int = 99) -> DataFrame:
    """Ordered residual quantiles at probabilities (i - 0.5) / m against the
    standard normal quantile at the same probability (a rule-built table
    of ``m`` rows).  Residual quantiles are exact and distributed."""
    probs = [(i - 0.5) / m for i in range(1, m + 1)]
    spark = pred.sparkSession
    theo = spark.createDataFrame([(i, NormalDist().inv_cdf(p)) for i, p in enumerate(probs)],
                                 "i int, theoretical double")
    q = exact_quantiles(pred, residual, probs).select("i", "prob", F.col("quantile").alias("sample"))
    return F.broadcast(theo).join(q, "i").select("i", "prob", "theoretical", "sample")


# --- MLlib pipelines ----------------------------------------------------------

def linear_pipeline(features, target: str, kind: str = "linear", alpha: float = 1.0, n_rows: int | None = None):
    """z-score features (train statistics), then a linear model.
    ridge: L2 with regParam = alpha / n (sklearn's unnormalised penalty),
    lasso: L1 with regParam = alpha."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip")
    sc = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    if kind == "linear":
        lr = LinearRegression(featuresCol="features", labelCol=target, regParam=0.0, standardization=False)
    elif kind == "ridge":
        lr = LinearRegression(featuresCol="features", labelCol=target, regParam=alpha / max(n_rows or 1, 1),
                              elasticNetParam=0.0, standardization=False)
    elif kind == "lasso":
        lr = LinearRegression(featuresCol="features", labelCol=target, regParam=alpha, elasticNetParam=1.0,
                              standardization=False)
    else:
        raise ValueError(kind)
    return Pipeline(stages=[asm, sc, lr])


def gbt_pipeline(features, target: str, max_depth: int = 5, step_size: float = 0.1, max_iter: int = ROUNDS,
                 subsampling: float = ROW_SHARE, min_instances: int = MIN_ROWS, seed: int = 42,
                 colsample: float = COLUMN_SHARE, gamma: float = 0.0, weight: str | None = None):
    """MLlib's boosted trees on squared error, over rows or (with ``weight``,
    a count column) over cells, which for a subsampling of 1 gives the same
    trees.  ``colsample`` is the share of the features tried at each node,
    ``gamma`` the least gain of a split."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    gbt = GBTRegressor(
        featuresCol="features", labelCol=target, maxDepth=max_depth, stepSize=step_size, maxIter=max_iter,
        subsamplingRate=subsampling, minInstancesPerNode=min_instances, seed=seed, minInfoGain=gamma,
        featureSubsetStrategy="all" if colsample >= 1 else str(colsample))
    return Pipeline(stages=[asm, gbt.setWeightCol(weight) if weight else gbt])


def best_round(errors, patience: int = PATIENCE) -> int:
    """Number of rounds to keep: the best one before ``patience`` rounds
    without a gain (a list of one error per round)."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_early_stopping(train: DataFrame, val: DataFrame, target: str, features=FEATURES,
                       patience: int = PATIENCE, **params) -> tuple[PipelineModel, int]:
    """Fit all rounds, take the validation error after each, and fit again
    with the rounds kept (the same seed grows the same trees)."""
    d = _clean(train, features, target)
    full = gbt_pipeline(features, target, **params).fit(d)
    scored = full.stages[0].transform(_clean(val, features, target))
    rounds = best_round(full.stages[-1].evaluateEachIteration(scored, "squared"), patience)
    if rounds == full.stages[-1].getNumTrees:
        return full, rounds
    return gbt_pipeline(features, target, **{**params, "max_iter": rounds}).fit(d), rounds


def _clean(df: DataFrame, features, target: str) -> DataFrame:
    return df.dropna(subset=list(features) + [target])


def fit_linear_models(train: DataFrame, features=FEATURES, targets=TARGETS, kinds=("linear", "ridge", "lasso")):
    models = {}
    for t in targets:
        d = _clean(train, features, t)
        n = d.count()
        for k in kinds:
            models[(k, t)] = linear_pipeline(features, t, k, n_rows=n).fit(d)
    return models


def fit_gbt_per_target(train: DataFrame, features=FEATURES, targets=TARGETS, **params):
    """One boosted-tree regressor per target (a multi-output model), fitted
    side by side."""
    return fit_together({t: (gbt_pipeline(features, t, **params), _clean(train, features, t)) for t in targets})


def fit_together(jobs: dict, parallelism: int = 4) -> dict:
    """``jobs``: name -> (pipeline, training frame); name -> fitted model.
    Spark interleaves the small jobs of the fits."""
    names = list(jobs)
    if not names:
        return {}
    fit = inheritable_thread_target(jobs[names[0]][1].sparkSession)(lambda n: jobs[n][0].fit(jobs[n][1]))
    with ThreadPool(min(parallelism, len(names))) as pool:
        return dict(zip(names, pool.map(fit, names)))


def rows_left_out(df: DataFrame, features=FEATURES, targets=TARGETS) -> DataFrame:
    """Rows per target that fits and scores leave out: MLlib's trees and
    linear models take no missing feature or label."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(missing | F.col(t).isNull()).alias(t) for t in targets]).unpivot(
        ["n_rows"], list(targets), "target", "n_left_out")


def evaluate_models(models: dict, df: DataFrame, split_col: str = "split", features=FEATURES) -> DataFrame:
    """Metrics per model, target and split, as one long table.  All models
    score in one pass: rows without a missing feature get one prediction
    column per model, and one aggregate over the unpivoted errors follows."""
    d = df.dropna(subset=list(features))
    names = {}
    for i, (key, model) in enumerate(models.items()):
        names[f"_p{i}"] = key if isinstance(key, tuple) else ("gbt", key)
        made = [c for c in ("_raw", "features", "prediction")]
        d = model.transform(d).withColumnRenamed("prediction", f"_p{i}").drop(*made)
    scored = d.select(split_col, F.explode(F.array(*[F.struct(
        F.lit(kind).alias("model"), F.lit(target).alias("target"), F.col(target).cast("double").alias("_y"),
        F.col(c).alias("_p")) for c, (kind, target) in names.items()])).alias("_s")).select(split_col, "_s.*")
    return regression_metrics(scored, "_y", "_p", by=("model", "target", split_col))


def importances(model: PipelineModel, features=FEATURES) -> list[tuple[str, float]]:
    imp = model.stages[-1].featureImportances
    return [(f, float(imp[i])) for i, f in enumerate(features)]


def importance_frame(spark: SparkSession, models: dict, features=FEATURES) -> DataFrame:
    rows = [(t, f, v) for t, m in models.items() for f, v in importances(m, features)]
    return spark.createDataFrame(rows, "target string, feature string, importance double")


# The search ranges (low, high, scale).
SEARCH_SPACE = {
    "max_iter": (100, 1000, "int"),
    "max_depth": (3, 10, "int"),
    "learning_rate": (1e-3, 0.1, "log"),
    "min_child_weight": (1, 7, "int"),
    "subsample": (0.6, 1.0, "linear"),
    "colsample": (0.6, 1.0, "linear"),
    "gamma": (1e-8, 1.0, "log"),
    "reg_alpha": (1e-8, 1.0, "log"),
    "reg_lambda": (1e-8, 1.0, "log"),
}


def draw(rng: random.Random, low: float, high: float, scale: str):
    if scale == "int":
        return rng.randint(low, high)
    return math.exp(rng.uniform(math.log(low), math.log(high))) if scale == "log" else rng.uniform(low, high)


BASE_ROUNDS = 100       # trees of the model that a tuned one is compared with


def baseline_improvement(train: DataFrame, val: DataFrame, best_params: dict, target: str,
                         features=FEATURES) -> float:
    """% RMSE gain of the tuned model over a 100-tree depth-3 model."""
    d, v = _clean(train, features, target), _clean(val, features, target)
    fits = fit_together({"base": (gbt_pipeline(features, target, max_depth=3, max_iter=BASE_ROUNDS), d),
                         "tuned": (gbt_pipeline(features, target, **best_params), d)})
    b, t = (regression_metrics(fits[k].transform(v), target).first()["rmse"] for k in ("base", "tuned"))
    return (b - t) / b * 100 if b else 0.0


def param_lookup(keys: DataFrame, specific: DataFrame, shared: DataFrame, key: str = "direction",
                 defaults=DEFAULT_PARAMS) -> DataFrame:
    """Per key: key-specific value, else the shared value, else the default
    (left joins on tiny parameter tables)."""
    s = shared.select(*[F.col(c).alias(f"_shared_{c}") for c in defaults])
    j = keys.join(specific, key, "left").crossJoin(F.broadcast(s))
    return j.select(key, *[F.coalesce(F.col(c), F.col(f"_shared_{c}"), F.lit(v)).alias(c)
                           for c, v in defaults.items()])


def model_path(path: str, name) -> str:
    return f"{path}/{'_'.join(name) if isinstance(name, tuple) else name}"


def save_models(models: dict, path: str) -> None:
    for name, m in models.items():
        m.write().overwrite().save(model_path(path, name))


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_models(path: str, names) -> dict:
    """The models that ``save_models`` wrote under these names."""
    return {name: load_model(model_path(path, name)) for name in names}
