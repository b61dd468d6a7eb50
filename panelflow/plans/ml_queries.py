"""Registered queries: model evaluation aggregates and fits with one
feature (SQL-checked through closed forms), full training runs and searches
(rows-only)."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import functions as F

from panelflow.operators import cells, ml, profiles, splits
from panelflow.operators.boosting import Params
from panelflow.plans import catalog as base
from panelflow.plans import feature_queries as fq
from panelflow.plans.registry import query, round_floats
from panelflow.session import cut_lineage
from panelflow.sources import sinks


def _release(result, *frames):
    """Materialize a small result table, then free the persisted inputs
    (the result no longer depends on them)."""
    out = cut_lineage(result)
    for f in frames:
        f.unpersist()
    return out

ORDER = ["datetime", "segment_id"]


def split_frame(spark, sf, persist: bool = False):
    """Feature frame with the chronological train / val / test split.
    Model fits read it many times, so they ask for it persisted (memory
    and disk, as MLlib itself does with its training input)."""
    # project before positioning: the position step checkpoints its input
    # and nothing can be pruned through a checkpoint afterwards
    cols = ["segment_id", "datetime", "direction", *ml.FEATURES, *ml.TARGETS]
    d = splits.chronological_split(fq.feature_frame(spark, sf).select(*cols), ORDER).drop("_pos")
    return d.persist(StorageLevel.MEMORY_AND_DISK) if persist else d


def line_predictions(spark, sf):
    d = split_frame(spark, sf)
    fit = ml.closed_form_fit(d.where(F.col("split") == "train"), "hour", "total_traffic_flow")
    p = ml.apply_line(d, fit, "hour")
    return p.withColumn("residual", F.col("total_traffic_flow") - F.col("prediction"))


@query("regression_metrics")
def q_regression_metrics(spark, sf):
    return round_floats(ml.regression_metrics(line_predictions(spark, sf), "total_traffic_flow", by=("split",)))


@query("prediction_ranges")
def q_prediction_ranges(spark, sf):
    return round_floats(ml.prediction_ranges(line_predictions(spark, sf), ["prediction", "residual"]))


@query("hourly_actual_vs_pred")
def q_hourly_actual_vs_pred(spark, sf):
    return round_floats(ml.hourly_actual_vs_pred(line_predictions(spark, sf), "total_traffic_flow"))


@query("pred_profile_weekend")
def q_pred_profile_weekend(spark, sf):
    return round_floats(ml.weekend_profile(line_predictions(spark, sf), "total_traffic_flow"))


@query("feature_stats")
def q_feature_stats(spark, sf):
    d = split_frame(spark, sf).where(F.col("split") == "train")
    return round_floats(ml.feature_stats(d, ml.FEATURES))


@query("qq_points")
def q_qq_points(spark, sf):
    return round_floats(ml.qq_points(line_predictions(spark, sf), "residual"))


# --- MLlib runs (no SQL oracle: rows-only check) ----------------------------

@query("linear_models")
def q_linear_models(spark, sf):
    d = split_frame(spark, sf, persist=True)
    models = ml.fit_linear_models(d.where(F.col("split") == "train"))
    return _release(round_floats(ml.evaluate_models(models, d)), d)


def part_cells(d, part="split", by=(), features=ml.FEATURES, targets=ml.TARGETS):
    """Cell table of a frame per part (split or fold): small, read by every fit."""
    return cut_lineage(cells.cell_table(d.withColumn("part", F.col(part).cast("string")), features, targets, by=[*by, "part"]))


def row_metrics(d, fitted, features, by=()):
    """Metrics on rows per target, group and split of predicted cells."""
    pred = cells.predict_rows(d, fitted, features, by)
    actual = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in ml.TARGETS])
    return ml.regression_metrics(pred.withColumn("_y", actual).where(F.col("_y").isNotNull()), "_y",
                                 by=("target", *by, "split", "rounds"))


@query("gbt_multioutput")
def q_gbt_multioutput(spark, sf):
    d = split_frame(spark, sf, persist=True)
    fitted = cells.fit_cells(part_cells(d), ml.FEATURES, [Params()])
    out = row_metrics(d, fitted, ml.FEATURES).drop("rounds").withColumn("model", F.lit("gbt"))
    return _release(round_floats(out), d)


@query("model_rows_left_out")
def q_model_rows_left_out(spark, sf):
    return ml.rows_left_out(split_frame(spark, sf))


@query("gbt_early_stopping")
def q_gbt_early_stopping(spark, sf):
    d = split_frame(spark, sf, persist=True)
    fitted = cells.fit_cells(part_cells(d), ml.FEATURES, [Params(patience=ml.PATIENCE)], watch="val")
    return _release(round_floats(row_metrics(d, fitted, ml.FEATURES)), d)


@query("importance")
def q_importance(spark, sf):
    fitted = cells.fit_cells(part_cells(split_frame(spark, sf)), ml.FEATURES, [Params()])
    return round_floats(cells.importance(fitted, ml.FEATURES))


def fold_frame(spark, sf, by=()):
    """Train / val rows once each, with the number of their own fold."""
    cols = ["segment_id", "datetime", "direction", *ml.FEATURES, *ml.TARGETS]
    f = splits.kfold_split(fq.feature_frame(spark, sf).select(*cols), ORDER, by=by)
    return f.where(F.col("role") == "val").drop("_pos")


FOLDS = range(1, 6)


@query("grid_search")
def q_grid_search(spark, sf):
    return round_floats(cells.grid_search(part_cells(fold_frame(spark, sf), "fold"), ml.FEATURES, FOLDS))


@query("random_search")
def q_random_search(spark, sf):
    found = cells.random_search(part_cells(split_frame(spark, sf)), ml.FEATURES, ml.SCALE_HINTS)
    names = list(ml.SEARCH_SPACE)
    rows = [(i, *(float(getattr(p, k)) for k in names), o) for i, (p, o) in enumerate(found)]
    out = spark.createDataFrame(rows, f"trial int, {', '.join(f'{k} double' for k in names)}, objective double")
    return round_floats(out.withColumns({k: F.col(k).cast("int") for k in ("max_iter", "max_depth", "min_child_weight")}))


def chosen_per_direction(spark, directions, tuned):
    """(direction, max_depth, learning_rate): the tuned values, which are
    shared, where a direction has none of its own; then the defaults."""
    specific = tuned.where(F.lit(False)).withColumn("direction", F.lit(None).cast("string"))
    return ml.param_lookup(directions, specific, tuned)


def fit_directions(table, params, features, base=Params()):
    """Models of each direction with its own parameters: directions that share
    a parameter set are fitted side by side."""
    sets = sorted({(p["max_depth"], p["learning_rate"]) for p in params})
    fitted = cells.fit_cells(table, features, [replace(base, max_depth=int(d), learning_rate=float(r)) for d, r in sets], by=["direction"])
    own = {p["direction"]: sets.index((p["max_depth"], p["learning_rate"])) for p in params}
    wanted = F.coalesce(*[F.when(F.col("direction") == k, F.lit(i)) for k, i in own.items()])
    return fitted.where(F.col("trial") == wanted)


@query("per_direction_gbt")
def q_per_direction_gbt(spark, sf):
    """Parameters tuned on one direction, written as JSON, read back and
    looked up per direction with fallback; one model per direction and target
    on that direction's own split."""
    d = direction_split_frame(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    tuned = tuned_parameters(spark, sf)
    params = chosen_per_direction(spark, d.select("direction").distinct(), tuned).collect()     # a handful of directions
    if not params:
        d.unpersist()
        return spark.createDataFrame([], "target string, direction string, split string, rmse double, mae double, n long, "
                                         "r2 double, max_depth int")
    fitted = fit_directions(part_cells(d, by=["direction"]), params, ml.FEATURES)
    depth = F.coalesce(*[F.when(F.col("direction") == p["direction"], F.lit(int(p["max_depth"]))) for p in params])
    return _release(round_floats(row_metrics(d, fitted, ml.FEATURES, ["direction"]).drop("rounds").withColumn("max_depth", depth)), d)


TUNE_DIRECTION = "clockwise"


def direction_split_frame(spark, sf):
    cols = ["segment_id", "datetime", "direction", *ml.FEATURES, *ml.TARGETS]
    return splits.chronological_split(fq.feature_frame(spark, sf).select(*cols), ORDER, by=["direction"]).drop("_pos")


def tuned_parameters(spark, sf, **search):
    """Best of the grid on one direction (mean RMSE over folds and targets),
    through a JSON file; a tuning direction without rows leaves the defaults."""
    table = part_cells(fold_frame(spark, sf, ["direction"]).where(F.col("direction") == TUNE_DIRECTION), "fold")
    best = cells.grid_search(table, ml.FEATURES, FOLDS, **search).orderBy("rmse", "max_depth", "learning_rate").limit(1)
    path = sinks.write_json_report(best, sinks.staging_path(spark, "best-params"))
    found = spark.read.schema(best.schema).json(path).select("max_depth", "learning_rate")
    nothing = spark.createDataFrame([(None, None)], found.schema)
    return found if not found.isEmpty() else nothing


@query("closed_form_models")
def q_closed_form_models(spark, sf):
    """Z-scores of a feature and the ridge and lasso fits on it, which have
    closed forms with one feature (see the SQL): MLlib's coefficients."""
    t, x = "total_traffic_flow", "hour"
    d = split_frame(spark, sf, persist=True)
    models = ml.fit_linear_models(d.where(F.col("split") == "train"), features=[x], targets=[t])
    rows = []
    for (kind, _), m in models.items():
        scaler, fit = m.stages[1], m.stages[2]
        rows.append((kind, float(scaler.mean[0]), float(scaler.std[0]), float(fit.coefficients[0]), float(fit.intercept)))
    d.unpersist()
    return round_floats(spark.createDataFrame(
        rows, "kind string, feature_mean double, feature_std double, coefficient double, intercept double"), 4)


@query("split_by_direction")
def q_split_by_direction(spark, sf):
    d = fq.feature_frame(spark, sf).select("segment_id", "datetime", "direction")
    return splits.chronological_split(d, ORDER, by=["direction"]).drop("_pos")


@query("residual_histogram")
def q_residual_histogram(spark, sf):
    return round_floats(profiles.auto_histogram(line_predictions(spark, sf), "residual"))


@query("saved_models")
def q_saved_models(spark, sf):
    """A line on one feature per target, saved, loaded again and scored."""
    d = split_frame(spark, sf, persist=True)
    models = ml.fit_linear_models(d.where(F.col("split") == "train"), features=["hour"], kinds=("linear",))
    path = sinks.staging_path(spark, "models")
    ml.save_models(models, path)
    return _release(round_floats(ml.evaluate_models(ml.load_models(path, models), d, features=["hour"]), 4), d)


@query("boosted_split")
def q_boosted_split(spark, sf):
    """One round of depth 1 on one feature: the best split of the training
    rows, as the prediction per hour and target."""
    d = split_frame(spark, sf, persist=True)
    models = ml.fit_gbt_per_target(d.where(F.col("split") == "train"), features=["hour"], max_depth=1, max_iter=1,
                                   subsampling=1.0, min_instances=1, colsample=1.0)
    hours, out = d.select("hour").distinct(), None
    for t, m in models.items():
        p = m.transform(hours).select(F.lit(t).alias("target"), "hour", "prediction")
        out = p if out is None else out.unionByName(p)
    return _release(round_floats(out), d)


@query("tuning_gain")
def q_tuning_gain(spark, sf):
    """RMSE gain in percent of the tuned parameters over the simple model
    (depth 3, 100 rounds, nothing sampled) on the validation part, per target."""
    p = tuned_parameters(spark, sf).first()
    tuned = Params(**{k: v for k, v in p.asDict().items() if v is not None})
    simple = Params(max_iter=ml.BASE_ROUNDS, max_depth=3, subsample=1.0, colsample=1.0, min_child_weight=1)
    e = cells.errors(cells.fit_cells(part_cells(split_frame(spark, sf)), ml.FEATURES, [simple, tuned])).where(F.col("part") == "val")
    rmse = [F.max(F.when(F.col("trial") == i, F.col("rmse"))) for i in (0, 1)]
    gain = F.coalesce(F.try_divide(100 * (rmse[0] - rmse[1]), rmse[0]), F.lit(0.0))
    return round_floats(e.groupBy("target").agg(gain.alias("gain_percent")).withColumns(
        {"max_depth": F.lit(tuned.max_depth), "learning_rate": F.lit(tuned.learning_rate)}))


# --- the same operators on one feature, where SQL has the answer --------------
# Unpenalised trees of full depth give every hour a leaf, so after r rounds a
# prediction has gone 1 - (1 - rate)^r of the way from the mean to the hour's.
FULL = Params(max_depth=24, subsample=1.0, colsample=1.0, min_child_weight=1, reg_lambda=0.0)


@query("early_stopping_by_hour")
def q_early_stopping_by_hour(spark, sf):
    table = part_cells(split_frame(spark, sf), features=["hour"])
    fitted = cells.fit_cells(table, ["hour"], [replace(FULL, patience=ml.PATIENCE)], watch="val")
    rounds = fitted.groupBy("target").agg(F.max("rounds").alias("rounds"))
    return round_floats(cells.errors(fitted).where(F.col("part") == "val").join(rounds, "target").select("target", "rounds", "n", "rmse"), 4)


@query("grid_search_by_hour")
def q_grid_search_by_hour(spark, sf):
    table = part_cells(fold_frame(spark, sf), "fold", features=["hour"])
    return round_floats(cells.grid_search(table, ["hour"], FOLDS, depths=(24,), rates=(0.01, 0.1, 0.3), base=replace(FULL, max_iter=20)), 4)


@query("direction_models_by_hour")
def q_direction_models_by_hour(spark, sf):
    """Rates read from a parameter file, where it has one for the direction."""
    d = direction_split_frame(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    params = parameter_lookup(spark, d, depth=24).collect()
    if not params:
        d.unpersist()
        return spark.createDataFrame([], "target string, direction string, split string, rmse double, mae double, n long, r2 double")
    fitted = fit_directions(part_cells(d, by=["direction"], features=["hour"]), params, ["hour"], replace(FULL, max_iter=20))
    return _release(round_floats(row_metrics(d, fitted, ["hour"], ["direction"]).drop("rounds"), 4), d)


def parameter_lookup(spark, d, depth):
    """Parameter files of the directions with at least half as many rows as the
    largest one (a rate of 0.3, no depth), and a shared one without a rate."""
    sizes = d.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    own = sizes.join(F.broadcast(most), F.col("n") * 2 >= F.col("most")).select(
        "direction", F.lit(None).cast("int").alias("max_depth"), F.lit(0.3).alias("learning_rate"))
    shared = spark.createDataFrame([(depth, None)], "max_depth int, learning_rate double")
    files = {}
    for name, frame in (("own", own), ("shared", shared)):
        path = sinks.write_json_report(frame, sinks.staging_path(spark, f"params-{name}"))
        files[name] = spark.read.schema(frame.schema).json(path)
    return ml.param_lookup(sizes.select("direction"), files["own"], files["shared"])


@query("parameter_lookup")
def q_parameter_lookup(spark, sf):
    return round_floats(parameter_lookup(spark, direction_split_frame(spark, sf), depth=7))


@query("importance_first_split")
def q_importance_first_split(spark, sf):
    """One round of depth 1: all of the gain goes to the feature of the best split."""
    one = replace(FULL, max_iter=1, max_depth=1)
    return round_floats(cells.importance(cells.fit_cells(part_cells(split_frame(spark, sf)), ml.FEATURES, [one]), ml.FEATURES))
