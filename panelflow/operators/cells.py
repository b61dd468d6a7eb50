"""Regression on sufficient statistics: cell tables, fits of many models
side by side, cross-validation by subtraction and parameter search.

A cell is a distinct feature vector with, per target, its number of rows,
their mean and their squared deviation (``m2``).  One grouped aggregate over
the rows (combined before the shuffle) makes the table; everything after it
works on cells, however many rows there are.  Statistics add up, so the
training set of a fold is all cells minus the fold's: no copies of rows.
Fits are independent: a *job* is a group, a target, a parameter set and a
held-out fold, and Spark deals jobs to tasks.  Errors of a fit on any part
follow from the part's cells: sum of m2 + n (mean - prediction)^2.

A job holds the cells of one group, at most ``MAX_CELLS``: features with
few distinct values, such as hours and day kinds.  A larger table is an
error that names the row-wise MLlib fits (`ml.gbt_pipeline`, whose weight
column takes cell tables too).
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelflow.operators.boosting import Params, boost
from panelflow.operators.ml import SEARCH_SPACE, draw

MAX_CELLS = 100_000
ALL = "all"         # the part that holds the cells of all parts together


def cell_table(df: DataFrame, features, targets, by=()) -> DataFrame:
    """(``*by``, ``*features``, target, n, mean, m2): rows with a missing
    target are not counted for it; a missing feature is a value of its own."""
    keys = [*by, *features]
    wide = df.groupBy(*keys).agg(*[a for i, t in enumerate(targets) for a in (
        F.count(t).alias(f"_n{i}"), F.avg(t).alias(f"_a{i}"), (F.var_pop(t) * F.count(t)).alias(f"_m{i}"))])
    return wide.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(t).alias("target"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean"), F.col(f"_m{i}").alias("m2"))
        for i, t in enumerate(targets)])).alias("_c")).select(*keys, "_c.*").where("n > 0")


def merged(cells: DataFrame, keys) -> DataFrame:
    """Cells added up to coarser ones over ``keys`` (features included)."""
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    added = cells.groupBy(*keys, "target").agg(F.sum("n").alias("_n"), mean.alias("_mean"), F.sum("m2").alias("_m2"),
                                               F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    return added.select(*keys, "target", F.col("_n").alias("n"), F.col("_mean").alias("mean"),
                        (F.col("_m2") + F.greatest(F.col("_q") - F.col("_n") * F.col("_mean") * F.col("_mean"), F.lit(0.0))).alias("m2"))


def minus(total_n, total_mean, part_n, part_mean):
    """Counts and means of cells without a part of their rows."""
    n = total_n - part_n
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, np.where(n > 0, (total_n * total_mean - part_n * part_mean) / n, 0.0)


def _checked(cells: DataFrame, by) -> None:
    most = cells.groupBy(*by, "target", "part").count().agg(F.max("count")).first()[0] or 0
    if most > MAX_CELLS:
        raise ValueError(f"{most} distinct feature vectors in one part (at most {MAX_CELLS}): fit rows with ml.gbt_pipeline")


def fit_cells(cells: DataFrame, features, trials: list[Params], by=(), train: str = "train", watch: str | None = None,
              folds: Iterable | None = None) -> DataFrame:
    """Fit every trial on the cells of part ``train`` of each group and target
    and predict the cells of all parts.

    ``cells``: a cell table with a string column ``part``.  ``watch``: the part
    that stops fits early.  ``folds``: instead, one fit per fold (a part), on
    all parts but that one; only the fold's cells are predicted.
    Returns (``*by``, target, trial, fold, part, ``*features``, n, mean, m2,
    prediction, rounds, gains)."""
    by, features = list(by), list(features)
    _checked(cells, by)
    spark = cells.sparkSession
    numbers = F.explode(F.array(*[F.lit(i) for i in range(len(trials))])).alias("trial")
    base = cells.select(*by, "target", "part", *[F.col(f).cast("double").alias(f) for f in features],
                        F.col("n").cast("double").alias("n"), "mean", "m2")
    if folds is None:
        jobs = base.select("*", F.lit(None).cast("string").alias("fold"))
    else:
        names = [str(f) for f in folds]
        whole = merged(base, [*by, *features]).withColumn("part", F.lit(ALL)).select(*base.columns)
        held = base.where(F.col("part").isin(names)).withColumn("fold", F.col("part"))
        everywhere = whole.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in names])))
        jobs = everywhere.unionByName(held)
    jobs = jobs.withColumn("trial", numbers)
    job = [*by, "target", "trial", "fold"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", *features], na_position="first", kind="stable").reset_index(drop=True)
        x, n, mean = pdf[features].to_numpy(float), pdf["n"].to_numpy(), pdf["mean"].to_numpy()
        p, part = trials[int(pdf["trial"].iloc[0])], pdf["part"].to_numpy()
        if folds is None:
            training = np.where(part == train, n, 0.0)
            watched = part == watch if watch else np.zeros(len(pdf), bool)
            fit = boost(x, training, mean, p, watched, n, mean)
            out = pdf
        else:
            both = pdf[part == ALL][[*features, "n", "mean"]].merge(pdf[part != ALL], on=features, how="left", suffixes=("_all", ""))
            rest_n, rest_mean = minus(both["n_all"].to_numpy(), both["mean_all"].to_numpy(), both["n"].fillna(0.0).to_numpy(),
                                      both["mean"].fillna(0.0).to_numpy())
            fit = boost(both[features].to_numpy(float), rest_n, rest_mean, p)
            own = both["n"].notna().to_numpy()
            out, fit.prediction = both[own], fit.prediction[own]
        return out.assign(prediction=fit.prediction, rounds=fit.rounds, gains=[fit.gains.tolist()] * len(out))[names_out]

    schema = jobs.select(*job, "part", *features, "n", "mean", "m2").schema
    names_out = [*schema.names, "prediction", "rounds", "gains"]
    schema = schema.add("prediction", "double").add("rounds", "integer").add("gains", ArrayType(DoubleType()))
    width = len(trials) * max(1, len(list(folds)) if folds is not None else 1) * 3
    tasks = max(1, min(width, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return jobs.repartition(tasks, *job).groupBy(*job).applyInPandas(run, schema)


def errors(fitted: DataFrame, by=()) -> DataFrame:
    """(``*by``, target, trial, fold, part, n, rmse) of fitted cells."""
    miss = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("prediction")) ** 2)
    return fitted.groupBy(*by, "target", "trial", "fold", "part").agg(
        F.sum("n").cast("long").alias("n"), F.sqrt(miss / F.sum("n")).alias("rmse"))


def predict_rows(df: DataFrame, fitted: DataFrame, features, by=(), part: str = "split") -> DataFrame:
    """Rows of ``df`` with the ``prediction`` (and ``target``) of their cell,
    one row per target; cells are joined on part, group and features."""
    keys = [*by, *features]
    p = fitted.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "target", "prediction", "rounds")
    same = reduce(lambda a, b: a & b, [F.col(part) == F.col("_part"), *[
        F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]])
    return df.join(p, same).drop("_part", *[f"_k{i}" for i in range(len(keys))])


def importance(fitted: DataFrame, features, by=()) -> DataFrame:
    """(``*by``, target, feature, importance): shares of the total gain."""
    one = fitted.groupBy(*by, "target").agg(F.first("gains").alias("gains"))
    return one.select(*by, "target", F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"),
                                                            F.col("gains").alias("importance"))).alias("g")) \
        .select(*by, "target", "g.feature", "g.importance")


# -- searches ---------------------------------------------------------------------------

def grid_search(cells: DataFrame, features, folds, depths=(3, 5, 7), rates=(0.01, 0.1), base: Params = Params()) -> DataFrame:
    """(max_depth, learning_rate, rmse): mean over folds and targets of the
    error of models tuned jointly (one parameter set for all targets).
    ``cells``: a cell table whose ``part`` is the fold."""
    grid = [replace(base, max_depth=d, learning_rate=r, patience=0) for d in depths for r in rates]
    e = errors(fit_cells(cells, features, grid, folds=list(folds)))
    per_fold = e.groupBy("trial", "fold").agg(F.avg("rmse").alias("rmse")).groupBy("trial").agg(F.avg("rmse").alias("rmse"))
    named = cells.sparkSession.createDataFrame([(i, p.max_depth, p.learning_rate) for i, p in enumerate(grid)],
                                               "trial int, max_depth int, learning_rate double")
    return named.join(per_fold, "trial").drop("trial")


TRIALS, TRIAL_PATIENCE = 50, 10


def stopped_at(objectives: list[float], patience: int) -> int:
    """Number of trials that a one-by-one search would have made."""
    best = 0
    for i, o in enumerate(objectives):
        if o < objectives[best]:
            best = i
        elif i - best >= patience:
            return i + 1
    return len(objectives)


def random_search(cells: DataFrame, features, scale_hint: dict, trials: int = TRIALS, patience: int = TRIAL_PATIENCE, seed: int = 7,
                  space=None, wave: int = 16) -> list[tuple[Params, float]]:
    """Seeded random search over ``space``: (parameters, objective) of each
    trial, the objective being the mean over targets of RMSE / standard
    deviation (both of part ``val``) / scale hint.

    Trials are drawn in advance and fitted in waves, every trial and target a
    task of its own; patience is judged in trial order, so the rows are those
    of a search that fits one trial after the other, and no further wave
    starts once it has run out."""
    rng = random.Random(seed)
    drawn = [Params(**{k: draw(rng, *bounds) for k, bounds in (space or SEARCH_SPACE).items()}) for _ in range(trials)]
    cells = cells.where(F.col("part").isin("train", "val"))
    val = merged(cells.where(F.col("part") == "val"), []).select("target", "n", "m2").collect()
    spread = {r["target"]: math.sqrt(r["m2"] / (r["n"] - 1)) if r["n"] > 1 and r["m2"] > 0 else 1.0 for r in val}
    objectives: list[float] = []
    for at in range(0, trials, wave):
        batch = drawn[at:at + wave]
        e = errors(fit_cells(cells, features, batch)).where(F.col("part") == "val").collect()
        for i in range(len(batch)):
            scores = [r["rmse"] / spread[r["target"]] / scale_hint.get(r["target"], 1.0) for r in e if r["trial"] == i]
            objectives.append(sum(scores) / len(scores) if scores else math.inf)
        if stopped_at(objectives, patience) < len(objectives):
            break
    made = stopped_at(objectives, patience)
    return list(zip(drawn[:made], objectives[:made]))
