"""Cell tables, boosted trees on cells, folds by subtraction, searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.operators import boosting, cells, ml
from panelflow.operators.boosting import Params, boost
from panelflow.plans import ml_queries as mq
from panelflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
FREE = dict(subsample=1.0, colsample=1.0, min_child_weight=1, reg_lambda=0.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(int(h), int(w), None if i % 17 == 0 else float(np.sin(h) * 10 + w * 3 + rng.normal()), float(rng.normal()), int(i % 5) + 1,
             ["train", "train", "val", "test"][i % 4])
            for i, (h, w) in enumerate(zip(rng.integers(0, 24, 900), rng.integers(0, 2, 900)))]
    return spark.createDataFrame(data + [(None, 1, 5.0, 1.0, 1, "train"), (None, 0, None, 2.0, 2, "val")],
                                 "hour int, weekend int, a double, b double, fold int, split string").cache()


def test_cells_add_up_and_subtract(spark, rows):
    table = cells.cell_table(rows.withColumn("part", F.col("fold").cast("string")), ["hour", "weekend"], ["a", "b"], ["part"])
    whole = {(r["target"], r["hour"], r["weekend"]): r for r in cells.merged(table, ["hour", "weekend"]).collect()}
    direct = {(r["target"], r["hour"], r["weekend"]): r for r in cells.cell_table(rows, ["hour", "weekend"], ["a", "b"]).collect()}
    assert whole.keys() == direct.keys()
    for k, r in direct.items():
        assert whole[k]["n"] == r["n"] and whole[k]["mean"] == pytest.approx(r["mean"]) and whole[k]["m2"] == pytest.approx(r["m2"], abs=1e-6)
    n, mean = cells.minus(np.array([10.0, 3.0]), np.array([2.0, 5.0]), np.array([4.0, 3.0]), np.array([5.0, 5.0]))
    assert n.tolist() == [6.0, 0.0] and mean.tolist() == [0.0, 0.0]


def test_weighted_cells_give_mllibs_trees_on_rows(spark, rows):
    d = rows.where("hour is not null and a is not null")
    table = cells.cell_table(d, ["hour", "weekend"], ["a"]).where("target = 'a'").withColumnRenamed("mean", "a")
    options = dict(max_iter=5, subsampling=1.0, min_instances=1, colsample=1.0, max_depth=4)
    by_row = ml.gbt_pipeline(["hour", "weekend"], "a", **options).fit(d)
    by_cell = ml.gbt_pipeline(["hour", "weekend"], "a", weight="n", **options).fit(table)
    points = d.select("hour", "weekend").distinct()
    got = by_row.transform(points).select("hour", "weekend", F.col("prediction").alias("x")).join(
        by_cell.transform(points).select("hour", "weekend", F.col("prediction").alias("y")), ["hour", "weekend"])
    assert got.count() > 40 and got.where(F.abs(F.col("x") - F.col("y")) > 1e-9).count() == 0


def test_trees_on_cells_are_trees_on_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + rng.normal(size=400)
    for options in ({}, {"gamma": 0.5, "reg_alpha": 0.3, "reg_lambda": 2.0, "min_child_weight": 9}):
        p = Params(max_iter=15, max_depth=4, **{**FREE, **options})
        by_row = boost(x, np.ones(400), y, p)
        keys, at, n = np.unique(np.nan_to_num(x, nan=-1), axis=0, return_inverse=True, return_counts=True)
        mean = np.bincount(at.ravel(), y) / n
        by_cell = boost(np.where(keys < 0, np.nan, keys), n.astype(float), mean, p)
        np.testing.assert_allclose(by_cell.prediction[at.ravel()], by_row.prediction, atol=1e-9)


def test_one_split_is_the_best_split_and_missing_values_choose_a_side():
    x, n = np.array([[0.0], [1.0], [2.0], [3.0], [np.nan]]), np.array([5.0, 5.0, 5.0, 5.0, 2.0])
    fit = boost(x, n, np.array([1.0, 1.0, 9.0, 9.0, 9.0]), Params(max_iter=1, max_depth=1, learning_rate=1.0, **FREE))
    np.testing.assert_allclose(fit.prediction, [1, 1, 9, 9, 9])
    assert fit.gains.tolist() == [1.0] and fit.rounds == 1
    alone = boost(x, n, np.array([1.0, 1.0, 1.0, 1.0, 4.0]), Params(max_iter=1, max_depth=1, learning_rate=1.0, **FREE))
    np.testing.assert_allclose(alone.prediction, [1, 1, 1, 1, 4])
    assert boost(x, n * 0, n, Params()).rounds == 0
    few = boost(x, n, np.array([1.0, 1.0, 9.0, 9.0, 9.0]), Params(max_iter=1, max_depth=1, **{**FREE, "min_child_weight": 12}))
    assert np.ptp(few.prediction) == 0


def test_sampled_rows_are_binomial_and_reruns_agree():
    x, n = np.arange(30.0)[:, None], np.full(30, 40.0)
    mean = np.sin(x[:, 0])
    a, b = (boost(x, n, mean, Params(max_iter=40)).prediction for _ in range(2))
    assert (a == b).all() and np.abs(a - mean).mean() < 0.2
    assert (boost(x, n, mean, Params(max_iter=40, seed=1)).prediction != a).any()


def test_early_stopping_keeps_the_best_round():
    x = np.arange(8.0)[:, None]
    n, mean = np.full(8, 50.0), np.arange(8.0)
    watched, target = np.ones(8, bool), np.full(8, 3.5) + 0.3 * (np.arange(8) - 3.5)
    fit = boost(x, n, mean, Params(max_iter=200, max_depth=8, patience=20, **FREE), watched, n, target)
    # the way from the mean that is closest to 0.3
    want = min(range(1, 200), key=lambda r: abs(1 - 0.9 ** r - 0.3))
    assert fit.rounds == want
    np.testing.assert_allclose(fit.prediction, 3.5 + (1 - 0.9 ** want) * (mean - 3.5), atol=1e-9)


def test_folds_by_subtraction_equal_fits_on_each_training_set(spark, rows):
    d = rows.withColumn("part", F.col("fold").cast("string"))
    p = Params(max_iter=12, max_depth=3, **FREE)
    got = {(r["target"], r["fold"]): r["rmse"] for r in cells.errors(cells.fit_cells(
        cells.cell_table(d, ["hour", "weekend"], ["a", "b"], ["part"]), ["hour", "weekend"], [p], folds=range(1, 6))).collect()}
    for fold in range(1, 6):
        marked = rows.withColumn("part", F.when(F.col("fold") == fold, "test").otherwise("train"))
        e = cells.errors(cells.fit_cells(cells.cell_table(marked, ["hour", "weekend"], ["a", "b"], ["part"]), ["hour", "weekend"], [p]))
        for r in e.where("part = 'test'").collect():
            assert got.pop((r["target"], str(fold))) == pytest.approx(r["rmse"], rel=1e-9)
    assert not got
    grid = cells.grid_search(cells.cell_table(d, ["hour", "weekend"], ["a", "b"], ["part"]), ["hour", "weekend"], range(1, 6),
                             depths=(2, 3), rates=(0.1,), base=p)
    assert {r["max_depth"] for r in grid.collect()} == {2, 3}


def test_errors_on_cells_are_errors_on_rows(spark, rows):
    table = cells.cell_table(rows.withColumnRenamed("split", "part"), ["hour", "weekend"], ["a"], ["part"])
    fitted = cells.fit_cells(table, ["hour", "weekend"], [Params(max_iter=10)]).cache()
    by_cell = {r["part"]: r["rmse"] for r in cells.errors(fitted).collect()}
    pred = cells.predict_rows(rows, fitted, ["hour", "weekend"]).where("a is not null")
    assert pred.count() == rows.where("a is not null").count()
    for r in ml.regression_metrics(pred, "a", by=("split",)).collect():
        assert by_cell[r["split"]] == pytest.approx(r["rmse"], rel=1e-9)


def test_random_search_in_waves_is_the_search_one_by_one(spark, rows):
    table = cells.cell_table(rows.withColumnRenamed("split", "part"), ["hour", "weekend"], ["a", "b"], ["part"]).cache()
    space = {**ml.SEARCH_SPACE, "max_iter": (5, 40, "int")}
    one, many = (cells.random_search(table, ["hour", "weekend"], {"a": 2}, trials=12, patience=3, space=space, wave=w) for w in (1, 5))
    assert one == many and 4 <= len(one) <= 12
    rng = random.Random(7)
    assert one[0][0] == Params(**{k: ml.draw(rng, *b) for k, b in space.items()})
    assert cells.stopped_at([5, 4, 3, 4, 4, 4, 1], 3) == 6 and cells.stopped_at([3, 2, 1], 5) == 3


def test_defaults_are_the_whole_search_and_large_tables_are_refused(spark, rows, monkeypatch):
    asked = []
    monkeypatch.setattr(cells, "fit_cells", lambda c, f, trials, **kw: asked.append(trials) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        cells.grid_search(None, ["hour"], range(1, 6))
    assert [(p.max_depth, p.learning_rate, p.max_iter) for p in asked[0]] == [(d, r, 300) for d in (3, 5, 7) for r in (0.01, 0.1)]
    assert (cells.TRIALS, cells.TRIAL_PATIENCE) == (50, 10) and set(ml.SEARCH_SPACE) <= set(Params.__dataclass_fields__)
    monkeypatch.undo()
    monkeypatch.setattr(cells, "MAX_CELLS", 10)
    with pytest.raises(ValueError, match="gbt_pipeline"):
        cells.fit_cells(cells.cell_table(rows.withColumn("part", F.lit("train")), ["hour"], ["a"], ["part"]), ["hour"], [Params()])


@pytest.mark.parametrize("name", ["grid_search", "random_search", "per_direction_gbt", "tuning_gain", "gbt_early_stopping"])
def test_full_searches_end(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert got and all(v is not None for r in got for v in r)
    if name == "grid_search":
        assert {(r["max_depth"], r["learning_rate"]) for r in got} == {(d, x) for d in (3, 5, 7) for x in (0.01, 0.1)}
    if name == "random_search":
        assert 11 <= len(got) <= 50 and all(100 <= r["max_iter"] <= 1000 for r in got)
    if name == "per_direction_gbt":
        assert {r["target"] for r in got} == set(ml.TARGETS) and {r["split"] for r in got} == {"train", "val", "test"}


def test_a_tuning_direction_without_rows_leaves_the_defaults(spark, monkeypatch):
    monkeypatch.setattr(mq, "TUNE_DIRECTION", "nowhere")
    tuned = mq.tuned_parameters(spark, "/root/testdata/sf0.001")
    dirs = spark.createDataFrame([("east",)], "direction string")
    assert [tuple(r) for r in mq.chosen_per_direction(spark, dirs, tuned).collect()] == [("east", 5, 0.1)]
