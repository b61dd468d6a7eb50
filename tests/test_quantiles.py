import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelflow.operators import quantiles
from panelflow.operators.quantiles import exact_quantiles, quantile_columns

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50)), min_size=1, max_size=300))
def test_exact_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double")
    q = exact_quantiles(df, "v", PROBS, by=["g"], num_partitions=4).toPandas()
    for g in {g for g, _ in rows}:
        vals = np.array([v for gg, v in rows if gg == g], dtype=float)
        got = q[q.g == g].sort_values("i")["quantile"].to_numpy()
        assert np.allclose(got, np.percentile(vals, [p * 100 for p in PROBS]))


def test_quantile_columns_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "v double")
    r = quantile_columns(df, "v", [0.5, 0.25], ["med", "q1"]).first()
    assert (r.med, r.q1) == (2.0, 1.5)


def reference(vals, probs):
    return [float(x) for x in np.percentile(np.array(vals, float), [p * 100 for p in probs])]


def test_large_groups_ties_and_infinities(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = {0: rng.normal(size=20_000), 1: np.repeat(3.0, 9_000), 2: rng.integers(0, 5, 15_000).astype(float),
              3: np.concatenate([rng.exponential(size=4_000), np.repeat(0.0, 4_000)]), 4: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [(5, None), (None, 1.0)], "g int, v double").repartition(6)
    for inside in (10 ** 6, 2_000, 50):         # 50: narrowed until the brackets hold little else
        monkeypatch.setattr(quantiles, "INSIDE", inside)
        q = exact_quantiles(df, "v", PROBS, by=["g"]).toPandas()
        assert set(q.g) == set(values)
        for g, vals in values.items():
            assert q[q.g == g].sort_values("i")["quantile"].tolist() == pytest.approx(reference(vals, PROBS), abs=1e-12)
    whole = exact_quantiles(df.where("g = 0"), "v", [i / 100 for i in range(1, 100)]).toPandas().sort_values("i")
    assert whole["quantile"].tolist() == pytest.approx(reference(values[0], [i / 100 for i in range(1, 100)]), abs=1e-12)


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 1, "nan", "inf", "-inf", "nan")], "v double")
    q = [r["quantile"] for r in exact_quantiles(df, "v", [0.0, 0.2, 0.6, 0.8, 1.0]).orderBy("i").collect()]
    assert q[:3] == [float("-inf"), 1.0, float("inf")] and np.isnan(q[3]) and np.isnan(q[4])
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_a_bracket_that_misses_its_rank_is_widened(spark, monkeypatch):
    tried = []
    real = quantiles._bracketed

    def narrow(d, by, probs, margin):
        tried.append(margin)
        sizes, nans, brackets = real(d, by, probs, margin)
        return sizes, nans, {g: [(-5.0, -4.0)] for g in brackets} if len(tried) == 1 else brackets
    monkeypatch.setattr(quantiles, "_bracketed", narrow)
    df = spark.range(5000).selectExpr("cast(id as double) v")
    assert [r["quantile"] for r in exact_quantiles(df, "v", [0.25, 0.5]).orderBy("i").collect()] == [1249.75, 2499.5]
    assert len(tried) == 2 and tried[1] > tried[0]


def test_describe_reads_its_input_three_times_at_most(spark):
    from panelflow.operators import profiles

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(3000).selectExpr("cast(id % 700 as double) a", "cast(id as double) b").mapInArrow(run, "a double, b double")
    got = profiles.describe(df, ["a", "b"]).collect()
    assert len(got) and seen.value <= 3 * 3000
