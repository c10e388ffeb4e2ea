import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import dqspark.operators.quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture
def awkward(spark):
    """Repeats, huge and tiny magnitudes, both signs, missing values, a missing group."""
    rng = random.Random(5)
    pick = lambda: rng.choice(
        [rng.gauss(0, 1e3), float(rng.randint(-5, 5)), 1e300 * rng.random(), -1e-300 * rng.random(), 7.25, None]
    )
    rows = [(rng.choice(["a", "a", "a", "b", None]), pick()) for _ in range(2000)] + [("one", 3.5)]
    return rows, spark.createDataFrame(rows, "g string, x double").cache()


def values(rows, keep=lambda g: True):
    return [x for g, x in rows if x is not None and keep(g)]


@pytest.mark.parametrize("last_rows", [200_000, 10])
def test_columns_equal_numpy(monkeypatch, awkward, last_rows):
    rows, df = awkward
    monkeypatch.setattr(Q, "LAST_ROWS", last_rows)
    got = Q.column_quantiles(df, ["x"], PROBS)["x"]
    np.testing.assert_allclose(got, np.quantile(values(rows), PROBS), rtol=1e-12)


@pytest.mark.parametrize("broadcast_rows", [20_000, 3])
def test_groups_equal_numpy(monkeypatch, awkward, broadcast_rows):
    rows, df = awkward
    monkeypatch.setattr(Q, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(Q, "LAST_ROWS", 50)
    got = {r["g"]: r["q"] for r in Q.grouped_quantiles(df, ["g"], "x", PROBS).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        np.testing.assert_allclose(q, np.quantile(values(rows, lambda k: k == g), PROBS), rtol=1e-12)


def test_many_columns_and_no_values(spark):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, None), (4, 2.5, None)], "a int, b double, c double")
    got = Q.column_quantiles(df, ["a", "b", "c"], [0.25, 0.75])
    assert got == {"a": [1.5, 3.0], "b": [1.75, 2.25], "c": None}


def test_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "x double")
    assert Q.column_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"] == [float("-inf"), 1.0, float("inf")]


def test_partitioning_does_not_matter(awkward):
    _, df = awkward
    one, eight = (Q.column_quantiles(df.repartition(n), ["x"], PROBS) for n in (1, 8))
    assert one == eight


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_any_floats(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = Q.column_quantiles(df, ["x"], [0.25, 0.5])["x"]
    np.testing.assert_allclose(got, np.quantile(np.array(xs, dtype=float), [0.25, 0.5]), rtol=1e-9, atol=1e-30)
