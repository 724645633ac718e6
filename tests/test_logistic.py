"""Held-out logistic regression against refits of each fold in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import logistic


def plain_fit(x, y, strength):
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(y)), (x - mean) / np.where(sd > 0, sd, 1)])
    z[:, 1:][:, sd == 0] = 0
    w = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y <= 0).sum()))
    ridge = np.diag([0.0, *np.ones(x.shape[1])])
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(strength * (z * (w * p * (1 - p))[:, None]).T @ z + ridge + 1e-12 * np.eye(len(b)), strength * z.T @ (w * (y - p)) - ridge @ b)
    slopes = b[1:] / np.where(sd > 0, sd, 1)
    return np.append(b[0] - slopes @ mean, slopes)


def plain_score(w, x, y, scoring):
    eta = w[0] + x @ w[1:]
    if scoring == "log_loss":
        return -np.logaddexp(0, np.where(y > 0, -eta, eta)).mean()
    return np.mean([((eta > 0) == v)[y == v].mean() for v in (0, 1) if (y == v).any()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 240
    x = np.column_stack([rng.normal(size=n), 1e4 + 30 * rng.normal(size=n), np.full(n, 3.0)])
    g = rng.integers(0, 7, n)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - 1.5 * x[:, 0] - (x[:, 1] - 1e4) / 40))).astype(int)
    y[g == 6] = 1
    return x, y, g


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, g = data
    made = [(f"s{k}", int(k), *map(float, v), int(t)) for k, v, t in zip(g, x, y, strict=True)]
    bad = [("s1", 1, None, 1.0, 1.0, 1), ("s1", 1, float("nan"), 1.0, 1.0, 0), ("s1", 1, 1.0, 1.0, 1.0, None), (None, 1, 1.0, 1.0, 1.0, 1)]
    return spark.createDataFrame([*made, *bad], "s string, k int, a double, b double, c double, y int")


def test_every_fold_equals_its_own_refit(rows, data):
    x, y, g = data
    got = {r.s: r.weights for r in logistic.nested_logistic(rows, "s", ["a", "b", "c"], "y", [0.5]).collect()}
    for k in range(7):
        want = plain_fit(x[g != k], y[g != k], 0.5)
        assert np.allclose(got[f"s{k}"][1:], want[1:], atol=1e-6) and got[f"s{k}"][0] == pytest.approx(want[0], abs=1e-4)


@pytest.mark.parametrize("scoring", ["log_loss", "balanced_accuracy"])
def test_strength_is_chosen_by_inner_folds(rows, data, scoring):
    x, y, g = data
    grid = [10.0, 0.001, 0.05, 1.0]
    got = {r.s: r for r in logistic.nested_logistic(rows, "s", ["a", "b", "c"], "y", grid, F.col("k") % 3, scoring=scoring).collect()}
    for k in range(7):
        means = []
        for c in grid:
            scores = []
            for f in range(3):
                fit, held = (g != k) & (g % 3 != f), (g != k) & (g % 3 == f)
                if held.any():
                    scores.append(plain_score(plain_fit(x[fit], y[fit], c), x[held], y[held], scoring))
            means.append(np.mean(scores))
        best = grid[int(np.argmax(np.round(means, 9)))]
        assert got[f"s{k}"].strength == best
        assert np.allclose(got[f"s{k}"].weights[1:], plain_fit(x[g != k], y[g != k], best)[1:], atol=1e-6)


def test_one_class_and_no_rows(spark, rows):
    ones = rows.where("y = 1")
    assert logistic.nested_logistic(ones, "s", ["a"], "y", [1.0]).count() == 0
    assert logistic.nested_logistic(rows.where("k > 100"), "s", ["a"], "y", [1.0]).count() == 0
    # the held-out group has the only zeros: its others have one class
    lone = spark.createDataFrame([("u", 1.0, 0), ("u", 2.0, 1), ("v", 3.0, 1), ("w", 4.0, 1)], "s string, a double, y int")
    assert {r.s for r in logistic.nested_logistic(lone, "s", ["a"], "y", [1.0]).collect()} == {"v", "w"}


def test_separable_classes_stay_finite(spark):
    df = spark.createDataFrame([(k % 4, float(k), int(k > 20)) for k in range(40)], "s int, a double, y int")
    w = logistic.nested_logistic(df, "s", ["a"], "y", [100.0])
    p = logistic.probabilities(df, w, "s", ["a"]).collect()
    assert w.count() == 4 and all(0 <= r.p <= 1 and (r.p > 0.5) == r.y for r in p)


@pytest.mark.parametrize("scoring", ["log_loss", "balanced_accuracy"])
def test_counts_of_equal_rows_give_the_fits_of_the_rows(rows, monkeypatch, scoring):
    coarse = rows.withColumn("a", F.round("a", 1)).withColumn("b", F.round("b", -1))
    fit = lambda: {r.s: (r.strength, r.weights) for r in logistic.nested_logistic(coarse, "s", ["a", "b", "c"], "y", [0.001, 0.1, 3.0], F.col("k") % 3, scoring=scoring).collect()}
    counted = fit()
    monkeypatch.setattr(logistic, "_over_rows", None)  # counts take no pass over the rows
    assert fit() == counted
    monkeypatch.undo()
    monkeypatch.setattr(logistic, "MOST_DISTINCT", 1)
    passed = fit()
    assert counted.keys() == passed.keys() and len(counted) == 7
    for s, (strength, w) in passed.items():
        assert counted[s][0] == strength and np.allclose(counted[s][1], w, rtol=1e-6, atol=1e-6)
