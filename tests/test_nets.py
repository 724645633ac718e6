"""Elastic nets from sums of products against plain numpy on the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import crossval

GRID = [(0.01, 0.5), (0.3, 0.5), (2.0, 0.5), (0.05, 1.0), (0.3, 1.0), (0.3, 0.0)]


def plain_net(x, y, penalty, mix):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        old = w.copy()
        for j in range(len(w)):
            rho = z[:, j] @ (y - y.mean() - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = 0 if sd[j] == 0 else np.sign(rho) * max(abs(rho) - penalty * mix, 0) / (1 + penalty * (1 - mix))
        if abs(w - old).max() < 1e-14:
            break
    w = w / np.where(sd > 0, sd, 1)
    return np.append(y.mean() - w @ mean, w)


def chosen(x, y, folds, grid):
    sse = []
    for p, m in grid:
        total = 0.0
        for f in sorted(set(folds)):
            w = plain_net(x[folds != f], y[folds != f], p, m)
            total += ((y[folds == f] - w[0] - x[folds == f] @ w[1:]) ** 2).sum()
        sse.append(total)
    return int(np.argmin(sse))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    n = 160
    x = rng.normal(size=(n, 4))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[:, 3] = 7.0  # constant
    y = 1.5 * x[:, 0] - 0.4 * x[:, 2] + rng.normal(size=n) + 1e6
    x[:, 2] += 1e5
    return x, y, rng.integers(0, 8, n)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, g = data
    made = [(int(a), *map(float, b), float(c)) for a, b, c in zip(g, x, y, strict=True)]
    return spark.createDataFrame([*made, (3, None, 1.0, 1.0, 1.0, 1.0), (3, float("nan"), 1.0, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, d double, y double")


def test_nested_net_equals_refits(rows, data):
    x, y, g = data
    got = {r.g: r for r in crossval.nested_net(rows, [], "g", list("abcd"), "y", GRID, F.col("g") % 3).collect()}
    for k in range(8):
        keep = g != k
        place = chosen(x[keep], y[keep], g[keep] % 3, GRID)
        assert (got[k].penalty, got[k].mix) == GRID[place]
        want = plain_net(x[keep], y[keep], *GRID[place])
        assert np.allclose(got[k].weights[1:], want[1:], atol=1e-6) and got[k].weights[0] == pytest.approx(want[0], rel=1e-6)


@pytest.mark.parametrize("point", GRID)
def test_every_grid_point(rows, data, point):
    x, y, g = data
    (r,) = crossval.net_over_folds(rows, list("abcd"), "y", "g", [point]).collect()
    want = plain_net(x, y, *point)
    assert np.allclose(r.weights[1:], want[1:], atol=1e-6) and r.weights[0] == pytest.approx(want[0], rel=1e-6)


def test_net_over_gapped_and_null_folds(rows, data):
    x, y, g = data
    fold = F.when(F.col("g") == 5, None).otherwise(F.concat(F.lit("f"), F.col("g") * 10))
    (r,) = crossval.net_over_folds(rows.withColumn("fold", fold), list("abcd"), "y", "fold", GRID).collect()
    assert (r.penalty, r.mix) == GRID[chosen(x, y, g, GRID)]
    assert crossval.net_over_folds(rows.where("g > 100"), list("abcd"), "y", "g", GRID).count() == 0


def test_path_finds_the_conditions_of_the_optimum():
    rng = random.Random(0)
    x = np.array([[rng.gauss(0, 1) for _ in range(6)] for _ in range(50)])
    y = x @ [2, 0, 0, -1, 0.5, 0] + np.array([rng.gauss(0, 1) for _ in range(50)])
    z = np.column_stack([np.ones(50), x, y])
    for (p, m), w in zip(GRID, crossval._net((z.T @ z)[None], GRID)[0], strict=True):
        sd = x.std(0)
        slope = ((x - x.mean(0)) / sd).T @ (y - w[0] - x @ w[1:]) / 50 - p * (1 - m) * w[1:] * sd
        assert all(abs(s - p * m * np.sign(b)) < 1e-7 if b else abs(s) <= p * m + 1e-7 for s, b in zip(slope, w[1:], strict=True))


def test_label_permutation_of_a_nested_net(rows):
    fit = lambda d, keys, y: crossval.nested_net(d, keys, "g", ["a", "c"], y, [(0.05, 0.5), (0.5, 0.5)], F.col("g") % 2)
    usable = rows.where("a IS NOT NULL AND NOT isnan(a)").withColumn("i", F.monotonically_increasing_id())
    r = crossval.label_permutation(usable, "g", ["g"], "i", ["a", "c"], "y", 0.0, 19, fit).first()
    assert r.observed > 0.5 and r.p == pytest.approx(1 / 20)


def test_permutations_without_a_slope_tie_with_the_observed(spark):
    made = np.random.default_rng(6).normal(size=(2000, 5)) + 1e4
    rows = [(g, 5 * g + k, float(k), float(v)) for g, own in enumerate(made) for k, v in enumerate(own)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double").repartition(4, "i")
    fit = lambda d, keys, y: crossval.nested_net(d, keys, "g", ["x"], y, [(100.0, 1.0)])
    r = crossval.label_permutation(df, "g", ["g"], "i", ["x"], "y", 0.0, 9, fit).first()
    near = made - 1e4
    guess = np.repeat((near.sum() - near.sum(axis=1)) / (near.size - 5), 5)
    assert r.observed == pytest.approx(np.corrcoef(near.ravel(), guess)[0, 1], abs=1e-12)
    assert (r.n_perm, r.extreme, r.p) == (9, 9, 1.0)


def test_scores_by_metric(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 5.0), (2, 4.0, 4.0), (2, 4.0, 5.0)], "g int, y double, p double")
    got = {m: {r.g: r[m] for r in crossval.fold_scores(df, "g", "y", "p", "x", m).collect()} for m in ("mse", "mae", "r2", "r")}
    assert got["mse"][1] == pytest.approx(5 / 3) and got["mae"][1] == pytest.approx(1.0) and got["r2"][1] == pytest.approx(1 - 5 / 2)
    assert got["r"][1] == pytest.approx(np.corrcoef([1, 2, 3], [2, 2, 5])[0, 1]) and got["r2"][2] is None and got["r"][2] is None
