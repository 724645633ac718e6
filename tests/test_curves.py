"""Outcome curves against least squares in numpy."""

import numpy as np
import pytest

from trialspark.operators import curves


def design(x, degree, knots, train):
    lo, hi = train.min(), train.max()
    u, t = (x - lo) / (hi - lo), (train - lo) / (hi - lo)
    at = np.percentile(t, [100 * k / (knots + 1) for k in range(1, knots + 1)])
    return np.stack([u**p for p in range(degree + 1)] + [np.maximum(u - k, 0) ** degree for k in at], axis=1)


def predict(train, outcome, x, kinds):
    best = None
    for c, (d, k) in enumerate(kinds):
        a = design(train, d, k, train)
        w = np.linalg.lstsq(a, outcome, rcond=None)[0]
        n, rss = len(train), float(((outcome - a @ w) ** 2).sum())
        aic = n * (np.log(2 * np.pi * rss / n) + 1) + 2 * a.shape[1]
        if best is None or aic < best[0]:
            best = (aic, c, design(x, d, k, train) @ w)
    return best[1], best[2]


def folds_of(groups, n_folds):
    size = {g: groups.count(g) for g in set(groups)}
    full, out = [0] * min(n_folds, len(size)), {}
    for g in sorted(size, key=lambda g: (-size[g], g)):
        out[g] = full.index(min(full))
        full[out[g]] += size[g]
    return out


def made():
    rng = np.random.default_rng(4)
    rows = []
    for s, shape in enumerate((lambda x: 1e6 + 3 * x, lambda x: np.abs(x - 40) * 2, lambda x: (x / 30) ** 3)):
        for i in range(70):
            x = float(rng.uniform(0, 100))
            rows.append((s, i, int(rng.integers(0, 6)) ** 2 // 4, x, float(shape(np.array(x)) + rng.normal())))
    return rows


SCHEMA = "s int, i int, run int, x double, y double"


@pytest.mark.parametrize("kinds", [curves.SPLINES, ((2, 0),), ((1, 0), (3, 2), (5, 0))])
def test_curve_matches_least_squares(spark, kinds):
    rows = made()
    got = {(r.s, r.i): r for r in curves.curve_residual(spark.createDataFrame(rows, SCHEMA), ["s"], "x", "y", kinds).collect()}
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        x, y = np.array([r[3] for r in mine]), np.array([r[4] for r in mine])
        c, p = predict(x, y, x, kinds)
        for r, want in zip(mine, p, strict=True):
            assert got[s, r[1]].curve == c and got[s, r[1]].predicted == pytest.approx(want, rel=1e-9, abs=1e-6)
            assert got[s, r[1]].residual == pytest.approx(r[4] - want, abs=1e-5)


def test_crossfit_holds_out_balanced_folds(spark):
    rows = made()
    got = {(r.s, r.i): r for r in curves.crossfit_curve(spark.createDataFrame(rows, SCHEMA), ["s"], "run", "x", "y", 3).collect()}
    assert len(got) == len(rows)
    for s in range(3):
        mine = [r for r in rows if r[0] == s]
        fold = folds_of([r[2] for r in mine], 3)
        x, y, f = (np.array(v) for v in zip(*((r[3], r[4], fold[r[2]]) for r in mine), strict=True))
        for held in sorted(set(f)):
            c, p = predict(x[f != held], y[f != held], x, curves.SPLINES)
            for k in np.flatnonzero(f == held):
                row = got[s, mine[k][1]]
                assert (row.fold, row.curve) == (held, c) and row.predicted == pytest.approx(p[k], rel=1e-8, abs=1e-5)


def test_missing_values_short_and_flat_keys(spark):
    rows = [(0, i, i % 2, float(i) if i else None, float(i % 3)) for i in range(30)] + [(1, i, 0, float(i), 1.0) for i in range(9)] + [(2, i, i % 3, 5.0, float(i)) for i in range(20)] + [(3, 0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.s, r.i): r.residual for r in curves.curve_residual(df, ["s"], "x", "y").collect()}
    assert len(got) == len(rows) and got[0, 0] is None and got[0, 1] is not None
    assert all(v is None for (s, _), v in got.items() if s > 0)
    crossed = {(r.s, r.i): r.residual for r in curves.crossfit_curve(df, ["s"], "run", "x", "y").collect()}
    assert len(crossed) == len(rows) and {s for (s, _), v in crossed.items() if v is not None} == {0}
    assert curves.crossfit_curve(df.where("false"), ["s"], "run", "x", "y").count() == 0
