"""Lone values, silent signals, constant columns, single folds, large offsets and keys with awkward names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import extended, imaging, signal, stats


def test_rank_sum_of_a_lone_value(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("m", "a", 1.0), ("m", "b", 2.0), ("m", "b", 3.0)], "rank string, g string, v double")
    got = {r["rank"]: r for r in stats.rank_sum(df, ["rank"], "v", "g", [("a", "b")]).collect()}
    assert got["k"].z is None and got["m"].u == 0.0 and got["m"].z < 0


def test_spectral_shape_of_one_bin(spark):
    r = signal.spectral_shape(spark.createDataFrame([(1, 5.0, 2.0)], "k int, freq double, power double"), ["k"]).first()
    assert r.centre == 5.0 and r.bandwidth == 0.0 and r.entropy is None


def test_phase_amplitude_with_a_silent_sample(spark):
    rows = [(1, 0, t, 1.0 if t else 0.0, 0.0) for t in range(4)] + [(1, 1, t, 2.0, 0.0) for t in range(4)]
    r = signal.phase_amplitude(spark.createDataFrame(rows, "k int, channel int, t int, re double, im double"), ["k"], 0, 1).first()
    assert r.pac == pytest.approx(6 / 8) and r.pac_raw == pytest.approx(6 / 4)


def test_phase_locking_of_opposite_phases(spark):
    rows = [(1, 1.0, 0.0), (1, -1.0, 0.0), (2, 1.0, 0.0), (2, 1.0, 0.0)]
    got = signal.phase_locking(spark.createDataFrame(rows, "k int, re double, im double"), ["k"]).collect()
    assert {r.k: r.itpc for r in got} == {1: 0.0, 2: 1.0}
    assert [r.alignment for r in got if r.k == 1] == [None, None] and [r.alignment for r in got if r.k == 2] == [1.0, 1.0]


def test_crossfit_with_one_fold_and_a_null_fold(spark):
    one = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0)], "fold int, n double, y double")
    assert [r.residual for r in extended.crossfit_residual(one, "fold", "n", "y").collect()] == [None, None]
    two = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (None, 3.0, 7.0), (None, None, 1.0)], "fold int, x double, y double")
    got = {(r.fold, r.x): r.residual for r in extended.crossfit_residual(two, "fold", "x", "y").collect()}
    assert got[None, 3.0] == pytest.approx(1.0) and got[None, None] is None


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_crossfit_keeps_its_digits(spark, offset):
    rng = np.random.default_rng(0)
    x, y, fold = np.arange(30.0), rng.normal(size=30), np.arange(30) % 3
    df = spark.createDataFrame([(int(f), float(a + offset), float(b + offset), i) for i, (f, a, b) in enumerate(zip(fold, x, y, strict=True))], "fold int, x double, y double, i int")
    got = {r.i: r.residual for r in extended.crossfit_residual(df, "fold", "x", "y").collect()}
    for i in range(30):
        b, a = np.polyfit(x[fold != fold[i]], y[fold != fold[i]], 1)
        assert got[i] == pytest.approx(y[i] - a - b * x[i], abs=1e-5 if offset else 1e-9)


def test_spline_of_a_constant(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "k0 int, x double")
    assert sorted((r.k0, r.curve) for r in extended.spline_basis(df, "x").where("x IS NOT NULL").collect()) == [(1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_repeated_measures_under_an_offset_and_a_unit_named_u(spark, offset):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6, 3)) + [0.0, 0.3, 0.9]
    df = spark.createDataFrame([("x", i, c, float(v[i, c] + offset)) for i in range(6) for c in range(3)] + [("x", 9, 0, offset)], "key string, u int, c int, value double")
    r = imaging.repeated_measures(df, ["key"], "u", "c", "value").first()
    ssc = 6 * ((v.mean(0) - v.mean()) ** 2).sum()
    sse = ((v - v.mean(0) - v.mean(1)[:, None] + v.mean()) ** 2).sum()
    assert (r.dof1, r.dof2) == (2, 10) and r.f == pytest.approx((ssc / 2) / (sse / 10), rel=1e-5)


@pytest.mark.parametrize(("name", "make"), [
    ("t", lambda d: stats.two_groups(d, ["t"], "v", F.col("v") > 0, F.col("v") <= 0)),
    ("n", lambda d: stats.simple_regression(d, ["n"], "v", "v")),
    ("R", lambda d: stats.correlations(d, ["R"], "v", "v")),
    ("f", lambda d: imaging.repeated_measures(d, ["f"], "v", "v", "v")),
])
def test_a_key_named_like_a_result_is_refused(spark, name, make):
    df = spark.createDataFrame([(1, 1.0)], f"{name} int, v double")
    with pytest.raises(ValueError, match=name.lower()):
        make(df)
