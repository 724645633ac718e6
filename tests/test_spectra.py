"""Prominence, robust lines and the measures built on them against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import spectra


def plain_prominence(v, i):
    low = []
    for step in (-1, 1):
        j = least = i
        while 0 <= j < len(v) and v[j] <= v[i]:
            least = j if v[j] < v[least] else least
            j += step
        low.append(v[least])
    return v[i] - max(low)


def plain_peaks(v):
    found, i = [], 1
    while i < len(v) - 1:
        if v[i - 1] < v[i]:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if j < len(v) - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    return found


def plain_line(x, y, rounds, z, least=5):
    keep = np.ones(len(x), bool)
    last = None
    for _ in range(rounds):
        last = np.polyfit(x[keep], y[keep], 1)
        res = y - np.polyval(last, x)
        mad = np.median(np.abs(res[keep] - np.median(res[keep]))) * 1.482602218505602
        new = keep & (res <= z * mad)
        if not (res[keep] > 0).any() or mad < 1e-12 or new.sum() < least:
            break
        keep = new
    return keep, last, np.polyfit(x[keep], y[keep], 1)


def random_series(n, seed):
    rng = random.Random(seed)
    return {g: [float(rng.choice([rng.gauss(0, 1), rng.randint(-2, 2)])) for _ in range(rng.choice([1, 2, 3, 5, 9, 40]))] for g in range(n)}


def random_spectra(n, seed):
    rng = np.random.default_rng(seed)
    f = np.arange(1.0, 65.0)
    return f, {g: 10 ** (1 - rng.uniform(0.5, 2) * np.log10(f) + rng.normal(0, 0.05, 64) + rng.uniform(0, 1.5) * np.exp(-((f - rng.uniform(7, 25)) ** 2) / rng.uniform(1, 6))) for g in range(n)}


@pytest.fixture(scope="module")
def made(spark):
    f, p = random_spectra(30, 3)
    rows = [(g, float(a), float(b)) for g, v in p.items() for a, b in zip(f, v, strict=True)]
    return f, p, spark.createDataFrame(rows, "g int, freq double, power double")


def test_prominence_of_every_local_maximum(spark):
    series = random_series(60, 5) | {100: [1.0] * 6, 101: [0.0, 2.0, 2.0, 2.0, 1.0, 2.0, 2.0, 0.0], 102: [3.0, 1.0, 3.0], 103: [0.0, 1.0, 1.0]}
    df = spark.createDataFrame([(g, float(i), x) for g, v in series.items() for i, x in enumerate(v)], "g int, i double, x double")
    got = {(r.g, int(r.i)): r.prominence for r in spectra.prominent_peaks(df, ["g"], "i", "x").collect()}
    want = {(g, i): plain_prominence(v, i) for g, v in series.items() for i in plain_peaks(v)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    some = {(r.g, int(r.i)) for r in spectra.prominent_peaks(df, ["g"], "i", "x", 0.5).collect()}
    assert some == {k for k, p in want.items() if p >= 0.5}


def test_series_without_usable_bins(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, float("nan")), (1, None, 3.0), (2, 5.0, float("inf"))], "g int, freq double, power double")
    assert spectra.prominent_peaks(df, ["g"], "freq", "power").count() == 0
    for out in (spectra.aperiodic_fit(df, ["g"]), spectra.periodic_measures(df, ["g"], (8.0, 13.0)), spectra.individual_alpha(df, ["g"])):
        assert all(all(v is None or v == 0 for v in r[1:]) for r in out.collect())
    assert spectra.peak_frequency(df, ["g"], 8.0, 13.0).count() == 0
    empty = df.where("g > 5")
    assert spectra.aperiodic_fit(empty, ["g"]).count() == spectra.fold_alpha(empty, "g", "g").count() == 0


def test_aperiodic_fit(made):
    f, p, df = made
    got = {r.g: r for r in spectra.aperiodic_fit(df, ["g"]).collect()}
    use = (f >= 2) & (f <= 40)
    x = np.log10(f[use])
    for g, v in p.items():
        y = np.log10(v[use])
        keep, _, (slope, offset) = plain_line(x, y, 3, 3.5)
        res = y[keep] - offset - slope * x[keep]
        assert (got[g].n_valid, got[g].n_kept) == (use.sum(), keep.sum())
        assert (got[g].offset, got[g].exponent, got[g].rms) == pytest.approx((offset, -slope, math.sqrt(np.mean(res**2))))
        assert got[g].r2 == pytest.approx(1 - np.sum(res**2) / np.sum((y[keep] - y[keep].mean()) ** 2))


def plain_alpha(f, v, low=7.0, high=13.0, least=0.05):
    x, y = np.log10(f), np.log10(v)
    use = (f >= 2) & (f <= 40)
    _, last, line = plain_line(x[use], y[use], 2, 2.5)
    res = (y - np.polyval(line, x))[(f >= low) & (f <= high)]
    own = f[(f >= low) & (f <= high)]
    peaks = [i for i in plain_peaks(list(res)) if plain_prominence(list(res), i) >= least]
    if peaks:
        return own[max(peaks, key=lambda i: plain_prominence(list(res), i))]
    positive = np.maximum(res, 0)
    return (own * positive).sum() / positive.sum() if positive.sum() > 0 else None


def test_individual_alpha_and_bands(made):
    f, p, df = made
    for least in (0.05, 0.6, 5.0):
        got = {r.g: r for r in spectra.individual_alpha(df, ["g"], least=least).collect()}
        for g, v in p.items():
            iaf = plain_alpha(f, v, least=least)
            assert got[g].iaf == (None if iaf is None else pytest.approx(iaf))
            if iaf is not None:
                low, high = max(6, iaf - 2), min(14, iaf + 2)
                assert (got[g].alpha_low, got[g].alpha_high, got[g].theta_low, got[g].theta_high, got[g].beta_low) == pytest.approx((low, high, max(3, iaf - 6), max(4, low), max(13, high)))


def test_fold_alpha_uses_the_other_folds_only(made, spark):
    f, p, df = made
    folded = df.withColumn("fold", F.col("g") % 3).withColumnRenamed("g", "trial_id")
    got = {r.fold: r.iaf for r in spectra.fold_alpha(folded, "fold").collect()}
    for k in range(3):
        assert got[k] == pytest.approx(plain_alpha(f, np.mean([v for g, v in p.items() if g % 3 != k], axis=0)))
    few = spectra.fold_alpha(folded.where("trial_id < 6"), "fold")  # four trials outside each fold
    assert [r.iaf for r in few.collect()] == [None] * 3


def test_peak_frequency(made):
    f, p, df = made
    for smoothing, least in ((0.0, 0.0), (1.0, 0.1), (3.0, 0.1), (2.0, 0.9)):
        got = {r.g: r for r in spectra.peak_frequency(df, ["g"], 8.0, 20.0, smoothing_hz=smoothing, least=least).collect()}
        for g, v in p.items():
            x, y = np.log10(f), np.log10(v)
            use, band = (f >= 2) & (f <= 40), (f >= 8) & (f <= 20)
            line = plain_line(x[use], y[use], 2, 2.5)[2]
            res = (y - np.polyval(line, x))[band]
            n = max(1, int(smoothing))
            at = np.clip(np.arange(len(res))[:, None] - n // 2 + np.arange(n), 0, len(res) - 1)
            ratio, level = (10**res)[at].mean(1), res[at].mean(1)
            k = int(np.argmax(ratio))
            peak = f[band][k]
            if level[k] - np.median(level) < least:
                peak = np.average(f[band], weights=ratio)
                k = int(np.argmin(abs(f[band] - peak)))
            assert (got[g].peak_freq, got[g].peak_power) == pytest.approx((peak, v[band][k]))
            assert got[g].peak_residual == pytest.approx(res[k]) and got[g].peak_ratio == pytest.approx(10 ** res[k])


def test_periodic_measures(made):
    f, p, df = made
    got = {r.g: r for r in spectra.periodic_measures(df, ["g"], (7.0, 25.0), z=2.0).collect()}
    use = (f >= 2) & (f <= 40)
    own, x = f[use], np.log10(f[use])
    peaked = 0
    for g, v in p.items():
        y = np.log10(v[use])
        keep, last, line = plain_line(x, y, 3, 2.0)
        old, res = y - np.polyval(last, x), y - np.polyval(line, x)
        out = np.flatnonzero(~keep & (old > 0))
        runs = np.split(out, np.flatnonzero(np.diff(out) > 1) + 1) if len(out) else []
        apexes = [c[np.argmax(old[c])] for c in runs]
        apexes = [i for i in apexes if 7 <= own[i] <= 25]
        if apexes:
            peaked += 1
            i = max(apexes, key=lambda k: old[k])
            w = np.maximum(old, 0)
            h = w[i] - plain_prominence(list(w), i) / 2
            ends = []
            for step in (-1, 1):
                j = i
                while h < w[j]:
                    j += step
                place = float(j)
                if w[j] < h:
                    place -= step * (h - w[j]) / (w[j - step] - w[j])
                ends.append(np.interp(place, np.arange(len(own)), own))
            assert (got[g].center, got[g].height, got[g].bandwidth) == pytest.approx((own[i], old[i], max(abs(ends[1] - ends[0]), 1e-6)))
        else:
            assert got[g].center is None and got[g].height is None
        band = lambda a, b, s: s[(own >= a) & (own <= b)]  # noqa: E731, B023
        assert got[g].theta_beta == pytest.approx(band(4, 7.9, 10**res).mean() / band(13, 30, 10**res).mean())
        assert got[g].theta_beta_raw == pytest.approx(band(4, 7.9, v[use]).mean() / band(13, 30, v[use]).mean())
        width = np.gradient(own)
        width[[0, -1]] /= 2
        assert got[g].corrected_power == pytest.approx(np.average(band(7, 25, 10**res), weights=band(7, 25, width)))
    assert peaked > 5
