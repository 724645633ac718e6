"""Components, bursts and artifact metrics against plain Python on awkward traces."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trialspark.operators import traces

from .test_spectra import plain_peaks, plain_prominence


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    out = {k: [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1), rng.randint(-2, 2) * 1.0, None, float("nan")]) for _ in range(rng.choice([1, 2, 3, 12, 30]))] for k in range(40)} | {90: [None, None], 91: [1.0] * 5}
    rows = [(k, i / 10, x) for k, v in out.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    return out, spark.createDataFrame(rows, "g int, t double, x double")


@pytest.mark.parametrize(("mode", "least"), [("pos", 0.0), ("pos", 0.7), ("neg", 0.7), ("abs", 0.3)])
def test_component(made, mode, least):
    out, df = made
    got = {r.g: r for r in traces.component(df, ["g"], "t", "x", 0.1, 2.0, mode, least).collect()}
    for k, v in out.items():
        v = [x if x is not None and x == x else None for x in v[1:20]]
        known = [x for x in v if x is not None]
        if not known:
            assert k not in got
            continue
        mid = statistics.median(known)
        full = [mid if x is None else x for x in v]
        search = [{"pos": x, "neg": -x, "abs": abs(x)}[mode] for x in full]
        peaks = [i for i in plain_peaks(search) if plain_prominence(search, i) >= least] if least else []
        at = max(peaks, key=lambda i: plain_prominence(search, i)) if peaks else search.index(max(search))
        area = [(a + b) / 20 for a, b in zip(v, v[1:], strict=False) if a is not None and b is not None]
        r = got[k]
        assert (r.mean, r.peak, r.latency) == pytest.approx((statistics.fmean(known), full[at], (at + 1) / 10))
        assert r.area == (pytest.approx(sum(area)) if area else None)


def test_bursts_by_every_threshold(made):
    out, df = made
    df = df.withColumn("base", F.col("t") < 1.5).where("NOT isnan(x) OR x IS NULL")
    for method in ("zscore", "mad", "percentile"):
        got = {r.g: r for r in traces.burst_metrics(df, ["g"], "x", "t", 10.0, method=method, z=0.4, percentile=60.0, baseline=F.col("base")).collect()}
        for k, v in out.items():
            v = [(i / 10, x) for i, x in enumerate(v) if x is None or x == x]
            base = [x for t, x in v if x is not None and t < 1.5]
            if not v:
                continue
            bar = None
            if base:
                mid, s = statistics.median(base), sorted(base)
                at = 0.6 * (len(s) - 1)
                bar = {
                    "zscore": statistics.fmean(base) + 0.4 * statistics.pstdev(base),
                    "mad": mid + 0.4 * 1.4826 * statistics.median([abs(x - mid) for x in base]),
                    "percentile": s[math.floor(at)] + (at - math.floor(at)) * (s[math.ceil(at)] - s[math.floor(at)]),
                }[method]
            up = [bar is not None and x is not None and x > bar for _, x in v]
            runs, run = [], []
            for f, (_, x) in zip([*up, False], [*v, (0, None)], strict=True):
                if f:
                    run.append(x)
                elif run:
                    runs.append(run)
                    run = []
            kept = [r for r in runs if len(r) >= 2]
            r = got[k]
            assert (r.bursts, r.rate, r.fraction) == (len(kept), pytest.approx(len(kept) * 10 / len(v)), pytest.approx(sum(up) / len(v)))
            assert r.duration == (pytest.approx(statistics.fmean(map(len, kept)) / 10) if kept else None)
            assert r.amplitude == (pytest.approx(statistics.fmean(map(max, kept))) if kept else None)


def test_artifact_metrics_with_a_constant_channel(spark):
    rows = [(1, c, t, x) for c, v in enumerate([[1.0, 2.0, 4.0], [2.0, 2.0, 2.0], [3.0, 1.0, 0.0]]) for t, x in enumerate(v)]
    r = traces.artifact_metrics(spark.createDataFrame(rows, "g int, c int, t int, x double"), ["g"], "t", "c", "x", F.col("c") < 2, F.col("c") == 2).first()
    x = [1.0, 2.0, 4.0, 2.0, 2.0, 2.0]
    assert (r.rms, r.variance) == pytest.approx((math.sqrt(sum(a * a for a in x) / 6), statistics.pvariance(x)))
    assert r.mean_abs_r == pytest.approx(abs(statistics.correlation([1.0, 2.0, 4.0], [3.0, 1.0, 0.0])) / 2)


def test_fold_phase_locking(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(3) for i in range(6)] + [(0, 6, 0.0, 0.0), (1, 6, 0.0, 0.0), (9, 0, 1.0, 1.0)]
    train = {(k, i): i % 2 == 0 and k != 2 for k, i, *_ in rows}
    df = spark.createDataFrame(rows, "k int, i int, re double, im double")
    got = {(r.k, r.i): r for r in traces.fold_phase_locking(df, ["k"], (F.col("i") % 2 == 0) & (F.col("k") != 2)).collect()}
    unit = {(k, i): complex(a, b) / abs(complex(a, b)) for k, i, a, b in rows if a or b}
    for k, i, *_ in rows:
        fit = [j for q, j, *_ in rows if q == k and (train[k, j] or not any(train[k, m] for p, m, *_ in rows if p == k))]
        use = [unit[k, j] for j in fit if (k, j) in unit]
        whole = abs(sum(use)) / len(use)
        others = [unit[k, j] for j in fit if j != i and (k, j) in unit]
        alone = i in fit and (k, i) in unit and len(use) > 1
        assert got[k, i].itpc == pytest.approx(whole) and got[k, i].loo == pytest.approx(abs(sum(others)) / len(others) if alone else whole)
