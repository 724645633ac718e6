"""Stacked spectra, band signals and phrase parsing against one signal at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import imaging, signal


@pytest.fixture(scope="module")
def signals(spark):
    rng = random.Random(2)
    made = {k: [rng.choice([rng.gauss(0, 1), 0.0, 1.0]) for _ in range(rng.choice([1, 2, 7, 16, 16, 33, 40]))] for k in range(60)} | {100: [2.0] * 12}
    rows = [(f"t{k}", k % 3, i, x) for k, v in made.items() for i, x in enumerate(v)]
    rng.shuffle(rows)
    return made, spark.createDataFrame([*rows, ("t0", 0, 99, None)], "trial_id string, channel int, sample_idx int, x double")


def test_welch(signals):
    made, df = signals
    got = {}
    for r in signal.welch(df, ["trial_id", "channel"], 32.0, 7).collect():
        got.setdefault(int(r.trial_id[1:]), {})[round(r.freq, 9)] = r.power
    window = np.hanning(8)[:-1]
    for k, v in made.items():
        parts = [np.abs(np.fft.rfft((np.array(v[s : s + 7]) - np.mean(v[s : s + 7])) * window)) ** 2 for s in range(0, len(v) - 6, 3)]
        if not parts:
            assert k not in got
            continue
        power = np.mean(parts, axis=0) / (32.0 * (window**2).sum())
        power[1:] *= 2
        assert list(got[k].values()) == pytest.approx(list(power), abs=1e-12) and list(got[k]) == pytest.approx(list(np.fft.rfftfreq(7, 1 / 32.0)))


def test_analytic_band(signals):
    made, df = signals
    got = {(int(r.trial_id[1:]), r.sample_idx): complex(r.re, r.im) for r in signal.analytic_band(df, ["trial_id", "channel"], 32.0, 3.0, 9.0).collect()}
    assert len(got) == sum(map(len, made.values()))
    for k, v in made.items():
        f = np.fft.fftfreq(len(v), 1 / 32.0)
        z = np.fft.ifft(np.where((f >= 3) & (f <= 9), 2 * np.fft.fft(v), 0))
        assert np.allclose([got[k, i] for i in range(len(v))], z)


def phrases(bits):
    seen, phrase, n = set(), "", 0
    for b in bits:
        phrase += b
        if phrase not in seen:
            seen.add(phrase)
            n, phrase = n + 1, ""
    return n + bool(phrase)


def test_lempel_ziv(signals, monkeypatch):
    made, df = signals
    monkeypatch.setattr(signal, "TRIE_CELLS", 50)
    got = {int(r.trial_id[1:]): r.complexity for r in signal.lempel_ziv(df, ["trial_id", "channel"]).collect()}
    for k, v in made.items():
        bits = "".join("1" if x > np.median(v) else "0" for x in v)
        assert got[k] == (pytest.approx(phrases(bits) / (len(v) / np.log2(len(v)))) if len(v) > 1 else None)


def test_phrase_counts_of_many_rows():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (200, 77)).astype(np.int8)
    assert signal.phrase_counts(bits).tolist() == [phrases("".join(map(str, b))) for b in bits]


def test_convolved_equals_the_plain_range_join(spark):
    rng = random.Random(4)
    trials = [("a", k, rng.uniform(-3, 60)) for k in range(40)] + [("a", 90, 6.0), ("b", 91, None)]
    frames = [(s, i * 0.75, rng.gauss(0, 1)) for s in "ab" for i in range(90)]
    span = 6.0
    got = {r.trial_id: (r.value, r.n_frames) for r in imaging.convolved(spark.createDataFrame(trials, "s string, trial_id int, onset double"), spark.createDataFrame(frames, "s string, time double, value double"), ["s"], span).collect()}
    want = {}
    for s, k, onset in trials:
        near = [(1 - abs(2 * (t - onset) / span - 1), v) for f, t, v in frames if onset is not None and f == s and onset <= t < onset + span]
        if near:
            total = sum(w for w, _ in near)
            want[k] = (sum(w * v for w, v in near) / total if total else None, len(near))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
