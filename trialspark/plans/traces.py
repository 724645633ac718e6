"""Queries of event-related components, bursts and artifact metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traces as op
from ..operators import windows as win
from ..sources.tables import r, rounded, sql
from .spectra import prominence_sql

KEYS = ["trial_id", "channel"]


def _round(df, *columns, keep=()):
    return df.select(*keep, *(rounded(c).alias(c) for c in columns))


def _corrected(i):
    return win.baseline_correct(i.samples, "x", KEYS, F.col("t") < 0, "mean")


def _erp(i):
    return _round(op.component(_corrected(i), KEYS, "t", "corrected", 0.0, 10.0, "pos", 0.2), "mean", "peak", "latency", "area", keep=KEYS)


def _pair(i):
    side = lambda mode: op.component(_corrected(i), KEYS, "t", "corrected", 0.0, 10.0, mode)
    return _round(op.peak_pair(side("neg"), side("pos"), KEYS), "ptp", "latency_diff", keep=KEYS)


def _bursts(i, method):
    return _round(op.burst_metrics(i.trials, ["subject"], "outcome", "trial_id", 4.0, method=method, z=0.5, percentile=70.0), "rate", "duration", "amplitude", "fraction", keep=("subject", "bursts"))


BASE = ", b AS (SELECT trial_id * 8 + channel AS k, trial_id, channel, t, x - avg(x) FILTER (t < 0) OVER (PARTITION BY trial_id, channel) AS c FROM samples), e AS (SELECT k, trial_id, channel, t AS freq, c AS v FROM b WHERE t >= 0)"
ERP = (
    BASE
    + prominence_sql("e", "k")
    + """, a AS (SELECT k, any_value(trial_id) AS trial_id, any_value(channel) AS channel, avg(v) AS mean, arg_max(freq, v) AS top_t, max(v) AS top FROM e GROUP BY k),
    z AS (SELECT k, sum((v + pv) / 2 * 0.125) AS area FROM w WHERE pv IS NOT NULL GROUP BY k),
    best AS (SELECT k, freq, v FROM pr WHERE prominence >= 0.2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY prominence DESC, i) = 1)"""
)
BARS = {
    "zscore": "avg(outcome) OVER w + 0.5 * stddev_pop(outcome) OVER w",
    "mad": "mid + 0.5 * 1.4826 * median(abs(outcome - mid)) OVER w",
    "percentile": "quantile_cont(outcome, 0.7) OVER w",
}


def burst_sql(method: str) -> str:
    return sql("trials", f""", m AS (SELECT subject, trial_id, outcome, median(outcome) OVER (PARTITION BY subject) AS mid FROM trials),
    a AS (SELECT subject, trial_id, outcome, outcome > {BARS[method]} AS f FROM m WINDOW w AS (PARTITION BY subject)),
    g AS (SELECT *, trial_id - row_number() OVER (PARTITION BY subject, f ORDER BY trial_id) AS g FROM a),
    i AS (SELECT subject, f, count(*) AS n, max(outcome) AS top FROM g GROUP BY subject, f, g)
    SELECT subject, count(*) FILTER (f AND n >= 2) AS bursts, {r('count(*) FILTER (f AND n >= 2) * 4 / sum(n)')} AS rate, {r('avg(n) FILTER (f AND n >= 2) / 4')} AS duration, {r('avg(top) FILTER (f AND n >= 2)')} AS amplitude, {r('coalesce(sum(n) FILTER (f), 0) / sum(n)')} AS fraction FROM i GROUP BY subject""")


# where a place has no training trial, all its trials count
FOLD = """, u AS (SELECT *, re / sqrt(re * re + im * im) AS c, im / sqrt(re * re + im * im) AS s, trial_id % 4 > 0 AS fit FROM analytic),
    o AS (SELECT *, fit OR NOT bool_or(fit) OVER (PARTITION BY {by}) AS own FROM u),
    f AS (SELECT *, count(*) FILTER (own) OVER w AS n, sum(c) FILTER (own) OVER w AS c1, sum(s) FILTER (own) OVER w AS s1 FROM o WINDOW w AS (PARTITION BY {by}))"""

QUERIES = {
    "f11_erp_component": (_erp, sql("samples", ERP + f" SELECT trial_id, channel, {r('mean')} AS mean, {r('coalesce(best.v, top)')} AS peak, {r('coalesce(best.freq, top_t)')} AS latency, {r('area')} AS area FROM a JOIN z USING (k) LEFT JOIN best USING (k)")),
    "f11_peak_pair": (_pair, sql("samples", BASE + f" SELECT trial_id, channel, {r('max(v) - min(v)')} AS ptp, {r('arg_max(freq, v) - arg_min(freq, v)')} AS latency_diff FROM e GROUP BY trial_id, channel")),
    "f18_burst_zscore": (lambda i: _bursts(i, "zscore"), burst_sql("zscore")),
    "f18_burst_mad": (lambda i: _bursts(i, "mad"), burst_sql("mad")),
    "f18_burst_percentile": (lambda i: _bursts(i, "percentile"), burst_sql("percentile")),
    "f32_fold_phase_locking": (lambda i: _round(op.fold_phase_locking(i.analytic, ["subject", "channel", "t"], F.col("trial_id") % 4 > 0), "itpc", "loo", keep=("trial_id", "channel", "t")), sql("analytic", FOLD.format(by="subject, channel, t") + f" SELECT trial_id, channel, t, {r('sqrt(c1 * c1 + s1 * s1) / n')} AS itpc, {r('CASE WHEN own AND n > 1 THEN sqrt(power(c1 - c, 2) + power(s1 - s, 2)) / (n - 1) ELSE sqrt(c1 * c1 + s1 * s1) / n END')} AS loo FROM f")),
    "f32_condition_phase_locking": (lambda i: _round(op.fold_phase_locking(i.analytic, ["condition", "channel", "t"], F.lit(True)), "itpc", "loo", keep=("trial_id", "channel", "t")), sql("analytic", FOLD.replace("trial_id % 4 > 0", "true").format(by="condition, channel, t") + f" SELECT trial_id, channel, t, {r('sqrt(c1 * c1 + s1 * s1) / n')} AS itpc, {r('CASE WHEN n > 1 THEN sqrt(power(c1 - c, 2) + power(s1 - s, 2)) / (n - 1) ELSE sqrt(c1 * c1 + s1 * s1) / n END')} AS loo FROM f")),
    "f23_artifact_metrics": (lambda i: _round(op.artifact_metrics(i.samples, ["trial_id"], "t", "channel", "x", F.col("channel") < 6, F.col("channel") >= 6), "rms", "variance", "mean_abs_r", keep=("trial_id",)), sql("samples", f", c AS (SELECT a.trial_id, a.channel, b.channel AS other, coalesce(corr(a.x, b.x), 0) AS r FROM samples a JOIN samples b ON a.trial_id = b.trial_id AND a.t = b.t AND b.channel >= 6 WHERE a.channel < 6 GROUP BY ALL), m AS (SELECT trial_id, avg(abs(r)) AS r FROM c GROUP BY trial_id), s AS (SELECT trial_id, sqrt(avg(x * x)) AS q, var_pop(x) AS v FROM samples WHERE channel < 6 GROUP BY trial_id) SELECT trial_id, {r('q')} AS rms, {r('v')} AS variance, {r('r')} AS mean_abs_r FROM s JOIN m USING (trial_id)")),
}
