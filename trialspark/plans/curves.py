"""Queries of outcome curves."""

from __future__ import annotations

from ..operators import curves as op
from ..sources.tables import r, rounded, sql


def _round(df, *keep):
    return df.select("subject", "trial_id", *keep, rounded("predicted", 4).alias("predicted"), rounded("residual", 4).alias("residual"))


FOLDS = """, s AS (SELECT subject, run, count(*) AS n FROM trials GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, run) AS k, count(*) OVER (PARTITION BY subject) AS runs FROM s),
    f AS (SELECT *, sum(n) FILTER (k = 2) OVER (PARTITION BY subject) AS second, max(n) OVER (PARTITION BY subject) AS top FROM k)"""

QUERIES = {
    "c13_curve_residual": (lambda i: _round(op.curve_residual(i.trials, ["subject"], "predictor", "outcome"), "curve"), None),
    "c13_line_residual": (lambda i: _round(op.curve_residual(i.trials, ["subject"], "predictor", "outcome", ((1, 0),))), sql("trials", f", f AS (SELECT subject, regr_slope(outcome, predictor) AS b, regr_intercept(outcome, predictor) AS a, count(*) AS n FROM trials GROUP BY subject) SELECT subject, trial_id, CASE WHEN n >= 10 THEN {r('a + b * predictor', 4)} END AS predicted, CASE WHEN n >= 10 THEN {r('outcome - a - b * predictor', 4)} END AS residual FROM trials JOIN f USING (subject)")),
    # three runs at most in two folds: the largest alone, the second starts the other, the third joins the smaller
    "c14_balanced_folds": (lambda i: op.balanced_folds(i.trials, ["subject"], "run", 2), sql("trials", FOLDS + " SELECT subject, run, CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN 1 WHEN k = 3 THEN CASE WHEN top <= second THEN 0 ELSE 1 END ELSE -1 END AS fold FROM f")),
    "c14_crossfit_curve": (lambda i: _round(op.crossfit_curve(i.trials, ["subject"], "run", "predictor", "outcome"), "fold"), None),
}
