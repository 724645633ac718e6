"""Queries of models validated over held-out groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossval as op
from ..operators import models, stats
from ..sources.tables import r, rounded, sql

GRID = [0.1, 10.0, 1000.0]
ALPHA = 10.0


def _round(df, *columns, keep=(), digits=6):
    return df.select(*keep, *(rounded(c, digits).alias(c) for c in columns))


def _rows(i):
    return i.trials.select("subject", "run", "trial_id", "predictor", "outcome")


def _nested(i):
    w = op.nested_ridge(_rows(i), [], "subject", ["predictor"], "outcome", GRID, F.col("subject") % 5)
    return w.select("subject", "penalty", rounded(F.get("weights", F.lit(0))).alias("intercept"), rounded(F.get("weights", F.lit(1))).alias("slope"))


def _loso(i, rows=None):
    rows = _rows(i) if rows is None else rows
    w = op.nested_ridge(rows, [], "subject", ["predictor"], "outcome", [ALPHA])
    return op.predicted(rows, w, ["subject"], ["predictor"])


def _within(i):
    rows = _rows(i)
    p = op.predicted(rows, op.nested_ridge(rows, ["subject"], "run", ["predictor"], "outcome", [ALPHA]), ["subject", "run"], ["predictor"])
    return _round(models.regression_errors(p, ["subject"], "outcome", "prediction"), "mae", "rmse", "r2", keep=("subject", "n"))


def _scores(i):
    mean = _rows(i).join(models.held_out_mean(_rows(i), "subject", "outcome"), "subject")
    straight = op.nested_ridge(_rows(i), [], "subject", ["predictor"], "outcome", [0.0])
    plain = op.predicted(_rows(i), straight, ["subject"], ["predictor"])
    return op.fold_scores(_loso(i), "subject", "outcome", "prediction", "ridge").unionByName(op.fold_scores(mean, "subject", "outcome", "prediction", "mean")).unionByName(op.fold_scores(plain, "subject", "outcome", "prediction", "line"))


def _incremental(i):
    both = _loso(i).withColumnRenamed("prediction", "full").join(models.held_out_mean(_rows(i), "subject", "outcome").withColumnRenamed("prediction", "base"), "subject")
    return _round(op.incremental_r2(both, "subject", "outcome", "base", "full"), "r2_base", "r2_full", "delta", keep=("subject",))


def _importance(i):
    rows = _rows(i)
    w = op.nested_ridge(rows, [], "subject", ["predictor"], "outcome", [ALPHA])
    return _round(op.permutation_importance(rows, w, "subject", "trial_id", ["predictor"], "outcome", 10), "importance", keep=("subject", "feature"), digits=5)


def _windows(i):
    """One row for each trial and time: mean over channels, and the trial's condition as target."""
    return i.samples.groupBy("subject", "run", "trial_id", F.col("sample_idx").alias("window")).agg(F.avg("x").alias("x"), F.max("condition").cast("double").alias("y"))


def _shuffled_windows(i, n_perm):
    labels = i.raw("embeddings").select(F.col("vec_id").alias("trial_id"), (F.col("vec_id") % 25).cast("int").alias("subject"), F.col("label").cast("double").alias("y"))
    mixed = stats.permuted(labels, ["subject"], "trial_id", "y", n_perm).select("perm", "trial_id", F.col("permuted").alias("y"))
    return _windows(i).drop("y").join(mixed, "trial_id")


def _significance(i):
    observed = op.time_generalisation(_windows(i), [], "subject", "window", ["x"], "y", ALPHA)
    null = op.time_generalisation(_shuffled_windows(i, 10), ["perm"], "subject", "window", ["x"], "y", ALPHA)
    return op.generalisation_significance(observed, null).select("train", "test", rounded("p").alias("p"), rounded("q").alias("q"), "max_stat")


def _generalisation_clusters(i):
    nine = lambda t: t.withColumn("r", F.round("r", 9))
    observed = op.time_generalisation(_windows(i), [], "subject", "window", ["x"], "y", ALPHA)
    null = op.time_generalisation(_shuffled_windows(i, 10), ["perm"], "subject", "window", ["x"], "y", ALPHA)
    found = op.generalisation_clusters(nine(observed), nine(null), 0.4)
    return found.select((F.col("label.train") * 1000 + F.col("label.test")).cast("int").alias("label"), "n", "significant")


# sums of the other groups, about no mean: the columns are small
REST = """, o AS (SELECT subject, count(*)::DOUBLE AS n, sum(predictor) AS sx, sum(outcome) AS sy, sum(predictor * predictor) AS sxx, sum(predictor * outcome) AS sxy FROM trials GROUP BY subject),
    t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM o),
    q AS (SELECT o.subject, t.n - o.n AS n, t.sx - o.sx AS sx, t.sy - o.sy AS sy, t.sxx - o.sxx AS sxx, t.sxy - o.sxy AS sxy FROM o, t),
    l AS (SELECT subject, a, (sxy - sx * sy / n) / (sxx - sx * sx / n) * n / (n + a) AS b, sy / n AS my, sx / n AS mx, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * n / (n + a) * sx / n AS c FROM q, (VALUES (0.0::DOUBLE), (10.0)) v(a)),
    p AS (SELECT t.*, c + b * predictor AS guess, my FROM trials t JOIN l ON t.subject = l.subject AND l.a = 10.0)"""
NESTED = """, v AS (SELECT unnest([0.1, 10.0, 1000.0])::DOUBLE AS a), u AS (SELECT DISTINCT subject FROM trials),
    f AS (SELECT u.subject, k, regr_slope(outcome, predictor) AS b, avg(outcome) AS my, avg(predictor) AS mx, count(*)::DOUBLE AS n FROM u CROSS JOIN (SELECT unnest(range(5)) AS k) JOIN trials t ON t.subject <> u.subject AND t.subject % 5 <> k GROUP BY ALL),
    e AS (SELECT f.subject, a, sum(power(outcome - my - b * n / (n + a) * (predictor - mx), 2)) AS sse FROM f CROSS JOIN v JOIN trials t ON t.subject <> f.subject AND t.subject % 5 = f.k GROUP BY ALL),
    w AS (SELECT subject, a FROM e QUALIFY row_number() OVER (PARTITION BY subject ORDER BY sse, a) = 1),
    g AS (SELECT u.subject, regr_slope(outcome, predictor) AS b, avg(outcome) AS my, avg(predictor) AS mx, count(*)::DOUBLE AS n FROM u JOIN trials t ON t.subject <> u.subject GROUP BY u.subject)"""
TG = """, x AS (SELECT subject, trial_id, sample_idx AS w, avg(x) AS x, max(condition)::DOUBLE AS y0 FROM samples GROUP BY ALL),
    d AS (SELECT DISTINCT subject, trial_id, y0 FROM x),
    k AS (SELECT d.*, perm, row_number() OVER (PARTITION BY subject, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM d, (SELECT unnest(range(10)) AS perm)),
    y AS (SELECT a.trial_id, a.perm, b.y0 AS y FROM k a JOIN k b ON a.subject = b.subject AND a.perm = b.perm AND a.place = b.drawn UNION ALL SELECT trial_id, -1, y0 FROM d),
    s AS (SELECT subject, w, perm, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x JOIN y USING (trial_id) GROUP BY ALL),
    b AS (SELECT subject, w, perm, sum(n) OVER v - n AS n, sum(sx) OVER v - sx AS sx, sum(sy) OVER v - sy AS sy, sum(sxx) OVER v - sxx AS sxx, sum(sxy) OVER v - sxy AS sxy FROM s WINDOW v AS (PARTITION BY w, perm)),
    l AS (SELECT subject, w AS train, perm, sign(sxy - sx * sy / n) AS sgn FROM b),
    c AS (SELECT subject, w AS test, perm, corr(x, y) AS r FROM x JOIN y USING (trial_id) GROUP BY ALL),
    g AS (SELECT perm, train::INT AS train, test::INT AS test, count(*) AS n, tanh(avg(atanh(greatest(-0.999999, least(0.999999, sgn * r))))) AS r FROM l JOIN c USING (subject, perm) WHERE r IS NOT NULL GROUP BY ALL)"""

QUERIES = {
    "m14_nested_ridge": (_nested, sql("trials", NESTED + f" SELECT subject, a AS penalty, {r('my - b * n / (n + a) * mx')} AS intercept, {r('b * n / (n + a)')} AS slope FROM g JOIN w USING (subject)")),
    "m19_label_permutation": (lambda i: op.label_permutation(_rows(i), "subject", ["subject", "run"], "trial_id", ["predictor"], "outcome", ALPHA, 10).select(rounded("observed").alias("observed"), "n_perm", "extreme", rounded("p").alias("p")), sql("trials", """, k AS (SELECT subject, run, trial_id, predictor AS x, outcome AS y, perm, row_number() OVER (PARTITION BY subject, run, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, run, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM trials, (SELECT unnest(range(10)) AS perm)),
    y AS (SELECT a.subject, a.perm, a.x, b.y FROM k a JOIN k b ON a.subject = b.subject AND a.run = b.run AND a.perm = b.perm AND a.place = b.drawn UNION ALL SELECT subject, -1, predictor, outcome FROM trials),
    s AS (SELECT subject, perm, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM y GROUP BY ALL),
    b AS (SELECT subject, perm, sum(n) OVER v - n AS n, sum(sx) OVER v - sx AS sx, sum(sy) OVER v - sy AS sy, sum(sxx) OVER v - sxx AS sxx, sum(sxy) OVER v - sxy AS sxy FROM s WINDOW v AS (PARTITION BY perm)),
    p AS (SELECT y.perm, y.y, sy / n + (sxy - sx * sy / n) / (sxx - sx * sx / n) * n / (n + 10) * (x - sx / n) AS guess FROM y JOIN b USING (subject, perm)), c AS (SELECT perm, corr(y, guess) AS r FROM p GROUP BY perm)""" + f" SELECT {r('any_value(o.r)')} AS observed, count(c.r) AS n_perm, count(*) FILTER (abs(c.r) >= abs(o.r) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(c.r) >= abs(o.r) - 1e-12) + 1) / (count(*) + 1)')} AS p FROM c, (SELECT r FROM c WHERE perm = -1) o WHERE perm >= 0")),
    "m20_compare_models": (lambda i: op.compare_models(_scores(i), "subject", [("ridge", "mean"), ("ridge", "line"), ("line", "mean")]).select("ma", "mb", rounded("difference").alias("difference"), rounded("p").alias("p"), rounded("p_holm").alias("p_holm")), sql("trials", REST + """, m AS (SELECT t.subject, avg(power(outcome - my, 2)) FILTER (l.a = 0) AS mean, avg(power(outcome - c - b * predictor, 2)) FILTER (l.a = 0) AS line, avg(power(outcome - c - b * predictor, 2)) FILTER (l.a = 10) AS ridge FROM trials t JOIN l USING (subject) GROUP BY t.subject),
    d AS (SELECT subject, 'ridge' AS ma, 'mean' AS mb, ridge - mean AS d FROM m UNION ALL SELECT subject, 'ridge', 'line', ridge - line FROM m UNION ALL SELECT subject, 'line', 'mean', line - mean FROM m),
    z AS (SELECT *, row_number() OVER (PARTITION BY ma, mb ORDER BY subject) - 1 AS place, count(*) OVER (PARTITION BY ma, mb) AS size FROM d),
    s AS (SELECT ma, mb, pat, avg(CASE WHEN size <= 12 THEN 1 - 2 * ((pat >> place) & 1) WHEN pat = 0 THEN 1 ELSE 1 - 2 * (('0x' || substr(md5('1|' || pat || '|' || place), 1, 8))::BIGINT % 2) END * d) AS stat FROM z, (SELECT unnest(range(4096)) AS pat) WHERE pat < CASE WHEN size <= 12 THEN 1 << size::INT ELSE 1001 END GROUP BY ALL),
    h AS (SELECT s.ma, s.mb, any_value(o.stat) AS difference, (count(*) FILTER (abs(s.stat) >= abs(o.stat) - 1e-12) + 1) / (count(*) + 1) AS p FROM s JOIN s o ON s.ma = o.ma AND s.mb = o.mb AND o.pat = 0 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (ORDER BY p, ma, mb) AS k, count(*) OVER () AS m FROM h)""" + f" SELECT ma, mb, {r('difference')} AS difference, {r('p')} AS p, {r('max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, ma, mb ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM k")),
    "m21_incremental_r2": (_incremental, sql("trials", REST + f", z AS (SELECT subject, 1 - sum(power(outcome - my, 2)) / nullif(var_pop(outcome) * count(*), 0) AS a, 1 - sum(power(outcome - guess, 2)) / nullif(var_pop(outcome) * count(*), 0) AS b FROM p GROUP BY subject) SELECT subject, {r('a')} AS r2_base, {r('b')} AS r2_full, {r('b - a')} AS delta FROM z")),
    "m22_permutation_importance": (_importance, sql("trials", REST + """, k AS (SELECT p.subject, trial_id, predictor AS x, outcome AS y, guess, perm, row_number() OVER (PARTITION BY p.subject, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY p.subject, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM p, (SELECT unnest(range(10)) AS perm))""" + f" SELECT a.subject, 'predictor' AS feature, {r('avg(power(a.y - a.guess - l.b * (s.x - a.x), 2) - power(a.y - a.guess, 2))', 5)} AS importance FROM k a JOIN k s ON a.subject = s.subject AND a.perm = s.perm AND a.place = s.drawn JOIN l ON l.subject = a.subject AND l.a = 10 GROUP BY a.subject")),
    "m26_time_generalisation": (lambda i: _round(op.time_generalisation(_windows(i), [], "subject", "window", ["x"], "y", ALPHA), "r", keep=("train", "test", "n")), sql("samples", TG + f" SELECT train, test, n, {r('r')} AS r FROM g WHERE perm = -1")),
    "m27_generalisation_significance": (_significance, sql("samples", TG + """, m AS (SELECT quantile_cont(m, 0.95) AS top FROM (SELECT max(abs(r)) AS m FROM g WHERE perm >= 0 GROUP BY perm)),
    p AS (SELECT o.train, o.test, any_value(o.r) AS o, (count(*) FILTER (abs(g.r) >= abs(o.r) - 1e-12) + 1) / (count(g.r) + 1) AS p FROM g JOIN g o ON o.perm = -1 AND g.train = o.train AND g.test = o.test WHERE g.perm >= 0 GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (ORDER BY p, train, test) AS k, count(*) OVER () AS m FROM p)""" + f" SELECT train, test, {r('p')} AS p, {r('least(1.0, min(p * m / k) OVER (ORDER BY p, train, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q, abs(o) >= (SELECT top FROM m) AS max_stat FROM h")),
    "m27_generalisation_clusters": (_generalisation_clusters, sql("samples", TG + """, h AS (SELECT perm, train, test, round(r, 9) AS r FROM g), n AS (SELECT perm, train AS a, test AS b FROM h WHERE abs(r) >= (SELECT quantile_cont(abs(r), 0.6) FROM h WHERE perm >= 0)),
    reach AS (SELECT perm, a, b, a AS a2, b AS b2 FROM n UNION SELECT q.perm, q.a, q.b, n.a, n.b FROM reach q JOIN n ON n.perm = q.perm AND abs(n.a - q.a2) + abs(n.b - q.b2) = 1),
    lab AS (SELECT perm, a, b, min(a2 * 1000 + b2)::INT AS l FROM reach GROUP BY ALL), size AS (SELECT perm, l, count(*) AS n FROM lab GROUP BY ALL),
    top AS (SELECT quantile_cont(coalesce(m, 0), 0.95) AS top FROM (SELECT DISTINCT perm FROM g WHERE perm >= 0) LEFT JOIN (SELECT perm, max(n) AS m FROM size GROUP BY perm) USING (perm))
    SELECT l AS label, n, n >= top AS significant FROM size, top WHERE perm = -1""").replace("WITH ", "WITH RECURSIVE ", 1)),
    "m29_regression_run": (lambda i: _round(models.subject_level_r(_loso(i), "subject", "outcome", "prediction"), "r", "low", "high", keep=("n_subjects",)), sql("trials", REST + f", c AS (SELECT subject, atanh(greatest(-0.999999, least(0.999999, corr(outcome, guess)))) AS z FROM p GROUP BY subject HAVING count(*) >= 3), s AS (SELECT count(*) AS n, avg(z) AS z, stddev_samp(z) / sqrt(count(*)) AS se FROM c) SELECT n AS n_subjects, {r('tanh(z)')} AS r, {r('tanh(z - 1.96 * se)')} AS low, {r('tanh(z + 1.96 * se)')} AS high FROM s")),
    "m29_within_subject_run": (_within, sql("trials", f", u AS (SELECT DISTINCT subject, run FROM trials), l AS (SELECT u.subject, u.run, CASE WHEN var_pop(predictor) > 0 THEN regr_slope(outcome, predictor) ELSE 0 END * count(*) / (count(*) + 10) AS b, avg(outcome) AS my, avg(predictor) AS mx FROM u JOIN trials t ON t.subject = u.subject AND t.run <> u.run GROUP BY ALL), p AS (SELECT t.*, my + b * (predictor - mx) AS guess FROM trials t LEFT JOIN l USING (subject, run)) SELECT subject, count(guess) AS n, {r('avg(abs(outcome - guess))')} AS mae, {r('sqrt(avg(power(outcome - guess, 2)))')} AS rmse, {r('1 - sum(power(outcome - guess, 2)) / nullif(var_pop(outcome) * count(outcome), 0)')} AS r2 FROM p GROUP BY subject")),
}
