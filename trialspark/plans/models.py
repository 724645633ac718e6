"""Queries of the imaging tables and of model building and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import imaging as im
from ..operators import models as op
from ..operators import stats
from ..operators.windows import moment_corr
from ..sources.tables import r, rounded, sql


def _round(df, *columns, keep=(), digits=6):
    return df.select(*keep, *(rounded(c, digits).alias(c) for c in columns))


def _scored(i):
    """Held-out group means as predictions of the outcome."""
    return i.trials.join(op.held_out_mean(i.trials, "run", "outcome"), "run").withColumn("guess", F.col("prediction") * 0.5 + F.col("predictor"))


def _class(i):
    return i.trials.select("subject", (F.col("outcome") > 40).cast("int").alias("y"), ((F.col("predictor") + 0.5) / 101).alias("p"))


SCORED = ", h AS (SELECT run, (SELECT sum(outcome) FROM trials) - sum(outcome) AS s, (SELECT count(*) FROM trials) - count(*) AS n FROM trials GROUP BY run), g AS (SELECT t.*, s / n AS prediction, s / n * 0.5 + predictor AS guess FROM trials t JOIN h USING (run))"
CORR = ", c AS (SELECT a.subject, a.run, a.roi AS a, b.roi AS b, count(*) AS n, CASE WHEN stddev_pop(a.value) > 1e-9 AND stddev_pop(b.value) > 1e-9 THEN corr(a.value, b.value) END AS r FROM frames a JOIN frames b ON a.subject = b.subject AND a.run = b.run AND a.frame = b.frame AND a.roi < b.roi GROUP BY ALL)"


def _weights(i):
    return i.voxels.where("condition = 0").groupBy("voxel").agg(F.avg("value").alias("weight"))


def _frames_time(i):
    return i.trials.select("subject", "run", F.col("onset").alias("time"), F.col("predictor").alias("value"))


def _matrix(i):
    """The features of a trial side by side, the price as target: one row a trial leaves the first grouping, where a pivot sends all."""
    of = lambda c: F.max(F.when(F.col("feature") == c, F.col("value")))
    return i.features.groupBy("subject", "trial_id").agg(*(of(c).alias(c) for c in ("quantity", "discount", "tax")), of("price").alias("target"))


def _concordance(i):
    """Run means against run maxima of the regions."""
    side = lambda f: i.frames.groupBy("subject", "run", "roi").agg(f("value").alias("value"))
    return _round(im.concordance(side(F.avg), side(F.max), ["subject", "run"], "roi", "value"), "r", keep=("roi", "n"))


def _forest(i):
    p = op.forest(i.wide, ["quantity", "discount", "tax"], "price", F.col("subject") % 4 > 0)
    return _round(op.regression_errors(p, ["condition"], "price", "prediction"), "r2", keep=("condition", "n"), digits=2)


def _logistic(i):
    p = op.balanced_logistic(i.wide.withColumn("y", (F.col("price") > 40000).cast("int")), ["quantity", "discount", "tax"], "y", F.col("subject") % 4 > 0)
    return _round(op.classification_metrics(p, ["condition"], "y", "p"), "auc", "balanced", keep=("condition",), digits=3)


def _shuffled(i):
    t = i.trials.select("subject", "run", "trial_id", "outcome")
    return stats.permuted(t, ["subject", "run"], "trial_id", "outcome", 1, 7).select("subject", "run", "trial_id", "permuted")


QUERIES = {
    "m18_majority": (lambda i: op.held_out_majority(i.trials, "subject", "condition"), sql("trials", ", f AS (SELECT DISTINCT subject FROM trials), o AS (SELECT subject, condition, count(*) AS n FROM trials GROUP BY ALL), a AS (SELECT condition, sum(n) AS n FROM o GROUP BY condition), g AS (SELECT f.subject, a.condition, (a.n - coalesce(o.n, 0))::BIGINT AS n FROM f CROSS JOIN a LEFT JOIN o ON o.subject = f.subject AND o.condition = a.condition) SELECT subject, condition AS prediction, n AS support FROM g QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, condition) = 1")),
    "m6_prepared_features": (lambda i: op.prepared(i.features.withColumn("value", F.when(F.col("value") != 0.05, F.col("value"))), "feature", "value", F.col("subject") % 4 > 0, 0.001).select("subject", "trial_id", "feature", rounded("prepared").alias("prepared")), sql("features", f", x AS (SELECT subject, trial_id, feature, CASE WHEN value <> 0.05 THEN value END AS v FROM features), s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE subject % 4 > 0 GROUP BY feature HAVING var_pop(v) > 0.001) SELECT subject, trial_id, feature, {r('(coalesce(v, m) - m) / s')} AS prepared FROM x JOIN s USING (feature)")),
    "i1_scrub": (lambda i: im.scrub(i.wide, ["subject", "run"], (F.col("tax") >= 0.07) | (F.col("discount") >= 0.09)).groupBy("subject", "run").agg(F.max("n_kept").alias("n_kept")), sql("wide", "SELECT subject, run, count(*) AS n_kept FROM wide WHERE tax < 0.07 AND discount < 0.09 GROUP BY ALL")),
    "i2_region_correlation": (lambda i: _round(im.region_correlation(i.frames, ["subject", "run"]).where("n > 5"), "r", keep=("subject", "run", "a", "b", "n")), sql("frames", CORR + f" SELECT subject, run, a, b, n, {r('r')} AS r FROM c WHERE n > 5")),
    "i3_average_runs": (lambda i: _round(im.average_runs(im.region_correlation(i.frames, ["subject", "run"]).where("n > 5"), ["subject"]), "r", keep=("subject", "a", "b")), sql("frames", CORR + f" SELECT subject, a, b, {r('tanh(sum(n * atanh(greatest(-0.999999, least(0.999999, r)))) FILTER (r IS NOT NULL) / sum(n) FILTER (r IS NOT NULL))')} AS r FROM c WHERE n > 5 GROUP BY ALL")),
    "i4_pattern_expression": (lambda i: _round(im.pattern_expression(i.voxels, _weights(i), ["trial_id"]), "dot", "cosine", "r", keep=("trial_id", "n_voxels")), sql("voxels", f", w AS (SELECT voxel, avg(value) AS weight FROM voxels WHERE condition = 0 GROUP BY voxel) SELECT trial_id, count(*) AS n_voxels, {r('sum(value * weight)')} AS dot, {r('sum(value * weight) / sqrt(sum(value * value) * sum(weight * weight))')} AS cosine, {r('corr(value, weight)')} AS r FROM voxels JOIN w USING (voxel) GROUP BY trial_id")),
    "i5_second_level": (lambda i: _round(im.one_sample(i.voxels, ["condition", "voxel"]), "mean", "t", keep=("condition", "voxel", "n")), sql("voxels", f"SELECT condition, voxel, count(*) AS n, {r('avg(value)')} AS mean, {r('avg(value) * sqrt(count(*)) / stddev_samp(value)')} AS t FROM voxels GROUP BY ALL")),
    "i6_repeated_measures": (lambda i: _round(im.repeated_measures(i.voxels.withColumn("condition", F.col("condition") % 3).groupBy("voxel", "subject", "condition").agg(F.avg("value").alias("value")), ["voxel"], "subject", "condition", "value"), "f", keep=("voxel", "dof1", "dof2")), sql("voxels", f", c AS (SELECT voxel, subject, condition % 3 AS condition, avg(value) AS v FROM voxels GROUP BY ALL), d AS (SELECT * FROM c WHERE (voxel, subject) IN (SELECT (voxel, subject) FROM c GROUP BY voxel, subject HAVING count(*) = 3)), g AS (SELECT voxel, avg(v) AS g, count(DISTINCT subject) AS n FROM d GROUP BY voxel), u AS (SELECT voxel, 3 * sum(power(m - g, 2)) AS s FROM (SELECT voxel, subject, avg(v) AS m FROM d GROUP BY ALL) JOIN g USING (voxel) GROUP BY voxel), k AS (SELECT voxel, any_value(n) * sum(power(m - g, 2)) AS s FROM (SELECT voxel, condition, avg(v) AS m FROM d GROUP BY ALL) JOIN g USING (voxel) GROUP BY voxel), t AS (SELECT voxel, sum(power(v - g, 2)) AS s FROM d JOIN g USING (voxel) GROUP BY voxel) SELECT voxel, 2 AS dof1, 2 * (n - 1) AS dof2, {r('(k.s / 2) / ((t.s - u.s - k.s) / (2 * (n - 1)))')} AS f FROM g JOIN u USING (voxel) JOIN k USING (voxel) JOIN t USING (voxel)")),
    "i7_max_statistic": (lambda i: _round(im.max_statistic(i.voxels.groupBy("subject", "voxel").agg(F.avg("value").alias("value")), "subject", 30), "t", "p", keep=("voxel",)), sql("voxels", f", v AS (SELECT subject, voxel, avg(value) AS value FROM voxels GROUP BY ALL), s AS (SELECT subject, perm, CASE WHEN perm = 0 THEN 1 ELSE 1 - 2 * (('0x' || substr(md5('1|' || perm || '|' || subject), 1, 8))::BIGINT % 2) END AS sgn FROM (SELECT DISTINCT subject FROM v), (SELECT unnest(range(31)) AS perm)), t AS (SELECT perm, voxel, avg(value * sgn) * sqrt(count(*)) / stddev_samp(value * sgn) AS t FROM v JOIN s USING (subject) GROUP BY ALL), m AS (SELECT perm, max(abs(t)) AS top FROM t WHERE perm > 0 GROUP BY perm) SELECT voxel, {r('t')} AS t, {r('(count(*) FILTER (top >= abs(t)) + 1) / (count(*) + 1)')} AS p FROM t, m WHERE t.perm = 0 GROUP BY voxel, t")),
    "i8_design_qc": (lambda i: _round(im.region_correlation(i.frames.where("roi <> 'tax'"), ["subject", "run"]).groupBy("subject", "run").agg(F.max(F.abs("r")).alias("max_r")), "max_r", keep=("subject", "run")), sql("frames", CORR + f" SELECT subject, run, {r('max(abs(r))')} AS max_r FROM c WHERE a <> 'tax' AND b <> 'tax' GROUP BY ALL")),
    "i9_outlier_share": (lambda i: _round(im.outlier_share(i.features, ["subject", "feature"], "value", 2.0), "outlier_share", keep=("subject", "feature", "n")), sql("features", f", m AS (SELECT *, median(value) OVER (PARTITION BY subject, feature) AS m FROM features), d AS (SELECT *, abs(value - m) AS d, 1.4826 * median(abs(value - m)) OVER (PARTITION BY subject, feature) AS s FROM m) SELECT subject, feature, count(*) AS n, {r('avg(CASE WHEN s > 0 AND d > 2.0 * s THEN 1.0 ELSE 0.0 END)')} AS outlier_share FROM d GROUP BY ALL")),
    "i11_convolved_confound": (lambda i: _round(im.convolved(i.trials.select("subject", "run", "trial_id", "onset"), _frames_time(i), ["subject", "run"], 90000.0), "value", keep=("subject", "run", "trial_id", "n_frames")), sql("trials", f", n AS (SELECT a.subject, a.run, a.trial_id, b.predictor AS v, 1 - abs(2 * (b.onset - a.onset) / 90000.0 - 1) AS w FROM trials a JOIN trials b ON a.subject = b.subject AND a.run = b.run AND b.onset >= a.onset AND b.onset < a.onset + 90000) SELECT subject, run, trial_id, {r('sum(w * v) / nullif(sum(w), 0)')} AS value, count(*) AS n_frames FROM n GROUP BY ALL")),
    "i12_trial_censoring": (lambda i: im.trial_censoring(i.trials, {"slow": F.col("outcome") > 150, "weak": F.col("predictor") < 5}).groupBy("subject").agg(F.count_if("slow").alias("slow"), F.count_if("weak").alias("weak"), F.count_if("kept").alias("kept")), sql("trials", "SELECT subject, count(*) FILTER (outcome > 150) AS slow, count(*) FILTER (predictor < 5) AS weak, count(*) FILTER (outcome <= 150 AND predictor >= 5) AS kept FROM trials GROUP BY subject")),
    "i14_shuffle_within_run": (_shuffled, sql("trials", ", k AS (SELECT subject, run, trial_id, outcome, row_number() OVER (PARTITION BY subject, run ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, run ORDER BY md5('7|0|' || trial_id), trial_id) AS drawn FROM trials) SELECT a.subject, a.run, a.trial_id, b.outcome AS permuted FROM k a JOIN k b ON a.subject = b.subject AND a.run = b.run AND a.place = b.drawn")),
    "i17_concordance": (_concordance, sql("frames", f", s AS (SELECT subject, run, roi, avg(value) AS a, max(value) AS b FROM frames GROUP BY ALL) SELECT roi, count(*) AS n, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN {r('corr(a, b)')} END AS r FROM s GROUP BY roi")),
    "i19_group_statuses": (lambda i: _round(stats.holm(i.trials.groupBy("condition").agg((F.avg("outcome") / 5000).alias("p")).withColumn("all", F.lit(1)), "p", ["all"], ["condition"]).withColumn("status", F.when(F.col("p_holm") < 0.05, "supported").otherwise("not supported")), "p_holm", keep=("condition", "status")), sql("trials", f", p AS (SELECT condition, avg(outcome) / 5000 AS p FROM trials GROUP BY condition), k AS (SELECT *, row_number() OVER (ORDER BY p, condition) AS k, count(*) OVER () AS m FROM p), h AS (SELECT condition, max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING) AS h FROM k) SELECT condition, {r('h')} AS p_holm, CASE WHEN h < 0.05 THEN 'supported' ELSE 'not supported' END AS status FROM h")),
    "i20_temporal_snr": (lambda i: _round(im.temporal_snr(i.frames, ["subject", "roi"], "run", "value"), "tsnr", keep=("subject", "roi")), sql("frames", f", s AS (SELECT subject, roi, run, coalesce(avg(value) / nullif(stddev_pop(value), 0), 0) AS s FROM frames GROUP BY ALL) SELECT subject, roi, {r('avg(s)')} AS tsnr FROM s GROUP BY ALL")),
    "m1_design_matrix": (_matrix, sql("wide", "SELECT subject, trial_id, quantity, discount, tax, price AS target FROM wide")),
    "m2_channel_means": (lambda i: i.samples.groupBy("trial_id").pivot("channel", list(range(8))).agg(F.avg("x")).select("trial_id", *(rounded(F.col(f"`{k}`")).alias(f"ch{k}") for k in range(8))), sql("samples", "SELECT trial_id, " + ", ".join(f"{r(f'avg(x) FILTER (channel = {k})')} AS ch{k}" for k in range(8)) + " FROM samples GROUP BY trial_id")),
    "m3_loso_folds": (lambda i: i.trials.groupBy("subject").agg(F.count(F.lit(1)).alias("n_test")).withColumn("n_train", F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")), sql("trials", "SELECT subject, count(*) AS n_test, (SELECT count(*) FROM trials) - count(*) AS n_train FROM trials GROUP BY subject")),
    "m4_block_folds": (lambda i: op.block_folds(i.trials, "subject", "run", 2).groupBy("subject", "fold").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT subject, ((dense_rank - 1) % 2)::INT AS fold, count(*) AS n FROM (SELECT subject, dense_rank() OVER (PARTITION BY subject ORDER BY run) AS dense_rank FROM trials) GROUP BY ALL")),
    "m4_ordered_folds": (lambda i: op.ordered_folds(i.trials, "subject", "run").groupBy("subject", "test_block").agg(F.count(F.lit(1)).alias("n_train")), sql("trials", ", d AS (SELECT subject, dense_rank() OVER (PARTITION BY subject ORDER BY run) - 1 AS b FROM trials), t AS (SELECT DISTINCT subject, b AS test_block FROM d WHERE b > 0) SELECT subject, test_block::INT AS test_block, count(*) AS n_train FROM d JOIN t USING (subject) WHERE b < test_block GROUP BY ALL")),
    "m5_feature_intersection": (lambda i: op.feature_intersection(i.features.withColumn("value", F.when((F.col("feature") != "tax") | (F.col("subject") % 7 > 0), F.col("value"))), "subject", "feature", "value", F.col("subject") % 5 == 0), sql("features", ", t AS (SELECT subject, feature FROM features WHERE subject % 5 <> 0 AND (feature <> 'tax' OR subject % 7 > 0)) SELECT feature, count(DISTINCT subject) AS n FROM t GROUP BY feature HAVING count(DISTINCT subject) = (SELECT count(DISTINCT subject) FROM features WHERE subject % 5 <> 0)")),
    "m8_deconfound": (lambda i: _round(op.deconfound(i.wide, ["condition"], "price", "quantity", F.col("subject") % 4 > 0), "residual", keep=("subject", "trial_id"), digits=2), sql("wide", f", f AS (SELECT condition, regr_slope(price, quantity) AS b, regr_intercept(price, quantity) AS a FROM wide WHERE subject % 4 > 0 GROUP BY condition) SELECT subject, trial_id, {r('price - a - b * quantity', 2)} AS residual FROM wide JOIN f USING (condition)")),
    "m6_principal_components": (lambda i: op.principal_components(i.wide, ["quantity", "price"], F.col("subject") % 4 > 0, 2).select("subject", "trial_id", rounded(F.abs("pc1"), 5).alias("pc1"), rounded(F.abs("pc2"), 5).alias("pc2")), sql("wide", f", s AS (SELECT avg(quantity) AS mq, stddev_samp(quantity) AS sq, avg(price) AS mp, stddev_samp(price) AS sp, CASE WHEN corr(quantity, price) < 0 THEN -1 ELSE 1 END AS d FROM wide WHERE subject % 4 > 0), z AS (SELECT subject, trial_id, (quantity - mq) / sq AS q, d * (price - mp) / sp AS p FROM wide, s) SELECT subject, trial_id, {r('abs(q + p) / sqrt(2)', 5)} AS pc1, {r('abs(q - p) / sqrt(2)', 5)} AS pc2 FROM z")),
    "m6_best_features": (lambda i: op.best_features(i.features.where("feature <> 'price'").join(i.wide.select("subject", "trial_id", "price"), ["subject", "trial_id"]), "feature", "value", "price", F.col("subject") % 4 > 0, 50.0).select("subject", "trial_id", "feature", rounded("value").alias("value")), sql("features", f", f AS (SELECT a.*, b.price FROM features a JOIN wide b USING (subject, trial_id) WHERE feature <> 'price'), q AS (SELECT feature, power(corr(value, price), 2) AS r2 FROM f WHERE subject % 4 > 0 GROUP BY feature) SELECT subject, trial_id, feature, {r('value')} AS value FROM f WHERE feature IN (SELECT feature FROM q WHERE r2 > (SELECT quantile_cont(r2, 0.5) FROM q))")),
    "m10_forest": (_forest, None),
    "m11_balanced_logistic": (_logistic, None),
    "m13_undersample": (lambda i: op.undersample(i.trials, ["run"], "condition", ["subject", "trial_id"]).select("run", "condition", "subject", "trial_id"), sql("trials", ", n AS (SELECT run, min(n) AS n FROM (SELECT run, condition, count(*) AS n FROM trials GROUP BY ALL) GROUP BY run), k AS (SELECT *, row_number() OVER (PARTITION BY run, condition ORDER BY md5('1|' || subject || '|' || trial_id), subject, trial_id) AS k FROM trials) SELECT run, condition, subject, trial_id FROM k JOIN n USING (run) WHERE k <= n")),
    "m15_subject_level_r": (lambda i: _round(op.subject_level_r(_scored(i), "subject", "outcome", "guess"), "r", "low", "high", keep=("n_subjects",)), sql("trials", SCORED + f", c AS (SELECT subject, atanh(greatest(-0.999999, least(0.999999, corr(outcome, guess)))) AS z FROM g GROUP BY subject HAVING count(*) >= 3), s AS (SELECT count(*) AS n, avg(z) AS z, stddev_samp(z) / sqrt(count(*)) AS se FROM c) SELECT n AS n_subjects, {r('tanh(z)')} AS r, {r('tanh(z - 1.96 * se)')} AS low, {r('tanh(z + 1.96 * se)')} AS high FROM s")),
    "m16_regression_errors": (lambda i: _round(op.regression_errors(_scored(i), ["subject"], "outcome", "guess"), "mae", "rmse", "r2", keep=("subject", "n")), sql("trials", SCORED + f" SELECT subject, count(*) AS n, {r('avg(abs(outcome - guess))')} AS mae, {r('sqrt(avg(power(outcome - guess, 2)))')} AS rmse, {r('1 - sum(power(outcome - guess, 2)) / (var_pop(outcome) * count(*))')} AS r2 FROM g GROUP BY subject")),
    "m17_classification_metrics": (lambda i: _round(op.classification_metrics(_class(i), ["subject"], "y", "p"), "auc", "balanced", "f1", "brier", "ece", keep=("subject",)), sql("trials", f", s AS (SELECT subject, (outcome > 40)::INT AS y, (predictor + 0.5) / 101 AS p FROM trials), k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY p) + (count(*) OVER (PARTITION BY subject, p) - 1) / 2.0 AS r FROM s), a AS (SELECT subject, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, avg(power(p - y, 2)) AS brier FROM k GROUP BY subject), e AS (SELECT subject, sum(n * g) / sum(n) AS ece FROM (SELECT subject, least(9, floor(p * 10)) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS g FROM s GROUP BY ALL) GROUP BY subject) SELECT subject, {r('(rs - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auc, {r('(tp / n1 + tn / n0) / 2')} AS balanced, {r('2 * tp / (2 * tp + fp + n1 - tp)')} AS f1, {r('brier')} AS brier, {r('ece')} AS ece FROM a JOIN e USING (subject)")),
    "m18_baseline": (lambda i: _round(op.held_out_mean(i.trials, "subject", "outcome"), "prediction", keep=("subject",)), sql("trials", f"SELECT subject, {r('((SELECT sum(outcome) FROM trials) - sum(outcome)) / ((SELECT count(*) FROM trials) - count(*))')} AS prediction FROM trials GROUP BY subject")),
    "m23_linear_attribution": (lambda i: _round(op.linear_attribution(i.features, ["condition"], i.features.groupBy("feature").agg((1 / F.stddev_pop("value")).alias("coefficient")), "feature", "value"), "importance", keep=("condition", "feature")), sql("features", f", c AS (SELECT feature, 1 / stddev_pop(value) AS c FROM features GROUP BY feature), m AS (SELECT *, avg(value) OVER (PARTITION BY condition, feature) AS m FROM features) SELECT condition, feature, {r('avg(abs(c * (value - m)))')} AS importance FROM m JOIN c USING (feature) GROUP BY ALL")),
    "m24_split_conformal": (lambda i: _round(op.split_conformal(_scored(i), ["condition"], "outcome", "guess", F.col("trial_id") % 2 == 0, 0.1), "half_width", keep=("condition", "n")), sql("trials", SCORED + f", c AS (SELECT condition, abs(outcome - guess) AS e FROM g WHERE trial_id % 2 = 0), l AS (SELECT condition, count(*) AS n, list(e ORDER BY e) AS e, least(1.0, ceil((count(*) + 1) * 0.9) / count(*)) * (count(*) - 1) AS pos FROM c GROUP BY condition) SELECT condition, n::INT AS n, {r('e[floor(pos)::INT + 1] + (pos - floor(pos)) * (coalesce(e[floor(pos)::INT + 2], e[floor(pos)::INT + 1]) - e[floor(pos)::INT + 1])')} AS half_width FROM l")),
}
