"""Queries of the further features, statistics, clusters and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extended as op
from ..operators import imaging as im
from ..operators import signal, stats
from ..operators import windows as win
from ..sources.tables import r, rounded, sql
from .signal import CROSS


def _round(df, *columns, keep=(), digits=6):
    return df.select(*keep, *(rounded(c, digits).alias(c) for c in columns))


def _cells(i):
    """Mean power of frequency x time cells against the condition."""
    return i.tfr.groupBy("subject", "freq", (F.col("t") * 8 + 2).cast("int").alias("k")).agg(F.avg("power").alias("power"), F.avg("condition").alias("target"))


def _r_grid(i):
    return op.windowed_correlation(_cells(i), ["freq", "k"], "target")


GRID = ", c AS (SELECT subject, freq, (t * 8 + 2)::INT AS k, avg(power) AS power, avg(condition) AS target FROM tfr GROUP BY ALL), g AS (SELECT freq, k, count(*) AS n, corr(power, target) AS r FROM c GROUP BY ALL)"


def _points(i):
    return i.raw("supplier").select(F.col("s_suppkey").alias("channel"), (F.col("s_nationkey") % 5).cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))


def _votes(i):
    t = i.wide.withColumn("label", (F.col("price") > 40000).cast("int"))
    v = op.soft_vote(t, ["quantity", "discount", "tax"], "label", F.col("subject") % 4 > 0)
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("p_vote"), 2).alias("p_vote"))


STATES = ", s AS (SELECT subject, trial_id, least(floor(outcome / 40), 2)::INT AS state FROM trials)"


def _state_rows(i):
    return i.trials.withColumn("state", F.least(F.floor(F.col("outcome") / 40), F.lit(2)).cast("int"))


def _states(i):
    return _round(op.state_metrics(_state_rows(i), ["subject"], "trial_id", "state"), "coverage", "dwell", keep=("subject", "state", "visits"))


def _kmeans(i):
    wide = i.samples.groupBy("trial_id", "t").pivot("channel", list(range(8))).agg(F.first("x"))
    s = op.cluster_states(wide, [str(k) for k in range(8)], 3)
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _window_states(i):
    w = signal.phase_connectivity(i.analytic.withColumn("w", F.floor(F.col("t") / 4).cast("int")), ["subject", "trial_id", "w"])
    edges = w.select("subject", "trial_id", "w", F.concat("a", F.lit("_"), "b").alias("edge"), "wpli")
    s = op.connectivity_states(edges, ["subject"], ["trial_id", "w"], "edge", [f"{a}_{b}" for a in range(4) for b in range(a + 1, 4)], "wpli", 3)
    return _round(op.state_switching(s, ["subject"], "place", "state"), "switching", "entropy", keep=("subject", "n"))


def _cv(i):
    t = i.trials.select(F.concat_ws("-", "subject", "trial_id").alias("row"), (F.col("trial_id") % 4).alias("fold"), F.col("predictor").alias("prediction"), F.abs(F.col("outcome") - F.col("predictor")).alias("residual"))
    return _round(op.cv_plus(t.select("row", "fold", "prediction"), t.select("fold", "residual"), 0.1), "low", "high", keep=("row",))


QUERIES = {
    "f29_phase_slope": (lambda i: _round(op.phase_slope(i.analytic, ["trial_id"], "t", 0, 1), "psi", keep=("trial_id",)), sql("analytic", CROSS + f", q AS (SELECT trial_id, t, re / sqrt(pa * pb) AS cr, im / sqrt(pa * pb) AS ci FROM p WHERE a = 0 AND b = 1), z AS (SELECT trial_id, cr * lead(ci) OVER w - ci * lead(cr) OVER w AS z FROM q WINDOW w AS (PARTITION BY trial_id ORDER BY t)) SELECT trial_id, {r('sum(z)')} AS psi FROM z GROUP BY trial_id")),
    "f31_global_efficiency": (lambda i: _round(op.global_efficiency(signal.phase_connectivity(i.analytic, ["trial_id"]).select("trial_id", "a", "b", F.col("plv").alias("w")), "trial_id", 4), "efficiency", keep=("trial_id",)), None),
    "f31_clustering": (lambda i: _round(op.graph_clustering(signal.phase_connectivity(i.analytic, ["trial_id"]).where("round(plv, 9) >= 0.2"), "trial_id", 4), "clustering", keep=("trial_id",)), sql("analytic", CROSS + f", w AS (SELECT trial_id, a, b, round(sqrt(power(avg(re / sqrt(re * re + im * im)), 2) + power(avg(im / sqrt(re * re + im * im)), 2)), 9) AS plv FROM p GROUP BY ALL), e AS (SELECT trial_id, a, b FROM w WHERE plv >= 0.2), d AS (SELECT trial_id, a, b FROM e UNION ALL SELECT trial_id, b, a FROM e), k AS (SELECT trial_id, a, count(*) AS k FROM d GROUP BY ALL), t AS (SELECT x.trial_id, x.a, count(*) AS n FROM d x JOIN d y ON x.trial_id = y.trial_id AND x.a = y.a AND x.b < y.b JOIN e ON e.trial_id = x.trial_id AND e.a = x.b AND e.b = y.b GROUP BY ALL) SELECT trial_id, {r('sum(coalesce(2.0 * n / (k * (k - 1)), 0)) / 4')} AS clustering FROM k LEFT JOIN t USING (trial_id, a) GROUP BY trial_id")),
    "f41_condition_contrast": (lambda i: _round(stats.two_groups(i.samples.where("t >= 0").groupBy("trial_id", "channel", "condition").agg(F.avg("x").alias("x")), ["channel"], "x", F.col("condition") == 0, F.col("condition") == 1), "d", "t", keep=("channel", "na", "nb")), sql("samples", f", m AS (SELECT trial_id, channel, condition, avg(x) AS x FROM samples WHERE t >= 0 GROUP BY ALL), s AS (SELECT channel, count(*) FILTER (condition = 0) AS na, count(*) FILTER (condition = 1) AS nb, avg(x) FILTER (condition = 0) AS ma, avg(x) FILTER (condition = 1) AS mb, var_samp(x) FILTER (condition = 0) AS va, var_samp(x) FILTER (condition = 1) AS vb FROM m GROUP BY channel) SELECT channel, na, nb, {r('(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} AS d, {r('(ma - mb) / sqrt(va / na + vb / nb)')} AS t FROM s")),
    "f44_source_connectivity": (lambda i: _round(signal.envelope_correlation(i.analytic.withColumn("channel", F.concat(F.lit("roi"), "channel")), ["subject", "trial_id"]), "aec", keep=("trial_id", "a", "b")), sql("analytic", CROSS + f" SELECT trial_id, 'roi' || a AS a, 'roi' || b AS b, {r('atanh(greatest(-0.999999, least(0.999999, corr(sqrt(pa), sqrt(pb)))))')} AS aec FROM p GROUP BY ALL")),
    "f27_state_metrics": (_states, sql("trials", f", s AS (SELECT subject, trial_id, least(floor(outcome / 40), 2)::INT AS state FROM trials), g AS (SELECT *, trial_id - row_number() OVER (PARTITION BY subject, state ORDER BY trial_id) AS g FROM s), i AS (SELECT subject, state, g, count(*) AS n FROM g GROUP BY ALL) SELECT subject, state, count(*) AS visits, {r('sum(n) / any_value(t)')} AS coverage, {r('avg(n)')} AS dwell FROM i JOIN (SELECT subject, count(*) AS t FROM s GROUP BY subject) USING (subject) GROUP BY subject, state")),
    "f27_switching": (lambda i: _round(op.state_switching(_state_rows(i), ["subject"], "trial_id", "state"), "switching", "entropy", keep=("subject", "n")), sql("trials", STATES + f", l AS (SELECT subject, state, lag(state) OVER (PARTITION BY subject ORDER BY trial_id) AS was FROM s), e AS (SELECT subject, -sum(p * ln(p)) AS e FROM (SELECT subject, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS p FROM s GROUP BY subject, state) GROUP BY subject) SELECT subject, count(*) AS n, {r('count(*) FILTER (was <> state) / nullif(count(*) - 1, 0)')} AS switching, {r('any_value(e)')} AS entropy FROM l JOIN e USING (subject) GROUP BY subject")),
    "f27_connectivity_states": (_window_states, None),
    "f39_transitions": (lambda i: _round(op.state_transitions(_state_rows(i), ["subject"], "trial_id", "state"), "share", keep=("subject", "from_state", "to_state", "n")), sql("trials", STATES + f", l AS (SELECT subject, state, lead(state) OVER (PARTITION BY subject ORDER BY trial_id) AS nx FROM s), c AS (SELECT subject, state AS from_state, nx AS to_state, count(*) AS n FROM l WHERE nx <> state GROUP BY ALL) SELECT subject, from_state, to_state, n, {r('n / sum(n) OVER (PARTITION BY subject, from_state)')} AS share FROM c")),
    "f38_sharpness": (lambda i: _round(op.sharpness_ratio(i.dims, ["trial_id"], "dim", "x", 2), "sharpness", keep=("trial_id", "n")), sql("dims", f", b AS (SELECT trial_id, x, lag(x) OVER w AS p, lead(x) OVER w AS q, abs(x - lag(x, 2) OVER w) + abs(x - lead(x, 2) OVER w) AS sh FROM dims WINDOW w AS (PARTITION BY trial_id ORDER BY dim)) SELECT trial_id, count(*) AS n, {r('ln(avg(sh) FILTER (x > p AND x > q) / avg(sh) FILTER (x < p AND x < q))')} AS sharpness FROM b GROUP BY trial_id")),
    "f39_cluster_states": (_kmeans, None),
    "c12_spline_basis": (lambda i: _round(op.spline_basis(i.trials.select("subject", "trial_id", "predictor"), "predictor"), "curve", keep=("subject", "trial_id")), sql("trials", f", k AS (SELECT quantile_cont(predictor, 0.1) AS a, quantile_cont(predictor, 0.5) AS b, quantile_cont(predictor, 0.9) AS c FROM trials) SELECT subject, trial_id, {r('(power(greatest(predictor - a, 0), 3) - power(greatest(predictor - b, 0), 3) * (c - a) / (c - b) + power(greatest(predictor - c, 0), 3) * (b - a) / (c - b)) / power(c - a, 2)')} AS curve FROM trials, k")),
    "c14_crossfit_residual": (lambda i: _round(op.crossfit_residual(i.trials, "run", "predictor", "outcome"), "residual", keep=("subject", "trial_id")), sql("trials", f", f AS (SELECT s.run, regr_slope(t.outcome, t.predictor) AS b, regr_intercept(t.outcome, t.predictor) AS a FROM (SELECT DISTINCT run FROM trials) s JOIN trials t ON t.run <> s.run GROUP BY s.run) SELECT subject, trial_id, {r('outcome - a - b * predictor')} AS residual FROM trials JOIN f USING (run)")),
    "c17_feature_reliability": (lambda i: i.features.groupBy("feature", "subject").agg(F.avg(F.when(F.col("run") <= 3, F.col("value"))).alias("a"), F.avg(F.when(F.col("run") > 3, F.col("value"))).alias("b")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), rounded(win.moment_corr(F.col("a"), F.col("b"))).alias("r")), sql("features", f", c AS (SELECT feature, subject, avg(value) FILTER (run <= 3) AS a, avg(value) FILTER (run > 3) AS b FROM features GROUP BY ALL) SELECT feature, count(*) AS n, {r('corr(a, b)')} AS r FROM c GROUP BY feature")),
    "c19_temporal_correlation": (lambda i: _round(_r_grid(i), "r", keep=("freq", "k", "n")), sql("tfr", GRID + f" SELECT freq, k, n, {r('r')} AS r FROM g")),
    "c20_residual_rank": (lambda i: _round(op.partial_rank(i.trials, ["subject"], "predictor", "outcome", "onset"), "r", keep=("subject", "n")), sql("trials", f", k AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY predictor) + (count(*) OVER (PARTITION BY subject, predictor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY subject ORDER BY outcome) + (count(*) OVER (PARTITION BY subject, outcome) - 1) / 2.0 AS y, rank() OVER (PARTITION BY subject ORDER BY onset) + (count(*) OVER (PARTITION BY subject, onset) - 1) / 2.0 AS z FROM trials), c AS (SELECT subject, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM k GROUP BY subject) SELECT subject, n, {r('(xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))')} AS r FROM c")),
    "c24_aperiodic_residuals": (lambda i: _round(signal.residual_spectrum(i.psd, ["trial_id"]), "residual", keep=("trial_id", "freq")), sql("psd", f", l AS (SELECT trial_id, freq, log10(freq) AS lf, log10(power) AS lp FROM psd WHERE power > 0), f AS (SELECT trial_id, regr_slope(lp, lf) AS b, regr_intercept(lp, lf) AS a FROM l GROUP BY trial_id) SELECT trial_id, freq, {r('lp - a - b * lf')} AS residual FROM l JOIN f USING (trial_id)")),
    "e4_bootstrap_d": (lambda i: _round(op.bootstrap_d(i.trials.select("subject", "trial_id", "condition", "outcome"), ["subject"], "trial_id", "outcome", F.col("condition") == "click", F.col("condition") == "view", 20), "low", "high", keep=("subject",)), None),
    "e6_primary_p": (lambda i: op.primary_p(i.trials.select("subject", "trial_id", (F.col("outcome") / 500).alias("p_raw"), F.when(F.col("trial_id") % 2 == 0, F.col("predictor") / 100).alias("p_perm")), "perm_if_available").select("subject", "trial_id", rounded("p_primary").alias("p_primary"), "reportable"), sql("trials", f"SELECT subject, trial_id, {r('CASE WHEN trial_id % 2 = 0 THEN predictor / 100 ELSE outcome / 500 END')} AS p_primary, CASE WHEN trial_id % 2 = 0 THEN predictor / 100 ELSE outcome / 500 END < 0.05 AS reportable FROM trials")),
    "e7_region_change": (lambda i: _round(win.change_scores(win.time_mask(i.samples.withColumn("p", F.col("x") * F.col("x")), win.segments(i.spark, [("base", -0.25, 0.0), ("act", 0.0, 0.75)])), ["subject", "channel"], "segment", "p", "base", "act"), "pct_change", keep=("subject", "channel"), digits=4), sql("samples", f", m AS (SELECT subject, channel, avg(x * x) FILTER (t < 0) AS b, avg(x * x) FILTER (t >= 0) AS a FROM samples GROUP BY ALL) SELECT subject, channel, {r('100 * (a - b) / b', 4)} AS pct_change FROM m")),
    "k1_clusters_1d": (lambda i: _round(op.clusters_1d(_r_grid(i).withColumn("r", F.round("r", 9)), ["freq"], "k", "r", 0.1), "mass", keep=("freq", "first", "last", "n")), sql("tfr", GRID + f", s AS (SELECT freq, k, round(r, 9) AS r, CASE WHEN abs(round(r, 9)) > 0.1 THEN sign(r) ELSE 0 END AS s FROM g), i AS (SELECT *, k - row_number() OVER (PARTITION BY freq, s ORDER BY k) AS isl FROM s WHERE s <> 0) SELECT freq, min(k) AS \"first\", max(k) AS \"last\", count(*) AS n, {r('sum(abs(r))')} AS mass FROM i GROUP BY freq, s, isl")),
    "k4_distance_adjacency": (lambda i: _round(op.distance_adjacency(_points(i), 1.2), "distance", keep=("channel", "other")), f"SELECT a.s_suppkey AS channel, b.s_suppkey AS other, {r('sqrt(power(a.s_nationkey % 5 - b.s_nationkey % 5, 2) + power(a.s_acctbal / 1000 - b.s_acctbal / 1000, 2))')} AS distance FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE sqrt(power(a.s_nationkey % 5 - b.s_nationkey % 5, 2) + power(a.s_acctbal / 1000 - b.s_acctbal / 1000, 2)) <= 1.2"),
    "m12_soft_vote": (_votes, None),
    "m25_cv_plus": (_cv, sql("trials", f", t AS (SELECT subject || '-' || trial_id AS row, trial_id % 4 AS fold, predictor AS p, abs(outcome - predictor) AS e FROM trials), s AS (SELECT a.row, list(a.p - b.e ORDER BY a.p - b.e) AS lo, list(a.p + b.e ORDER BY a.p + b.e) AS hi, count(*) AS n FROM t a JOIN t b ON a.fold = b.fold GROUP BY a.row) SELECT row, {r('lo[greatest(floor(0.1 * (n + 1))::INT, 1)]')} AS low, {r('hi[least(ceil(0.9 * (n + 1))::INT, n)]')} AS high FROM s")),
    "m28_yeo_johnson": (lambda i: _round(op.yeo_johnson(i.trials, "outcome", [0.5, 1.0, 1.5]), "llf", keep=("lam",), digits=3), sql("trials", f", e AS (SELECT l, (power(outcome + 1, l) - 1) / l AS t, ln(1 + outcome) AS g FROM trials, (VALUES (0.5::DOUBLE), (1.0), (1.5)) v(l)) SELECT l::DOUBLE AS lam, {r('-count(*) / 2 * ln(var_pop(t)) + (l - 1) * sum(g)', 3)} AS llf FROM e GROUP BY l")),
    "m28_transformed_target": (lambda i: op.yeo_johnson_transform(i.trials, "outcome", [0.5, 1.0, 1.5]).select("subject", "trial_id", "lam", rounded("transformed").alias("transformed")), sql("trials", f", e AS (SELECT l::DOUBLE AS l, (power(outcome + 1, l) - 1) / l AS t, ln(1 + outcome) AS g FROM trials, (VALUES (0.5::DOUBLE), (1.0), (1.5)) v(l)), b AS (SELECT arg_max(l, f) AS l FROM (SELECT l, -count(*) / 2 * ln(var_pop(t)) + (l - 1) * sum(g) AS f FROM e GROUP BY l)) SELECT subject, trial_id, l AS lam, {r('(power(outcome + 1, l) - 1) / l')} AS transformed FROM trials, b")),
    "i10_fail_summary": (lambda i: im.outlier_share(i.features, ["subject", "feature"], "value", 2.0).withColumn("failed", F.col("outlier_share") > 0.02).groupBy("subject").agg(F.count_if("failed").alias("n_failed"), F.count(F.lit(1)).alias("n")).withColumn("status", F.when(F.col("n_failed") > 0, "review").otherwise("ok")), sql("features", ", m AS (SELECT *, median(value) OVER (PARTITION BY subject, feature) AS m FROM features), d AS (SELECT *, abs(value - m) AS d, 1.4826 * median(abs(value - m)) OVER (PARTITION BY subject, feature) AS s FROM m), o AS (SELECT subject, feature, avg(CASE WHEN s > 0 AND d > 2.0 * s THEN 1.0 ELSE 0.0 END) AS o FROM d GROUP BY ALL) SELECT subject, count(*) FILTER (o > 0.02) AS n_failed, count(*) AS n, CASE WHEN count(*) FILTER (o > 0.02) > 0 THEN 'review' ELSE 'ok' END AS status FROM o GROUP BY subject")),
    "i13_artifact_burden": (lambda i: win.normalise(i.trials, "outcome", ["subject", "run"], "robust").groupBy("subject").agg(rounded(F.avg(F.greatest(F.coalesce("scaled", F.lit(0.0)), F.lit(0.0)))).alias("burden")), sql("trials", f", m AS (SELECT *, median(outcome) OVER (PARTITION BY subject, run) AS m FROM trials), z AS (SELECT subject, coalesce((outcome - m) / nullif(1.4826 * median(abs(outcome - m)) OVER (PARTITION BY subject, run), 0), 0) AS z FROM m) SELECT subject, {r('avg(greatest(z, 0))')} AS burden FROM z GROUP BY subject")),
    "i15_subset_factor": (lambda i: i.trials.where("outcome > 50").withColumn("level", F.floor(F.col("predictor") / 25).cast("int")).groupBy("subject").agg(F.countDistinct("level").alias("levels"), F.count(F.lit(1)).alias("n")).where("levels <= 6"), sql("trials", "SELECT subject, count(DISTINCT floor(predictor / 25)) AS levels, count(*) AS n FROM trials WHERE outcome > 50 GROUP BY subject HAVING count(DISTINCT floor(predictor / 25)) <= 6")),
}
