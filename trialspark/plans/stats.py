"""Queries of correlation, regression, group comparison, multiple testing and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as op
from ..operators.windows import moment_corr
from ..sources.tables import r, rounded, sql

T = "trials"
PER = "c AS (SELECT subject, count(*) AS n, corr(predictor, outcome) AS r FROM trials GROUP BY subject)"


def _per(i):
    return op.correlations(i.trials, ["subject"], "predictor", "outcome")


def _pvalues(i):
    # a p-like column in (0, 1) that repeats in both engines
    return i.trials.select("subject", "trial_id", "condition", ((F.col("predictor") + 1) / 102 * F.col("outcome") / 1000).alias("p"))


PV = ", p AS (SELECT subject, trial_id, condition, (predictor + 1) / 102 * outcome / 1000 AS p FROM trials)"
CENTRED = "k AS (SELECT *, outcome - median(outcome) OVER w AS cy, predictor - median(predictor) OVER w AS cx FROM trials WINDOW w AS (PARTITION BY subject)), d AS (SELECT *, median(abs(cx)) OVER w AS dx, median(abs(cy)) OVER w AS dy FROM k WINDOW w AS (PARTITION BY subject))"
BH = "least(1.0, min(p * m / k) OVER (PARTITION BY {k} ORDER BY p, subject, trial_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _perm_null(i):
    p = op.permuted(i.trials.select("subject", "trial_id", "predictor", "outcome"), ["subject"], "trial_id", "outcome", 20)
    return p.groupBy("subject", "perm").agg(moment_corr(F.col("predictor"), F.col("permuted")).alias("r"))


PERM = """, b AS (SELECT subject, trial_id, predictor, outcome, perm FROM trials, (SELECT unnest(range(20)) AS perm)),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM b),
    n AS (SELECT a.subject, a.perm, a.trial_id, a.predictor, s.outcome AS permuted, a.condition FROM (SELECT k.*, t.condition FROM k JOIN trials t USING (subject, trial_id)) a JOIN k s ON a.subject = s.subject AND a.perm = s.perm AND a.place = s.drawn)"""


def _difference(i):
    t = i.trials.select("subject", "trial_id", "condition", "outcome")
    side = lambda v: F.avg(F.when(F.col("condition") == "click", F.col(v))) - F.avg(F.when(F.col("condition") == "view", F.col(v)))
    null = op.permuted(t, ["subject"], "trial_id", "outcome", 20).groupBy("subject", "perm").agg(side("permuted").alias("stat"))
    return op.permutation_p(t.groupBy("subject").agg(side("outcome").alias("stat")), null, ["subject"], "stat").select("subject", rounded("observed").alias("observed"), "extreme", rounded("p").alias("p"))


def _effective(i):
    t = i.trials.select("subject", "run", "trial_id", "outcome")
    p = op.permuted(t, ["subject", "run"], "trial_id", "outcome", 5)
    return p.groupBy("subject", "perm").agg(rounded(F.avg((F.col("outcome") != F.col("permuted")).cast("double"))).alias("changed"))


def _boot(i):
    b = op.bootstrap_draws(i.trials.select("subject", "trial_id", "outcome"), ["subject"], "trial_id", 40)
    m = b.groupBy("subject", "boot").agg(F.avg("outcome").alias("m"))
    return m.groupBy("subject").agg(rounded(F.percentile("m", 0.025)).alias("low"), rounded(F.percentile("m", 0.975)).alias("high"))


BOOT = """, p AS (SELECT subject, trial_id, condition, predictor, outcome, row_number() OVER (PARTITION BY subject ORDER BY trial_id) - 1 AS place, count(*) OVER (PARTITION BY subject) AS size FROM trials),
    d AS (SELECT subject, boot, ('0x' || substr(md5('1|' || boot || '|' || place), 1, 8))::BIGINT % size AS place FROM p, (SELECT unnest(range(40)) AS boot)),
    b AS (SELECT d.subject, d.boot, p.outcome, p.predictor, p.condition FROM d JOIN p ON p.subject = d.subject AND p.place = d.place)"""


def _flip_units(i):
    return i.trials.groupBy("subject", "condition").agg((F.avg("outcome") - 49).alias("d"))


def _icc_cells(i):
    return i.wide.groupBy(F.concat_ws("-", "subject", "condition").alias("unit"), "run").agg(F.avg("quantity").alias("value"))


def _sides(i):
    # mean in tenths, halves up, from whole millionths: rounding a mean of doubles leaves its halves to the order of the sum
    def side(c):
        x = F.when(F.col("condition") == c, F.round(F.col("outcome") * 1e6).cast("long"))
        top, under = 2 * F.sum(x) + 100000 * F.count(x), 200000 * F.count(x)
        return F.when(F.count(x) > 0, ((top - F.pmod(top, under)) / under).cast("double"))

    return i.trials.groupBy("subject", "run").agg(side("click").alias("a"), side("view").alias("b"))


def _split_half(i):
    half = i.trials.withColumn("odd", F.row_number().over(Window.partitionBy("subject", "condition").orderBy("trial_id")) % 2)
    cells = half.groupBy("subject", "condition").agg(F.avg(F.when(F.col("odd") == 1, F.col("outcome"))).alias("a"), F.avg(F.when(F.col("odd") == 0, F.col("outcome"))).alias("b"))
    return cells.groupBy("condition").agg(moment_corr(F.col("a"), F.col("b")).alias("r")).select("condition", rounded("r").alias("r"), rounded(2 * F.col("r") / (1 + F.col("r"))).alias("corrected"))


QUERIES = {
    "c21_subject_beta": (lambda i: op.per_group_beta(i.trials, ["subject"], "predictor", "outcome", "onset").select("subject", "n", rounded("beta").alias("beta")), sql(T, f", s AS (SELECT subject, count(*) AS n, covar_pop(predictor, outcome) AS xy, covar_pop(predictor, onset) AS xz, covar_pop(outcome, onset) AS yz, var_pop(predictor) AS xx, var_pop(onset) AS zz FROM trials GROUP BY subject) SELECT subject, n, CASE WHEN n > 3 AND xx * zz - xz * xz > 1e-12 * xx * zz THEN {r('(xy * zz - xz * yz) / (xx * zz - xz * xz)')} END AS beta FROM s")),
    "r5_freedman_lane": (lambda i: op.freedman_lane(i.trials.select("subject", "trial_id", "predictor", "outcome", (F.col("onset") / 3600).alias("hours")), ["subject"], "trial_id", "predictor", "outcome", "hours", 20).select("subject", rounded("observed").alias("observed"), "n_perm", "extreme", rounded("p").alias("p")), sql(T, f""", d AS (SELECT subject, trial_id, predictor AS x, outcome AS y, onset / 3600 AS z FROM trials), f AS (SELECT subject, regr_slope(y, z) AS b, regr_intercept(y, z) AS a FROM d GROUP BY subject),
    e AS (SELECT d.*, a + b * z AS fit, y - a - b * z AS e, perm, row_number() OVER (PARTITION BY subject, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM d JOIN f USING (subject), (SELECT unnest(range(20)) AS perm)),
    n AS (SELECT a.subject, a.perm, a.x, a.z, a.fit + s.e AS y FROM e a JOIN e s ON a.subject = s.subject AND a.perm = s.perm AND a.place = s.drawn),
    c AS (SELECT subject, perm, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM n GROUP BY ALL UNION ALL SELECT subject, -1, corr(x, y), corr(x, z), corr(y, z) FROM d GROUP BY subject),
    p AS (SELECT subject, perm, (xy - xz * yz) / nullif(sqrt((1 - xz * xz) * (1 - yz * yz)), 0) AS r FROM c)
    SELECT a.subject, {r('any_value(o.r)')} AS observed, count(a.r) AS n_perm, count(*) FILTER (abs(a.r) >= abs(o.r) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(a.r) >= abs(o.r) - 1e-12) + 1) / (count(a.r) + 1)')} AS p FROM p a JOIN p o ON a.subject = o.subject AND o.perm = -1 WHERE a.perm >= 0 GROUP BY a.subject""")),
    "c1_pearson": (lambda i: _per(i).select("subject", "n", rounded("r").alias("r")), sql(T, f", {PER} SELECT subject, n, {r('r')} AS r FROM c")),
    "c1_spearman": (lambda i: op.correlations(i.trials, ["subject"], "predictor", "outcome", "spearman").select("subject", "n", rounded("r").alias("r")), sql(T, f", k AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY predictor) + (count(*) OVER (PARTITION BY subject, predictor) - 1) / 2.0 AS a, rank() OVER (PARTITION BY subject ORDER BY outcome) + (count(*) OVER (PARTITION BY subject, outcome) - 1) / 2.0 AS b FROM trials) SELECT subject, count(*) AS n, {r('corr(a, b)')} AS r FROM k GROUP BY subject")),
    "c2_winsorised": (lambda i: op.winsorised(i.trials, ["subject"], "predictor", "outcome").select("subject", "n", "effective_n", rounded("r").alias("r")), sql(T, f", k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY predictor) AS p, row_number() OVER (PARTITION BY subject ORDER BY outcome) AS q, count(*) OVER (PARTITION BY subject) AS n, floor(count(*) OVER (PARTITION BY subject) * 0.2)::INT AS k FROM trials), l AS (SELECT subject, min(predictor) FILTER (p > k) AS pl, max(predictor) FILTER (p <= n - k) AS ph, min(outcome) FILTER (q > k) AS ql, max(outcome) FILTER (q <= n - k) AS qh FROM k GROUP BY subject) SELECT subject, count(*) AS n, count(*) - 2 * any_value(k) AS effective_n, {r('corr(least(greatest(predictor, pl), ph), least(greatest(outcome, ql), qh))')} AS r FROM k JOIN l USING (subject) GROUP BY subject")),
    "c2_percentage_bend": (lambda i: op.percentage_bend(i.trials, ["subject"], "predictor", "outcome").select("subject", "n", rounded("r").alias("r")), sql(T, f", {CENTRED}, l AS (SELECT subject, quantile_cont(abs(cx / dx), 0.8) AS lx, quantile_cont(abs(cy / dy), 0.8) AS ly FROM d GROUP BY subject) SELECT subject, count(*) AS n, {r('corr(greatest(-lx, least(lx, cx / dx)), greatest(-ly, least(ly, cy / dy)))')} AS r FROM d JOIN l USING (subject) GROUP BY subject")),
    "c2_shepherd": (lambda i: op.shepherd(i.trials, ["subject"], "predictor", "outcome").select("subject", "n", rounded("r").alias("r")), sql(T, f", {CENTRED}, e AS (SELECT *, sqrt(power(cx / (1.4826 * dx), 2) + power(cy / (1.4826 * dy), 2)) AS far FROM d), q AS (SELECT subject, quantile_cont(far, 0.95) AS top FROM e GROUP BY subject), i AS (SELECT e.subject, predictor, outcome FROM e JOIN q USING (subject) WHERE far <= top), g AS (SELECT subject, rank() OVER (PARTITION BY subject ORDER BY predictor) + (count(*) OVER (PARTITION BY subject, predictor) - 1) / 2.0 AS a, rank() OVER (PARTITION BY subject ORDER BY outcome) + (count(*) OVER (PARTITION BY subject, outcome) - 1) / 2.0 AS b FROM i) SELECT subject, count(*) AS n, {r('corr(a, b)')} AS r FROM g GROUP BY subject")),
    "c4_partial_many": (lambda i: op.partial_many(i.trials.withColumn("place", F.col("trial_id").cast("double") % 7), ["subject"], "predictor", "outcome", ["onset", "place"]).select("subject", "n", "dof", rounded("r").alias("r"), rounded("t", 5).alias("t")), sql(T, f", e AS (SELECT *, trial_id % 7 AS w FROM trials), c AS (SELECT subject, count(*) AS n, corr(predictor, outcome) AS xy, corr(predictor, onset) AS xz, corr(outcome, onset) AS yz, corr(predictor, w) AS xw, corr(outcome, w) AS yw, corr(onset, w) AS zw FROM e GROUP BY subject), f AS (SELECT subject, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS xy, (xw - xz * zw) / sqrt((1 - xz * xz) * (1 - zw * zw)) AS xw, (yw - yz * zw) / sqrt((1 - yz * yz) * (1 - zw * zw)) AS yw FROM c), g AS (SELECT subject, n, (xy - xw * yw) / sqrt((1 - xw * xw) * (1 - yw * yw)) AS r FROM f) SELECT subject, n, n - 4 AS dof, {r('r')} AS r, {r('r * sqrt((n - 4) / (1 - r * r))', 5)} AS t FROM g")),
    "c3_fisher_interval": (lambda i: op.fisher_interval(_per(i)).select("subject", *(rounded(c).alias(c) for c in ("z", "se", "low", "high"))), sql(T, f", {PER}, z AS (SELECT subject, atanh(r) AS z, 1 / sqrt(n - 3.0) AS se FROM c) SELECT subject, {r('z')} AS z, {r('se')} AS se, {r('tanh(z - 1.959963984540054 * se)')} AS low, {r('tanh(z + 1.959963984540054 * se)')} AS high FROM z")),
    "c4_partial_one": (lambda i: op.partial_one(i.trials, ["subject"], "predictor", "outcome", "onset").select("subject", "n", rounded("r").alias("r"), "dof", rounded("t").alias("t")), sql(T, f", c AS (SELECT subject, count(*) AS n, corr(predictor, outcome) AS xy, corr(predictor, onset) AS xz, corr(outcome, onset) AS yz FROM trials GROUP BY subject), p AS (SELECT *, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c) SELECT subject, n, {r('r')} AS r, n - 3 AS dof, {r('r * sqrt((n - 3) / (1 - r * r))')} AS t FROM p")),
    "c5_collinearity": (lambda i: i.trials.agg(*(rounded(moment_corr(F.col(a), F.col(b))).alias(f"{a}_{b}") for a, b in (("predictor", "outcome"), ("predictor", "onset"), ("outcome", "onset")))), sql(T, f"SELECT {r('corr(predictor, outcome)')} AS predictor_outcome, {r('corr(predictor, onset)')} AS predictor_onset, {r('corr(outcome, onset)')} AS outcome_onset FROM trials")),
    "c6_loso_stability": (lambda i: op.leave_one_out(i.trials, "subject", "predictor", "outcome").select("subject", rounded("r").alias("r")), sql(T, f"SELECT s.subject, {r('corr(predictor, outcome)')} AS r FROM (SELECT DISTINCT subject FROM trials) s JOIN trials t ON t.subject <> s.subject GROUP BY s.subject")),
    "c8_bootstrap_r": (lambda i: op.bootstrap_draws(i.trials.select("subject", "trial_id", "predictor", "outcome"), ["subject"], "trial_id", 40).groupBy("subject", "boot").agg(moment_corr(F.col("predictor"), F.col("outcome")).alias("r")).groupBy("subject").agg(rounded(F.percentile("r", 0.025)).alias("low"), rounded(F.percentile("r", 0.975)).alias("high")), sql(T, BOOT + f", c AS (SELECT subject, boot, corr(predictor, outcome) AS r FROM b GROUP BY ALL) SELECT subject, {r('quantile_cont(r, 0.025)')} AS low, {r('quantile_cont(r, 0.975)')} AS high FROM c GROUP BY subject")),
    "c9_feature_correlations": (lambda i: op.correlations(i.features.join(i.wide.select("subject", "trial_id", F.col("price").alias("target")), ["subject", "trial_id"]).where("feature <> 'price'"), ["subject", "feature"], "value", "target").select("subject", "feature", "n", rounded("r").alias("r")), sql("features", f"SELECT f.subject, f.feature, count(*) AS n, {r('corr(f.value, w.price)')} AS r FROM features f JOIN wide w USING (subject, trial_id) WHERE f.feature <> 'price' GROUP BY f.subject, f.feature")),
    "c11_trialwise_regression": (lambda i: op.simple_regression(i.trials, ["subject"], "predictor", "outcome").select("subject", "n", *(rounded(c).alias(c) for c in ("slope", "intercept", "r2", "se"))), sql(T, f"SELECT subject, count(*) AS n, {r('regr_slope(outcome, predictor)')} AS slope, {r('regr_intercept(outcome, predictor)')} AS intercept, {r('regr_r2(outcome, predictor)')} AS r2, {r('sqrt((regr_syy(outcome, predictor) - regr_slope(outcome, predictor) * regr_sxy(outcome, predictor)) / (count(*) - 2) / regr_sxx(outcome, predictor))')} AS se FROM trials GROUP BY subject")),
    "c13_predictor_residual": (lambda i: i.trials.join(op.simple_regression(i.trials, ["subject"], "predictor", "outcome").select("subject", "slope", "intercept"), "subject").select("subject", "trial_id", rounded(F.col("outcome") - F.col("intercept") - F.col("slope") * F.col("predictor")).alias("residual")), sql(T, f", f AS (SELECT subject, regr_slope(outcome, predictor) AS b, regr_intercept(outcome, predictor) AS a FROM trials GROUP BY subject) SELECT subject, trial_id, {r('outcome - a - b * predictor')} AS residual FROM trials JOIN f USING (subject)")),
    "c15_icc": (lambda i: op.icc(_icc_cells(i), "unit", "run", "value", 7).select("n", *(rounded(c).alias(c) for c in ("icc11", "icc21", "icc31", "icc3k"))), sql("wide", f", c AS (SELECT subject || '-' || condition AS unit, run, avg(quantity) AS v FROM wide GROUP BY ALL), d AS (SELECT * FROM c WHERE unit IN (SELECT unit FROM c GROUP BY unit HAVING count(*) = 7)), g AS (SELECT avg(v) AS g, count(*) AS nn, count(DISTINCT unit) AS n FROM d), ur AS (SELECT 7 * sum((u - g) * (u - g)) AS ssr FROM (SELECT avg(v) AS u FROM d GROUP BY unit), g), cr AS (SELECT any_value(n) * sum((u - g) * (u - g)) AS ssc FROM (SELECT avg(v) AS u FROM d GROUP BY run), g), tt AS (SELECT sum((v - g) * (v - g)) AS sst FROM d, g), m AS (SELECT n, ssr / (n - 1) AS msr, ssc / 6 AS msc, (sst - ssr) / (n * 6) AS msw, (sst - ssr - ssc) / ((n - 1) * 6) AS mse FROM g, ur, cr, tt) SELECT n, {r('(msr - msw) / (msr + 6 * msw)')} AS icc11, {r('(msr - mse) / (msr + 6 * mse + 7 * (msc - mse) / n)')} AS icc21, {r('(msr - mse) / (msr + 6 * mse)')} AS icc31, {r('greatest(-1, least(1, (msr - mse) / msr))')} AS icc3k FROM m")),
    "c16_split_half": (_split_half, sql(T, f", h AS (SELECT *, row_number() OVER (PARTITION BY subject, condition ORDER BY trial_id) % 2 AS odd FROM trials), c AS (SELECT subject, condition, avg(outcome) FILTER (odd = 1) AS a, avg(outcome) FILTER (odd = 0) AS b FROM h GROUP BY ALL), q AS (SELECT condition, corr(a, b) AS r FROM c GROUP BY condition) SELECT condition, {r('r')} AS r, {r('2 * r / (1 + r)')} AS corrected FROM q")),
    "c18_group_correlation": (lambda i: op.group_correlation(_per(i).withColumn("all", F.lit("all")), ["all"]).select("n_subjects", rounded("r", 8).alias("r")), sql(T, f", {PER} SELECT count(r) AS n_subjects, {r('tanh(avg(atanh(greatest(-0.999999, least(0.999999, r)))))', 8)} AS r FROM c WHERE n >= 3 AND r IS NOT NULL")),
    "c22_fit_line": (lambda i: i.wide.groupBy("condition").agg(rounded(F.regr_slope("price", "quantity"), 4).alias("slope"), rounded(F.regr_intercept("price", "quantity"), 4).alias("intercept")), sql("wide", f"SELECT condition, {r('regr_slope(price, quantity)', 4)} AS slope, {r('regr_intercept(price, quantity)', 4)} AS intercept FROM wide GROUP BY condition")),
    "c23_loo_sign_flips": (lambda i: op.leave_one_out(i.trials, "run", "predictor", "outcome").select("run", rounded("r").alias("r"), (F.signum("r") < 0).alias("negative")), sql(T, f"SELECT s.run, {r('corr(predictor, outcome)')} AS r, corr(predictor, outcome) < 0 AS negative FROM (SELECT DISTINCT run FROM trials) s JOIN trials t ON t.run <> s.run GROUP BY s.run")),
    "e1_two_groups": (lambda i: op.two_groups(i.trials, ["subject"], "outcome", F.col("condition") == "click", F.col("condition") == "view").select("subject", "na", "nb", *(rounded(c).alias(c) for c in ("t", "dof", "d", "g"))), sql(T, f", s AS (SELECT subject, count(*) FILTER (condition = 'click') AS na, count(*) FILTER (condition = 'view') AS nb, avg(outcome) FILTER (condition = 'click') AS ma, avg(outcome) FILTER (condition = 'view') AS mb, var_samp(outcome) FILTER (condition = 'click') AS va, var_samp(outcome) FILTER (condition = 'view') AS vb FROM trials GROUP BY subject), d AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s WHERE na >= 2 AND nb >= 2) SELECT subject, na, nb, {r('(ma - mb) / sqrt(va / na + vb / nb)')} AS t, {r('power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))')} AS dof, {r('d')} AS d, {r('d * (1 - 3 / (4.0 * (na + nb) - 9))')} AS g FROM d")),
    "e2_paired": (lambda i: op.paired(i.trials.groupBy("subject", "run").agg(F.avg(F.when(F.col("condition") == "click", F.col("outcome"))).alias("a"), F.avg(F.when(F.col("condition") == "view", F.col("outcome"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), ["run"], "a", "b").select("run", "n", *(rounded(c).alias(c) for c in ("dz", "gz", "t"))), sql(T, f", c AS (SELECT subject, run, avg(outcome) FILTER (condition = 'click') AS a, avg(outcome) FILTER (condition = 'view') AS b FROM trials GROUP BY ALL), s AS (SELECT run, count(*) AS n, avg(b - a) / stddev_samp(b - a) AS dz FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY run) SELECT run, n, {r('dz')} AS dz, {r('dz * (1 - 3 / (4.0 * n - 5))')} AS gz, {r('dz * sqrt(n)')} AS t FROM s")),
    "e3_rank_sum": (lambda i: op.rank_sum(i.trials, ["run"], "outcome", "condition", [("click", "view"), ("click", "error")]).select("run", "ga", "gb", "na", "nb", rounded("u").alias("u"), rounded("z").alias("z")), sql(T, f", b AS (SELECT t.*, ga, gb FROM trials t JOIN (VALUES ('click', 'view'), ('click', 'error')) p(ga, gb) ON condition IN (ga, gb)), k AS (SELECT *, rank() OVER (PARTITION BY run, ga, gb ORDER BY outcome) + (count(*) OVER (PARTITION BY run, ga, gb, outcome) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY run, ga, gb, outcome) AS ties FROM b), s AS (SELECT run, ga, gb, count(*) FILTER (condition = ga) AS na, count(*) FILTER (condition = gb) AS nb, sum(rk) FILTER (condition = ga) AS ra, sum(ties * ties - 1)::DOUBLE AS tie FROM k GROUP BY ALL), u AS (SELECT *, ra - na * (na + 1) / 2.0 AS u, (na + nb)::DOUBLE AS n FROM s) SELECT run, ga, gb, na, nb, {r('u')} AS u, {r('sign(u - na * nb / 2.0) * greatest(abs(u - na * nb / 2.0) - 0.5, 0) / sqrt(na * nb / 12.0 * ((n + 1) - tie / (n * (n - 1))))')} AS z FROM u")),
    "e3_signed_rank": (lambda i: op.signed_rank(_sides(i), ["run"], "a", "b").select("run", "n", rounded("w").alias("w"), rounded("z").alias("z"), rounded("p").alias("p")), sql(T, """, m AS (SELECT subject, run, condition, 2 * sum(round(outcome * 1e6)::BIGINT) + 100000 * count(outcome) AS top, 200000 * count(outcome) AS under FROM trials WHERE outcome IS NOT NULL GROUP BY ALL), t AS (SELECT subject, run, condition, ((top - ((top % under) + under) % under) // under)::DOUBLE AS tenths FROM m), c AS (SELECT subject, run, max(tenths) FILTER (condition = 'view') - max(tenths) FILTER (condition = 'click') AS d FROM t GROUP BY ALL), k AS (SELECT run, d, rank() OVER (PARTITION BY run ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run, abs(d)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY run, abs(d)) AS t FROM c WHERE d <> 0),
    s AS (SELECT run, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w, sum(t * t - 1) AS tie FROM k GROUP BY run), z AS (SELECT run, n, w, (w - n * (n + 1) / 4) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48.0), 0) AS z FROM s)""" + f" SELECT run, n::BIGINT AS n, {r('w')} AS w, {r('z')} AS z, {r('greatest(0, 1 - (SELECT sum(exp(j * ln(2) + (2 * j + 1) * ln(greatest(abs(z) / sqrt(2), 1e-12)) - lgamma(2.0 * j + 2) + j * ln(2) + lgamma(j + 1.0))) FROM (SELECT unnest(range(200)) AS j)) * 2 / sqrt(pi()) * exp(-z * z / 2))')} AS p FROM z")),
    "e5_effect_words": (lambda i: op.two_groups(i.trials, ["subject"], "outcome", F.col("condition") == "click", F.col("condition") == "view").select("subject", op.effect_words(F.round("d", 6)).alias("size")), sql(T, ", s AS (SELECT subject, count(*) FILTER (condition = 'click') AS na, count(*) FILTER (condition = 'view') AS nb, avg(outcome) FILTER (condition = 'click') AS ma, avg(outcome) FILTER (condition = 'view') AS mb, var_samp(outcome) FILTER (condition = 'click') AS va, var_samp(outcome) FILTER (condition = 'view') AS vb FROM trials GROUP BY subject), d AS (SELECT subject, abs(round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6)) AS d FROM s WHERE na >= 2 AND nb >= 2) SELECT subject, CASE WHEN d < 0.2 THEN 'negligible' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' ELSE 'large' END AS size FROM d")),
    "h1_benjamini_hochberg": (lambda i: op.benjamini_hochberg(_pvalues(i), "p", ["condition"], ["subject", "trial_id"]).select("subject", "trial_id", rounded("q").alias("q")), sql(T, PV + f", k AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY p, subject, trial_id) AS k, count(*) OVER (PARTITION BY condition) AS m FROM p) SELECT subject, trial_id, {r(BH.format(k='condition'))} AS q FROM k")),
    "h2_hierarchical_fdr": (lambda i: op.hierarchical_fdr(_pvalues(i), "p", "subject", ["trial_id"]).select("subject", "trial_id", rounded("q").alias("q"), rounded("family_q").alias("family_q"), "reject"), sql(T, PV + f", k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p, trial_id) AS k, count(*) OVER (PARTITION BY subject) AS m FROM p), f AS (SELECT subject, min(p * m / k) AS fp FROM k GROUP BY subject), g AS (SELECT subject, fp, row_number() OVER (ORDER BY fp, subject) AS k, count(*) OVER () AS m FROM f), fq AS (SELECT subject, least(1.0, min(fp * m / k) OVER (ORDER BY fp, subject ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fq FROM g), w AS (SELECT *, {BH.format(k='subject')} AS q FROM k) SELECT subject, trial_id, {r('q')} AS q, {r('fq')} AS family_q, q < 0.05 AND fq < 0.05 AS reject FROM w JOIN fq USING (subject)")),
    "h3_holm": (lambda i: op.holm(_pvalues(i), "p", ["subject"], ["trial_id"]).select("subject", "trial_id", rounded("p_holm").alias("p_holm")), sql(T, PV + f", k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p, trial_id) AS k, count(*) OVER (PARTITION BY subject) AS m FROM p) SELECT subject, trial_id, {r('max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY subject ORDER BY p, trial_id ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM k")),
    "h4_significant_edges": (lambda i: op.significant_edges(i.samples.where("condition IN (0, 1)").withColumn("c", F.col("condition").cast("string")), "channel", "x", "c", "0", "1").select("channel", "na", "nb", rounded("u").alias("u"), rounded("z").alias("z"), rounded("p").alias("p"), rounded("q").alias("q")), sql("samples", f""", k AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY x) + (count(*) OVER (PARTITION BY channel, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY channel, x) AS ties FROM samples WHERE condition IN (0, 1)), s AS (SELECT channel, count(*) FILTER (condition = 0) AS na, count(*) FILTER (condition = 1) AS nb, sum(rk) FILTER (condition = 0) AS ra, sum(ties * ties - 1)::DOUBLE AS tie FROM k GROUP BY ALL), u AS (SELECT *, ra - na * (na + 1) / 2.0 AS u, (na + nb)::DOUBLE AS n FROM s), s2 AS (SELECT channel, na, nb, u, sign(u - na * nb / 2.0) * greatest(abs(u - na * nb / 2.0) - 0.5, 0) / sqrt(na * nb / 12.0 * ((n + 1) - tie / (n * (n - 1)))) AS z FROM u),
    p AS (SELECT *, greatest(0, 1 - (SELECT sum(exp(j * ln(2) + (2 * j + 1) * ln(greatest(abs(z) / sqrt(2), 1e-12)) - lgamma(2.0 * j + 2) + j * ln(2) + lgamma(j + 1.0))) FROM (SELECT unnest(range(200)) AS j)) * 2 / sqrt(pi()) * exp(-z * z / 2)) AS p FROM s2),
    o AS (SELECT *, row_number() OVER (ORDER BY p, channel) AS k, count(*) OVER () AS m FROM p) SELECT channel, na, nb, {r('u')} AS u, {r('z')} AS z, {r('p')} AS p, {r('least(1.0, min(p * m / k) OVER (ORDER BY p, channel ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q FROM o""")),
    "r1_circular_shift": (lambda i: op.shifted(i.trials.select("subject", "trial_id", "outcome"), ["subject"], "trial_id", "outcome", 3).select("subject", "trial_id", "perm", "permuted"), sql(T, ", p AS (SELECT subject, trial_id, outcome, perm, count(*) OVER (PARTITION BY subject, perm) AS n FROM trials, (SELECT unnest(range(3)) AS perm)), s AS (SELECT *, (trial_id - 1 + ('0x' || substr(md5('1|' || perm || '|' || subject), 1, 8))::BIGINT % n) % n + 1 AS place FROM p) SELECT subject, perm, place AS trial_id, outcome AS permuted FROM s")),
    "r1_permute": (lambda i: op.permuted(i.trials.select("subject", "trial_id", "outcome"), ["subject"], "trial_id", "outcome", 3).select("subject", "trial_id", "perm", "permuted"), sql(T, PERM + " SELECT subject, trial_id, perm, permuted FROM n WHERE perm < 3")),
    "r2_bootstrap_mean": (_boot, sql(T, BOOT + f", c AS (SELECT subject, boot, avg(outcome) AS m FROM b GROUP BY ALL) SELECT subject, {r('quantile_cont(m, 0.025)')} AS low, {r('quantile_cont(m, 0.975)')} AS high FROM c GROUP BY subject")),
    "r3_sign_flip": (lambda i: op.sign_flip(_flip_units(i), ["subject"], "condition", "d").select("subject", rounded("observed").alias("observed"), "extreme", rounded("p").alias("p")), sql(T, f", u AS (SELECT subject, condition, avg(outcome) - 49 AS d FROM trials GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY condition) - 1 AS place, count(*) OVER (PARTITION BY subject) AS size FROM u), s AS (SELECT subject, pat, avg((1 - 2 * ((pat >> place) & 1)) * d) AS stat FROM p, (SELECT unnest(range(4096)) AS pat) WHERE pat < (1 << size::INT) GROUP BY ALL), o AS (SELECT subject, stat AS observed FROM s WHERE pat = 0) SELECT subject, {r('any_value(observed)')} AS observed, count(*) FILTER (abs(stat) >= abs(observed) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(stat) >= abs(observed) - 1e-12) + 1) / (count(*) + 1)')} AS p FROM s JOIN o USING (subject) GROUP BY subject")),
    "r4_permutation_r": (lambda i: op.permutation_p(_per(i), _perm_null(i), ["subject"], "r").select("subject", rounded("observed").alias("observed"), "extreme", rounded("p").alias("p")), sql(T, PERM + f", {PER}, z AS (SELECT subject, perm, corr(predictor, permuted) AS s FROM n GROUP BY ALL) SELECT subject, {r('any_value(r)')} AS observed, count(*) FILTER (abs(s) >= abs(r) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(s) >= abs(r) - 1e-12) + 1) / (count(*) + 1)')} AS p FROM z JOIN c USING (subject) GROUP BY subject")),
    "r6_permutation_difference": (_difference, sql(T, PERM + f", o AS (SELECT subject, avg(outcome) FILTER (condition = 'click') - avg(outcome) FILTER (condition = 'view') AS o FROM trials GROUP BY subject), z AS (SELECT subject, perm, avg(permuted) FILTER (condition = 'click') - avg(permuted) FILTER (condition = 'view') AS s FROM n GROUP BY ALL) SELECT subject, {r('any_value(o)')} AS observed, count(*) FILTER (abs(s) >= abs(o) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(s) >= abs(o) - 1e-12) + 1) / (count(*) + 1)')} AS p FROM z JOIN o USING (subject) GROUP BY subject")),
    "r7_permute_blocks": (_effective, sql(T, f", b AS (SELECT subject, run, trial_id, outcome, perm FROM trials, (SELECT unnest(range(5)) AS perm)), k AS (SELECT *, row_number() OVER (PARTITION BY subject, run, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, run, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM b) SELECT a.subject, a.perm, {r('avg((a.outcome <> s.outcome)::INT)')} AS changed FROM k a JOIN k s ON a.subject = s.subject AND a.run = s.run AND a.perm = s.perm AND a.place = s.drawn GROUP BY ALL")),
}
