"""Queries of clusters of cells, traces, peaks and group effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as op
from ..operators import imaging as im
from ..operators import names, signal, stats
from ..operators import windows as win
from ..sources.tables import r, rounded, sql
from .extended import _cells, _round
from .names import P

N_PERM = 10


def _recursive(tables: str, body: str) -> str:
    return sql(tables, body).replace("WITH ", "WITH RECURSIVE ", 1)


# clusters of a table n (perm, a, b, v) by all cells that each cell reaches
REACH = """, reach AS (SELECT perm, sign(v) AS s, a, b, a AS a2, b AS b2 FROM n UNION SELECT q.perm, q.s, q.a, q.b, n.a, n.b FROM reach q JOIN n ON n.perm = q.perm AND sign(n.v) = q.s AND abs(n.a - q.a2) + abs(n.b - q.b2) = 1),
    lab AS (SELECT perm, s, a, b, min(a2 * 1000 + b2)::INT AS l FROM reach GROUP BY ALL),
    mass AS (SELECT perm, s, l, count(*) AS n, sum(abs(v)) AS mass FROM lab JOIN n USING (perm, a, b) GROUP BY ALL)"""
MASS_P = """, top AS (SELECT perm, max(mass) AS top FROM mass WHERE perm >= 0 GROUP BY perm),
    o AS (SELECT s, l, n, mass, (SELECT count(*) FROM top WHERE top >= m.mass - 1e-12) AS e FROM mass m WHERE perm = -1)"""
CELLS = ", c AS (SELECT subject, freq, (t * 8 + 2)::INT AS k, avg(power) AS power, avg(condition) AS target FROM tfr GROUP BY ALL)"
R_CELLS = CELLS + """, d AS (SELECT DISTINCT subject, target FROM c),
    z AS (SELECT d.*, perm, row_number() OVER (PARTITION BY perm ORDER BY subject) AS place, row_number() OVER (PARTITION BY perm ORDER BY md5('1|' || perm || '|' || subject), subject) AS drawn FROM d, (SELECT unnest(range(10)) AS perm)),
    y AS (SELECT a.subject, a.perm, b.target FROM z a JOIN z b ON a.perm = b.perm AND a.place = b.drawn UNION ALL SELECT subject, -1, target FROM d),
    n AS (SELECT perm, freq AS a, k AS b, round(corr(power, y.target), 9) AS v FROM c JOIN y USING (subject) GROUP BY perm, freq, k HAVING abs(round(corr(power, y.target), 9)) > 0.2)"""
T_CELLS = """, d AS (SELECT DISTINCT trial_id, condition % 2 AS g FROM samples),
    z AS (SELECT d.*, perm, row_number() OVER (PARTITION BY perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM d, (SELECT unnest(range(10)) AS perm)),
    y AS (SELECT a.trial_id, a.perm, b.g FROM z a JOIN z b ON a.perm = b.perm AND a.place = b.drawn UNION ALL SELECT trial_id, -1, g FROM d),
    q AS (SELECT perm, channel AS a, sample_idx AS b, (avg(x) FILTER (g = 1) - avg(x) FILTER (g = 0)) / sqrt(var_samp(x) FILTER (g = 1) / count(*) FILTER (g = 1) + var_samp(x) FILTER (g = 0) / count(*) FILTER (g = 0)) AS v FROM samples JOIN y USING (trial_id) GROUP BY perm, channel, sample_idx),
    n AS (SELECT * FROM q WHERE abs(v) > 1.0)"""


def _label(df, a, b):
    return df.select("sign", (F.col(f"label.{a}") * 1000 + F.col(f"label.{b}")).cast("int").alias("label"), "n", rounded("mass").alias("mass"), *([rounded("p").alias("p")] if "p" in df.columns else []))


def _r(df, keys):
    return op.correlation_cells(df, keys, ["freq", "k"], "power", "target").withColumn("r", F.round("r", 9))


def _grid(i):
    return _label(op.masses(_r(_cells(i), []), [], ["freq", "k"], "r", 0.2), "freq", "k")


def _cluster_p(i):
    observed = op.masses(_r(_cells(i), []), [], ["freq", "k"], "r", 0.2)
    null = op.masses(_r(op.shuffled_target(_cells(i), "subject", "target", N_PERM), ["perm"]), ["perm"], ["freq", "k"], "r", 0.2)
    return _label(op.max_mass_p(observed, null, [], N_PERM), "freq", "k")


def _two_condition(i):
    s = i.samples.select("trial_id", "channel", "sample_idx", "x", (F.col("condition") % 2).alias("g"))
    return _label(op.two_condition_test(s, "trial_id", ["channel", "sample_idx"], "x", "g", 1.0, N_PERM), "channel", "sample_idx")


def _voxels(i):
    t = im.one_sample(i.voxels, ["condition", "voxel"]).select("condition", (F.col("voxel") % 4).alias("x"), (F.floor(F.col("voxel") / 4) % 4).cast("int").alias("y"), F.floor(F.col("voxel") / 16).cast("int").alias("z_axis"), "t")
    return op.voxel_clusters(t, ["condition"], "t", 3, z_cut=0.8).select("condition", "x", "y", "z_axis", rounded("t").alias("t"), "cluster_size")


def _laterality(i):
    contra = i.samples.where((F.col("channel") >= 4) == (F.col("condition") % 2 == 0)).groupBy("trial_id", "t").agg(F.avg(F.col("x") * F.col("x")).alias("power"))
    trace = win.baseline_correct(contra, "power", ["trial_id"], F.col("t") < 0, "percent").where("t >= 0")
    out = op.laterality(trace, ["trial_id"], "t", "corrected", 20.0, 20.0, 0.125, 2)
    return out.select("trial_id", *(rounded(c, 4).alias(c) for c in ("peak_latency", "erd_magnitude", "onset_latency", "rebound_magnitude", "rebound_latency")))


def _bayes(i):
    per = stats.correlations(i.trials, ["subject"], "predictor", "outcome")
    return op.bayes_factor(per.withColumn("r", F.round("r", 9))).select("subject", "n", rounded("bf10").alias("bf10"), "evidence")


def _group_effects(i):
    slopes = i.trials.groupBy("subject", "condition").agg(F.regr_slope("outcome", "predictor").alias("value"))
    return _round(im.group_effects(slopes, ["condition"], "subject", "value", 40), "mean", "t", "low", "high", "p", "p_holm", keep=("condition", "n"))


def _coupling(i):
    kept = im.trial_censoring(i.trials, {"slow": F.col("outcome") > 150, "weak": F.col("predictor") < 5}).where("kept")
    z = win.normalise(kept, "outcome", ["subject"], "robust")
    beta = stats.per_group_beta(z, ["subject"], "predictor", "scaled", "onset").withColumn("analysis", F.lit("coupling"))
    return _round(im.one_sample(beta, ["analysis"], "beta"), "mean", "t", keep=("analysis", "n"))


def _ranked(i):
    f = i.features.where("feature <> 'price'").join(i.wide.select("subject", "trial_id", F.col("price").alias("target")), ["subject", "trial_id"])
    return stats.correlations(f, ["subject", "feature"], "value", "target", "spearman").select("subject", "feature", "n", rounded("r").alias("r"))


QUERIES = {
    "k1_clusters_grid": (_grid, _recursive("tfr", R_CELLS + REACH + f" SELECT s::INT AS sign, l AS label, n, {r('mass')} AS mass FROM mass WHERE perm = -1")),
    "k2_cluster_p": (_cluster_p, _recursive("tfr", R_CELLS + REACH + MASS_P + f" SELECT s::INT AS sign, l AS label, n, {r('mass')} AS mass, {r('(e + 1) / 11.0::DOUBLE')} AS p FROM o")),
    "k3_two_condition_test": (_two_condition, _recursive("samples", T_CELLS + REACH + MASS_P + f" SELECT s::INT AS sign, l AS label, n, {r('mass')} AS mass, {r('(e + 1) / 11.0::DOUBLE')} AS p FROM o")),
    "i21_voxel_clusters": (_voxels, _recursive("voxels", """, n AS (SELECT condition, voxel % 4 AS x, voxel // 4 % 4 AS y, voxel // 16 AS z, avg(value) * sqrt(count(*)) / stddev_samp(value) AS t FROM voxels GROUP BY condition, voxel HAVING abs(avg(value) * sqrt(count(*)) / stddev_samp(value)) >= 0.8),
    reach AS (SELECT condition, x, y, z, x AS x2, y AS y2, z AS z2 FROM n UNION SELECT q.condition, q.x, q.y, q.z, n.x, n.y, n.z FROM reach q JOIN n ON n.condition = q.condition AND abs(n.x - q.x2) + abs(n.y - q.y2) + abs(n.z - q.z2) = 1)""" + f" SELECT n.condition, n.x::INT AS x, n.y::INT AS y, n.z::INT AS z_axis, {r('any_value(t)')} AS t, count(*) AS cluster_size FROM n JOIN reach q ON n.condition = q.condition AND n.x = q.x AND n.y = q.y AND n.z = q.z GROUP BY n.condition, n.x, n.y, n.z HAVING count(*) >= 3")),
    "f13_laterality": (_laterality, sql("samples", """, c AS (SELECT trial_id, t, avg(x * x) AS p FROM samples WHERE (channel >= 4) = (condition % 2 = 0) GROUP BY ALL), b AS (SELECT trial_id, t, 100 * (p / (avg(p) FILTER (t < 0) OVER (PARTITION BY trial_id)) - 1) AS v FROM c), a AS (SELECT * FROM b WHERE t >= 0),
    k AS (SELECT trial_id, arg_min(t, v) AS pt, greatest(-min(v), 0) AS mag FROM a GROUP BY trial_id),
    o AS (SELECT trial_id, min(t) AS onset FROM (SELECT trial_id, t, v, lead(v) OVER (PARTITION BY trial_id ORDER BY t) AS nx FROM a) WHERE v <= -20 AND nx <= -20 GROUP BY trial_id),
    w AS (SELECT a.trial_id, t, v, lead(v) OVER (PARTITION BY a.trial_id ORDER BY t) AS nx FROM a JOIN k USING (trial_id) WHERE t >= pt + 0.125),
    x AS (SELECT trial_id, max(v) AS rm, arg_max(t, v) AS rt FROM w GROUP BY trial_id HAVING bool_or(v >= 20 AND nx >= 20))""" + f" SELECT trial_id, {r('pt', 4)} AS peak_latency, {r('mag', 4)} AS erd_magnitude, {r('onset', 4)} AS onset_latency, {r('rm', 4)} AS rebound_magnitude, {r('rt', 4)} AS rebound_latency FROM k LEFT JOIN o USING (trial_id) LEFT JOIN x USING (trial_id)")),
    "f35_coupling_surrogates": (lambda i: op.coupling_surrogates(i.analytic, ["subject"], "trial_id", 0, 1, N_PERM).select("subject", "trial_id", rounded("pac").alias("pac"), rounded("z", 4).alias("z")), sql("analytic", """, p AS (SELECT subject, trial_id, t, re / sqrt(re * re + im * im) AS c, im / sqrt(re * re + im * im) AS s FROM analytic WHERE channel = 0), a AS (SELECT subject, trial_id, t, sqrt(re * re + im * im) AS a FROM analytic WHERE channel = 1),
    d AS (SELECT subject, trial_id, k, coalesce(lead(trial_id) OVER w, first_value(trial_id) OVER w) AS donor FROM (SELECT DISTINCT subject, trial_id FROM a), (SELECT unnest(range(1, 11)) AS k) WINDOW w AS (PARTITION BY subject, k ORDER BY md5('1|' || k || '|' || trial_id), trial_id)),
    v AS (SELECT a.subject, a.trial_id, 0 AS k, sqrt(power(sum(a * c), 2) + power(sum(a * s), 2)) / sum(a) AS pac FROM a JOIN p USING (subject, trial_id, t) GROUP BY ALL UNION ALL SELECT a.subject, a.trial_id, k, sqrt(power(sum(a * c), 2) + power(sum(a * s), 2)) / sum(a) FROM d JOIN a USING (subject, trial_id) JOIN p ON p.subject = d.subject AND p.trial_id = d.donor AND p.t = a.t WHERE donor <> d.trial_id GROUP BY ALL)""" + f" SELECT subject, trial_id, {r('max(pac) FILTER (k = 0)')} AS pac, {r('(max(pac) FILTER (k = 0) - avg(pac) FILTER (k > 0)) / nullif(stddev_pop(pac) FILTER (k > 0), 0)', 4)} AS z FROM v GROUP BY subject, trial_id")),
    "c7_bayes_factor": (_bayes, sql("trials", """, c AS (SELECT subject, count(*) AS n, round(corr(predictor, outcome), 9) AS r FROM trials GROUP BY subject), h AS (SELECT subject, n, r, (SELECT sum(exp(2 * (lgamma(k + 0.5) - lgamma(0.5)) + lgamma((n + 1) / 2.0) - lgamma((n + 1) / 2.0 + k) - lgamma(k + 1.0)) * power(r * r, k)) FROM (SELECT unnest(range(400)) AS k)) AS f FROM c),
    b AS (SELECT subject, n, 2 * sqrt(n - 1) * power(1 - r * r, (n - 1) / 2.0) * f AS b FROM h)""" + f" SELECT subject, n, {r('b')} AS bf10, CASE WHEN b < 0.01 THEN 'extreme_H0' WHEN b < 1.0 / 30 THEN 'very_strong_H0' WHEN b < 0.1 THEN 'strong_H0' WHEN b < 1.0 / 3 THEN 'moderate_H0' WHEN b < 1 THEN 'anecdotal_H0' WHEN b < 3 THEN 'anecdotal_H1' WHEN b < 10 THEN 'moderate_H1' WHEN b < 30 THEN 'strong_H1' WHEN b < 100 THEN 'very_strong_H1' ELSE 'extreme_H1' END AS evidence FROM b")),
    "m7_in_regions": (lambda i: names.in_regions(names.parsed(i.names), ["E1", " e3", "e5"]), sql("names", f"SELECT * FROM ({P}) WHERE scope = 'roi' AND lower(trim(identifier)) IN ('e1', 'e3', 'e5')")),
    "c10_ranked_families": (_ranked, sql("features", f", k AS (SELECT f.subject, f.feature, rank() OVER (PARTITION BY f.subject, f.feature ORDER BY f.value) + (count(*) OVER (PARTITION BY f.subject, f.feature, f.value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY f.subject, f.feature ORDER BY w.price) + (count(*) OVER (PARTITION BY f.subject, f.feature, w.price) - 1) / 2.0 AS b FROM features f JOIN wide w USING (subject, trial_id) WHERE f.feature <> 'price') SELECT subject, feature, count(*) AS n, {r('corr(a, b)')} AS r FROM k GROUP BY ALL")),
    "i16_group_effects": (_group_effects, sql("trials", """, b AS (SELECT subject, condition, regr_slope(outcome, predictor) AS v FROM trials GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY subject) - 1 AS place, count(*) OVER (PARTITION BY condition) AS size FROM b WHERE v IS NOT NULL AND NOT isnan(v)),
    s AS (SELECT condition, pat, avg(CASE WHEN size <= 12 THEN 1 - 2 * ((pat >> place) & 1) WHEN pat = 0 THEN 1 ELSE 1 - 2 * (('0x' || substr(md5('1|' || pat || '|' || place), 1, 8))::BIGINT % 2) END * v) AS stat FROM u, (SELECT unnest(range(4096)) AS pat) WHERE pat < CASE WHEN size <= 12 THEN 1 << size::INT ELSE 1001 END GROUP BY ALL),
    p AS (SELECT s.condition, (count(*) FILTER (abs(s.stat) >= abs(o.stat) - 1e-12) + 1) / (count(*) + 1) AS p FROM s JOIN s o ON s.condition = o.condition AND o.pat = 0 GROUP BY s.condition),
    h AS (SELECT *, row_number() OVER (ORDER BY p, condition) AS k, count(*) OVER () AS m FROM p), hp AS (SELECT condition, p, max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING) AS p_holm FROM h),
    w AS (SELECT d.condition, boot, avg(u.v) AS m FROM (SELECT condition, boot, ('0x' || substr(md5('1|' || boot || '|' || place), 1, 8))::BIGINT % size AS place FROM u, (SELECT unnest(range(40)) AS boot)) d JOIN u ON u.condition = d.condition AND u.place = d.place GROUP BY ALL),
    q AS (SELECT condition, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM w GROUP BY condition)""" + f" SELECT condition, count(*) AS n, {r('avg(v)')} AS mean, {r('avg(v) * sqrt(count(*)) / stddev_samp(v)')} AS t, {r('any_value(low)')} AS low, {r('any_value(high)')} AS high, {r('any_value(p)')} AS p, {r('any_value(p_holm)')} AS p_holm FROM u JOIN q USING (condition) JOIN hp USING (condition) GROUP BY condition")),
    "i18_coupling_run": (_coupling, sql("trials", f""", k AS (SELECT * FROM trials WHERE outcome <= 150 AND predictor >= 5), m AS (SELECT *, median(outcome) OVER (PARTITION BY subject) AS m FROM k), z AS (SELECT subject, predictor AS x, onset AS o, (outcome - m) / nullif(1.4826 * median(abs(outcome - m)) OVER (PARTITION BY subject), 0) AS z FROM m),
    s AS (SELECT subject, count(*) AS n, covar_pop(x, z) AS xy, covar_pop(x, o) AS xz, covar_pop(z, o) AS yz, var_pop(x) AS xx, var_pop(o) AS zz FROM z GROUP BY subject), b AS (SELECT CASE WHEN n > 3 AND xx * zz - xz * xz > 1e-12 * xx * zz THEN (xy * zz - xz * yz) / (xx * zz - xz * xz) END AS b FROM s) SELECT 'coupling' AS analysis, count(b) AS n, {r('avg(b)')} AS mean, {r('avg(b) * sqrt(count(b)) / stddev_samp(b)')} AS t FROM b""")),
}
