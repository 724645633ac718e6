"""Queries of elastic nets and logistic regression over held-out groups, from sums of products and joint Newton steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crossval as op
from ..operators import logistic, models
from ..sources.tables import r, rounded, sql
from .validation import _rows

FEATURES = ["quantity", "discount", "tax"]
PENALTIES, MIXES = [0.01, 100.0, 4000.0], [0.0, 0.5, 1.0]
GRID = [(p, m) for p in PENALTIES for m in MIXES]
NETS = [(0.01, 0.5), (1.0, 0.5), (1.0, 1.0), (20.0, 0.5)]
STRENGTHS = [0.001, 0.1]


def _round(df, *columns, keep=(), digits=6):
    return df.select(*keep, *(rounded(c, digits).alias(c) for c in columns))


def _folded(i):
    return i.wide.withColumn("fold", F.pmod("run", F.lit(3)))


def _grid(i):
    p = models.grid_regression(_folded(i), FEATURES, "price", F.col("subject") % 4 > 0, "fold", PENALTIES, MIXES)
    return p.groupBy("penalty", "mix").agg(F.count("prediction").alias("n"), rounded(F.avg("prediction"), 2).alias("prediction"))


def _elastic(i):
    p = models.elastic_net(_folded(i), FEATURES, "price", F.col("subject") % 4 > 0)
    return _round(models.regression_errors(p, ["condition"], "price", "prediction"), "mae", "rmse", "r2", keep=("condition", "n"), digits=4)


def _nested(i):
    w = op.nested_net(_rows(i), [], "subject", ["predictor"], "outcome", NETS, F.col("subject") % 5)
    return w.select("subject", "penalty", "mix", rounded(F.get("weights", F.lit(0))).alias("intercept"), rounded(F.get("weights", F.lit(1))).alias("slope"))


def _net(rows, keys=(), y="outcome", grid=((1.0, 0.5),)):
    return op.nested_net(rows, list(keys), "subject", ["predictor"], y, list(grid))


def _permuted(i):
    got = op.label_permutation(_rows(i), "subject", ["subject", "run"], "trial_id", ["predictor"], "outcome", 0.0, 10, _net)
    return got.select(rounded("observed").alias("observed"), "n_perm", "extreme", rounded("p").alias("p"))


def _compared(i):
    net = op.fold_scores(op.predicted(_rows(i), _net(_rows(i)), ["subject"], ["predictor"]), "subject", "outcome", "prediction", "net", "mae")
    mean = _rows(i).join(models.held_out_mean(_rows(i), "subject", "outcome"), "subject")
    scores = net.unionByName(op.fold_scores(mean, "subject", "outcome", "prediction", "mean", "mae"))
    return op.compare_models(scores, "subject", [("net", "mean")], "mae").select("ma", "mb", rounded("difference").alias("difference"), rounded("p").alias("p"), rounded("p_holm").alias("p_holm"))


def _labelled(i):
    return _rows(i).withColumn("y", (F.col("outcome") > 40).cast("int"))


def _classifier(i):
    return logistic.nested_logistic(_labelled(i), "subject", ["predictor"], "y", STRENGTHS, F.col("subject") % 3, scoring="log_loss")


def _weights(i):
    return _classifier(i).select("subject", "strength", rounded(F.get("weights", F.lit(0))).alias("intercept"), rounded(F.get("weights", F.lit(1))).alias("slope"))


def _run(i):
    p = logistic.probabilities(_labelled(i), _classifier(i), "subject", ["predictor"]).withColumn("p", F.round("p", 9))
    return _round(models.classification_metrics(p, ["subject"], "y", "p"), "auc", "balanced", "f1", "brier", "ece", keep=("subject",))


def _soft(x: str, by: str) -> str:
    return f"(sign({x}) * greatest(abs({x}) - {by}, 0))"


def descent_sql(grid: list[tuple[float, float]]) -> str:
    """Elastic nets of three features by 300 sweeps of coordinate descent on the correlations of each training fold (``f``; -1 is
    all of them): table ``net`` with intercept ``a`` and slopes ``w1, w2, w3``."""
    points = ", ".join(f"({p}::DOUBLE, {m}::DOUBLE, {k})" for k, (p, m) in enumerate(grid))
    l1, l2 = "pen * mix", "(1 + pen * (1 - mix))"
    return f""", tr AS (SELECT *, run % 3 AS fold FROM wide WHERE subject % 4 > 0),
    ff AS (SELECT DISTINCT fold AS f FROM tr UNION ALL SELECT -1),
    mo AS (SELECT f, stddev_pop(quantity) AS s1, stddev_pop(discount) AS s2, stddev_pop(tax) AS s3, avg(quantity) AS m1, avg(discount) AS m2, avg(tax) AS m3, avg(price) AS my,
        corr(quantity, discount) AS r12, corr(quantity, tax) AS r13, corr(discount, tax) AS r23,
        covar_pop(quantity, price) / stddev_pop(quantity) AS c1, covar_pop(discount, price) / stddev_pop(discount) AS c2, covar_pop(tax, price) / stddev_pop(tax) AS c3
        FROM ff JOIN tr ON tr.fold <> f GROUP BY f),
    gr(pen, mix, place) AS (VALUES {points}),
    cd AS (SELECT f, place, 0 AS k, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM mo, gr
        UNION ALL SELECT f, place, k + 1, n1, n2, {_soft('c3 - r13 * n1 - r23 * n2', l1)} / {l2}
        FROM (SELECT *, {_soft('c2 - r12 * n1 - r23 * b3', l1)} / {l2} AS n2
            FROM (SELECT cd.*, mo.* EXCLUDE (f), pen, mix, {_soft('c1 - r12 * b2 - r13 * b3', l1)} / {l2} AS n1 FROM cd JOIN mo USING (f) JOIN gr USING (place) WHERE k < 300))),
    net AS (SELECT f, place, pen, mix, b1 / s1 AS w1, b2 / s2 AS w2, b3 / s3 AS w3, my - b1 / s1 * m1 - b2 / s2 * m2 - b3 / s3 * m3 AS a FROM cd JOIN mo USING (f) JOIN gr USING (place) WHERE k = 300),
    er AS (SELECT place, sum(power(price - a - w1 * quantity - w2 * discount - w3 * tax, 2)) AS sse FROM net JOIN tr ON tr.fold = f GROUP BY place),
    best AS (SELECT place FROM er ORDER BY sse, place LIMIT 1),
    te AS (SELECT wide.*, pen, mix, a + w1 * quantity + w2 * discount + w3 * tax AS guess FROM wide, net JOIN best USING (place) WHERE f = -1 AND subject % 4 = 0)"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


#: Slope of a net of one feature from a group's sums: the shrunk covariance, in the given units.
SLOPE = "(sign(sxy - sx * sy / n) * greatest(abs(sxy - sx * sy / n) / n / sqrt((sxx - sx * sx / n) / n) - {l1}, 0) / (1 + {l2}) / sqrt((sxx - sx * sx / n) / n))"
ONE = SLOPE.format(l1="0.5", l2="0.5")
OTHERS = """, o AS (SELECT subject, count(*)::DOUBLE AS n, sum(predictor) AS sx, sum(outcome) AS sy, sum(predictor * predictor) AS sxx, sum(predictor * outcome) AS sxy FROM trials GROUP BY subject),
    q AS (SELECT subject, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM o)"""
NESTED = (
    f""", gr(pen, mix, place) AS (VALUES {", ".join(f"({p}::DOUBLE, {m}::DOUBLE, {k})" for k, (p, m) in enumerate(NETS))}), u AS (SELECT DISTINCT subject FROM trials),
    s AS (SELECT u.subject, k, count(*)::DOUBLE AS n, sum(predictor) AS sx, sum(outcome) AS sy, sum(predictor * predictor) AS sxx, sum(predictor * outcome) AS sxy FROM u CROSS JOIN (SELECT unnest(range(-1, 5)) AS k) JOIN trials t ON t.subject <> u.subject AND t.subject % 5 <> k GROUP BY ALL),
    f AS (SELECT subject, k, place, pen, mix, {SLOPE.format(l1="pen * mix", l2="pen * (1 - mix)")} AS b, sy / n AS my, sx / n AS mx FROM s, gr),
    e AS (SELECT f.subject, place, sum(power(outcome - my - b * (predictor - mx), 2)) AS sse FROM f JOIN trials t ON t.subject <> f.subject AND t.subject % 5 = f.k GROUP BY ALL),
    w AS (SELECT subject, place FROM e QUALIFY row_number() OVER (PARTITION BY subject ORDER BY sse, place) = 1)"""
)
PERMUTED = f""", k AS (SELECT subject, run, trial_id, predictor AS x, outcome AS y, perm, row_number() OVER (PARTITION BY subject, run, perm ORDER BY trial_id) AS place, row_number() OVER (PARTITION BY subject, run, perm ORDER BY md5('1|' || perm || '|' || trial_id), trial_id) AS drawn FROM trials, (SELECT unnest(range(10)) AS perm)),
    y AS (SELECT a.subject, a.perm, a.x, b.y FROM k a JOIN k b ON a.subject = b.subject AND a.run = b.run AND a.perm = b.perm AND a.place = b.drawn UNION ALL SELECT subject, -1, predictor, outcome FROM trials),
    s AS (SELECT subject, perm, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM y GROUP BY ALL),
    b AS (SELECT subject, perm, sum(n) OVER v - n AS n, sum(sx) OVER v - sx AS sx, sum(sy) OVER v - sy AS sy, sum(sxx) OVER v - sxx AS sxx, sum(sxy) OVER v - sxy AS sxy FROM s WINDOW v AS (PARTITION BY perm)),
    p AS (SELECT y.perm, y.y, sy / n + {ONE} * (x - sx / n) AS guess FROM y JOIN b USING (subject, perm)), c AS (SELECT perm, corr(y, guess) AS r FROM p GROUP BY perm)"""
COMPARED = OTHERS + f""", d AS (SELECT t.subject, avg(abs(outcome - sy / n - {ONE} * (predictor - sx / n))) - avg(abs(outcome - sy / n)) AS d FROM trials t JOIN q USING (subject) GROUP BY t.subject),
    z AS (SELECT *, row_number() OVER (ORDER BY subject) - 1 AS place, count(*) OVER () AS size FROM d),
    s AS (SELECT pat, avg(CASE WHEN size <= 12 THEN 1 - 2 * ((pat >> place) & 1) WHEN pat = 0 THEN 1 ELSE 1 - 2 * (('0x' || substr(md5('1|' || pat || '|' || place), 1, 8))::BIGINT % 2) END * d) AS stat FROM z, (SELECT unnest(range(4096)) AS pat) WHERE pat < CASE WHEN size <= 12 THEN 1 << size::INT ELSE 1001 END GROUP BY pat)"""


def newton_sql(steps: int = 12) -> str:
    """Held-out fits of one feature by unrolled Newton steps on counts of equal rows; table ``bb`` has every fit, ``ch`` the chosen."""
    out = [f""", d AS (SELECT subject, subject % 3 AS fold, predictor AS x, (outcome > 40)::INT AS y, count(*)::DOUBLE AS n FROM trials GROUP BY ALL),
    ft AS (SELECT * FROM (SELECT DISTINCT subject AS u FROM trials), (SELECT unnest(range(-1, 3)) AS f)),
    cn AS (SELECT u, f, x, y, sum(n) AS n FROM ft JOIN d ON d.subject <> u AND d.fold <> f GROUP BY ALL),
    st AS (SELECT u, f, sum(n) AS nn, sum(n) FILTER (y = 1) AS n1, sum(n * x) / sum(n) AS mx, sqrt(sum(n * x * x) / sum(n) - power(sum(n * x) / sum(n), 2)) AS sx FROM cn GROUP BY ALL),
    zz AS (SELECT u, f, (x - mx) / sx AS z, y, n * CASE WHEN y = 1 THEN nn / (2 * n1) ELSE nn / (2 * (nn - n1)) END AS w FROM cn JOIN st USING (u, f)),
    b0 AS (SELECT u, f, c, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM ft, (SELECT unnest({STRENGTHS})::DOUBLE AS c))"""]
    for k in range(1, steps + 1):
        out.append(f"""g{k} AS (SELECT u, f, c, a, b, c * sum(w * (y - p)) AS g0, c * sum(w * (y - p) * z) - b AS g1, c * sum(w * p * (1 - p)) AS h0, c * sum(w * p * (1 - p) * z) AS h1, c * sum(w * p * (1 - p) * z * z) + 1 AS h2
            FROM (SELECT *, 1 / (1 + exp(-a - b * z)) AS p FROM zz JOIN b{k - 1} USING (u, f)) GROUP BY u, f, c, a, b),
    b{k} AS (SELECT u, f, c, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM g{k})""")
    out.append(f"""bb AS (SELECT u, f, c, a - b * mx / sx AS a, b / sx AS b FROM b{steps} JOIN st USING (u, f)),
    sc AS (SELECT u, f, c, sum(n * ln(1 + exp(CASE WHEN y = 1 THEN -a - b * x ELSE a + b * x END))) / sum(n) AS loss FROM bb JOIN d ON d.subject <> u AND d.fold = f GROUP BY ALL),
    pk AS (SELECT u, c FROM (SELECT u, c, avg(loss) AS loss FROM sc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY u ORDER BY loss) = 1),
    ch AS (SELECT u AS subject, c AS strength, a, b FROM bb JOIN pk USING (u, c) WHERE f = -1)""")
    return ",\n    ".join(out)


METRICS = f""", s AS (SELECT subject, (outcome > 40)::INT AS y, round(1 / (1 + exp(-a - b * predictor)), 9) AS p FROM trials JOIN ch USING (subject)), k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY p) + (count(*) OVER (PARTITION BY subject, p) - 1) / 2.0 AS r FROM s),
    m AS (SELECT subject, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, avg(power(p - y, 2)) AS brier FROM k GROUP BY subject),
    e AS (SELECT subject, sum(n * g) / sum(n) AS ece FROM (SELECT subject, least(9, floor(p * 10)) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS g FROM s GROUP BY ALL) GROUP BY subject)
    SELECT subject, {r('(rs - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)')} AS auc, {r('(tp / nullif(n1, 0) + tn / nullif(n0, 0)) / 2')} AS balanced, {r('2 * tp / nullif(2 * tp + fp + n1 - tp, 0)')} AS f1, {r('brier')} AS brier, {r('ece')} AS ece FROM m JOIN e USING (subject)"""

QUERIES = {
    "m9_elastic_net": (_elastic, _recursive(sql("wide", descent_sql([(0.01, 0.5)]) + f" SELECT condition, count(*) AS n, {r('avg(abs(price - guess))', 4)} AS mae, {r('sqrt(avg(power(price - guess, 2)))', 4)} AS rmse, {r('1 - sum(power(price - guess, 2)) / nullif(var_pop(price) * count(*), 0)', 4)} AS r2 FROM te GROUP BY condition"))),
    "m9_grid_regression": (_grid, _recursive(sql("wide", descent_sql(GRID) + f" SELECT pen AS penalty, mix, count(*) AS n, {r('avg(guess)', 2)} AS prediction FROM te GROUP BY ALL"))),
    "m14_nested_net": (_nested, sql("trials", NESTED + f" SELECT subject, pen AS penalty, mix, {r('my - b * mx')} AS intercept, {r('b')} AS slope FROM f JOIN w USING (subject, place) WHERE k = -1")),
    "m19_net_permutation": (_permuted, sql("trials", PERMUTED + f" SELECT {r('any_value(o.r)')} AS observed, count(c.r) AS n_perm, count(*) FILTER (abs(c.r) >= abs(o.r) - 1e-12) AS extreme, {r('(count(*) FILTER (abs(c.r) >= abs(o.r) - 1e-12) + 1) / (count(*) + 1)')} AS p FROM c, (SELECT r FROM c WHERE perm = -1) o WHERE perm >= 0")),
    "m20_net_comparison": (_compared, sql("trials", COMPARED + f" SELECT 'net' AS ma, 'mean' AS mb, {r('any_value(o.stat)')} AS difference, {r('(count(*) FILTER (abs(s.stat) >= abs(o.stat) - 1e-12) + 1) / (count(*) + 1)')} AS p, {r('(count(*) FILTER (abs(s.stat) >= abs(o.stat) - 1e-12) + 1) / (count(*) + 1)')} AS p_holm FROM s JOIN s o ON o.pat = 0")),
    "m14_nested_logistic": (_weights, sql("trials", newton_sql() + f" SELECT subject, strength, {r('a')} AS intercept, {r('b')} AS slope FROM ch")),
    "m29_classification_run": (_run, sql("trials", newton_sql() + METRICS)),
}
