"""Queries of spectra over their robust 1/f line: peaks by prominence, individual and fold alpha, aperiodic fit, periodic measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spectra as op
from ..sources.tables import r, rounded, sql

BANDS = ("theta_low", "theta_high", "alpha_low", "alpha_high", "beta_low", "beta_high")


def _round(df, *columns, keep=()):
    return df.select(*keep, *(rounded(c).alias(c) for c in columns))


def robust_sql(source: str, key: str, rounds: int, z: float) -> str:
    """Tables ``k0 ... k<rounds>`` of kept bins, ``l<i>`` of their lines, ``l`` of the last one and ``q`` of all residuals."""
    out = [f", pts AS (SELECT {key}, freq, power, log10(greatest(freq, 1e-6)) AS x, log10(greatest(power, 1e-20)) AS y FROM {source}), k0 AS (SELECT * FROM pts WHERE freq BETWEEN 2 AND 40)"]
    for n in range(1, rounds + 1):
        out.append(
            f"l{n} AS (SELECT {key}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k{n - 1} GROUP BY {key}), "
            f"e{n} AS (SELECT *, y - a - b * x AS res, median(y - a - b * x) OVER w AS m FROM k{n - 1} JOIN l{n} USING ({key}) WINDOW w AS (PARTITION BY {key})), "
            f"d{n} AS (SELECT *, 1.482602218505602 * median(abs(res - m)) OVER w AS mad, max(res) OVER w AS top FROM e{n} WINDOW w AS (PARTITION BY {key})), "
            f"n{n} AS (SELECT *, count(*) FILTER (res <= {z} * mad) OVER (PARTITION BY {key}) AS left_over FROM d{n}), "
            f"k{n} AS (SELECT {key}, freq, power, x, y FROM n{n} WHERE NOT (top > 0 AND mad >= 1e-12 AND left_over >= 5) OR res <= {z} * mad)"
        )
    out.append(f"l AS (SELECT {key}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k{rounds} GROUP BY {key}), q AS (SELECT pts.*, a, b, y - a - b * x AS v FROM pts JOIN l USING ({key}))")
    return ", ".join(out)


def prominence_sql(source: str, key: str) -> str:
    """Table ``pr`` of the local maxima of ``source`` (``key, freq, v``) and their prominence, by a self join on the bins."""
    return (
        f", w AS (SELECT {key}, freq, v, row_number() OVER o AS i, lag(v) OVER o AS pv, lead(v) OVER o AS nv FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY freq)), "
        f"pk AS (SELECT * FROM w WHERE pv < v AND nv < v), "
        f"hl AS (SELECT p.{key}, p.i, coalesce(max(q.i) FILTER (q.i < p.i AND q.v > p.v), 0) AS lo, coalesce(min(q.i) FILTER (q.i > p.i AND q.v > p.v), 9999) AS hi FROM pk p JOIN w q ON q.{key} = p.{key} GROUP BY ALL), "
        f"pr AS (SELECT p.{key}, p.i, p.freq, p.v, any_value(p.v) - greatest(min(q.v) FILTER (q.i <= p.i), min(q.v) FILTER (q.i >= p.i)) AS prominence FROM pk p JOIN hl ON hl.{key} = p.{key} AND hl.i = p.i JOIN w q ON q.{key} = p.{key} AND q.i > lo AND q.i < hi GROUP BY ALL)"
    )


def alpha_sql(source: str, key: str) -> str:
    head = robust_sql(source, key, 2, 2.5) + f", q7 AS (SELECT {key}, freq, v FROM q WHERE freq BETWEEN 7 AND 13)" + prominence_sql("q7", key)
    return head + (
        f", best AS (SELECT {key}, freq, prominence FROM pr WHERE prominence >= 0.05 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY prominence DESC, freq) = 1), "
        f"c AS (SELECT {key}, sum(freq * greatest(v, 0)) / nullif(sum(greatest(v, 0)), 0) AS centre FROM q7 GROUP BY {key}), "
        f"iaf AS (SELECT {key}, coalesce(best.freq, centre) AS iaf, prominence FROM c LEFT JOIN best USING ({key})) "
        f"SELECT {key}, {r('iaf')} AS iaf, {r('prominence')} AS prominence, {r('greatest(3, iaf - 6)')} AS theta_low, {r('greatest(4, greatest(6, iaf - 2))')} AS theta_high, {r('greatest(6, iaf - 2)')} AS alpha_low, "
        f"{r('least(14, iaf + 2)')} AS alpha_high, {r('greatest(13, least(14, iaf + 2))')} AS beta_low, CASE WHEN iaf IS NOT NULL THEN 30.0::DOUBLE END AS beta_high FROM iaf"
    )


def _fold(i):
    return _round(op.fold_alpha(i.psd, "subject"), "iaf", "prominence", *BANDS, keep=("subject",))


PEAK = (
    robust_sql("psd", "trial_id", 2, 2.5)
    + """, n AS (SELECT trial_id, freq, power, x, a, b, v, power(10, v) AS ratio FROM q WHERE freq BETWEEN 8 AND 20),
    t AS (SELECT *, median(v) OVER w AS mid, row_number() OVER (PARTITION BY trial_id ORDER BY ratio DESC, freq) AS k, sum(freq * ratio) OVER w / sum(ratio) OVER w AS gravity FROM n WINDOW w AS (PARTITION BY trial_id)),
    f AS (SELECT trial_id, CASE WHEN v - mid < 0.1 THEN gravity ELSE freq END AS peak_freq FROM t WHERE k = 1),
    g AS (SELECT trial_id, peak_freq, power, a + b * x AS fit FROM f JOIN n USING (trial_id) QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY abs(freq - peak_freq), freq) = 1)"""
)

# the rejected bins with a positive residual over the line that the last round rejected by, in runs; apex, and width at half prominence
PERIODIC = (
    robust_sql("(SELECT * FROM psd WHERE freq BETWEEN 2 AND 40)", "trial_id", 3, 3.5)
    + """, o AS (SELECT pts.trial_id, pts.freq, y - l3.a - l3.b * x AS res, greatest(y - l3.a - l3.b * x, 0) AS v, row_number() OVER (PARTITION BY pts.trial_id ORDER BY pts.freq) AS i FROM pts JOIN l3 USING (trial_id)),
    u AS (SELECT o.* FROM o ANTI JOIN k3 ON o.trial_id = k3.trial_id AND o.freq = k3.freq WHERE res > 0),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY trial_id ORDER BY i) AS run FROM u),
    p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY trial_id, run ORDER BY v DESC, i) = 1),
    c AS (SELECT * FROM p WHERE freq BETWEEN 8 AND 30 QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY v DESC, i) = 1),
    h AS (SELECT c.trial_id, c.i, coalesce(max(o.i) FILTER (o.i < c.i AND o.v > c.v), 0) AS lo, coalesce(min(o.i) FILTER (o.i > c.i AND o.v > c.v), 9999) AS hi FROM c JOIN o ON o.trial_id = c.trial_id GROUP BY ALL),
    m AS (SELECT c.trial_id, c.i, c.freq, c.v, any_value(c.v) - (any_value(c.v) - greatest(min(o.v) FILTER (o.i <= c.i), min(o.v) FILTER (o.i >= c.i))) / 2 AS half FROM c JOIN h ON h.trial_id = c.trial_id JOIN o ON o.trial_id = c.trial_id AND o.i > lo AND o.i < hi GROUP BY ALL),
    s AS (SELECT m.trial_id, m.freq, m.v, half, m.i, max(o.i) FILTER (o.i <= m.i AND o.v <= half) AS l, min(o.i) FILTER (o.i >= m.i AND o.v <= half) AS r FROM m JOIN o ON o.trial_id = m.trial_id GROUP BY ALL),
    b AS (SELECT s.trial_id, s.freq AS center, s.v AS height, CASE WHEN half < s.v THEN (r0.freq + (half - r0.v) / (r1.v - r0.v) * (r1.freq - r0.freq)) - (l0.freq + (half - l0.v) / (l1.v - l0.v) * (l1.freq - l0.freq)) ELSE 0 END AS width
        FROM s LEFT JOIN o l0 ON l0.trial_id = s.trial_id AND l0.i = s.l LEFT JOIN o l1 ON l1.trial_id = s.trial_id AND l1.i = s.l + 1 LEFT JOIN o r0 ON r0.trial_id = s.trial_id AND r0.i = s.r LEFT JOIN o r1 ON r1.trial_id = s.trial_id AND r1.i = s.r - 1),
    z AS (SELECT trial_id, avg(power(10, v)) FILTER (freq BETWEEN 4 AND 7.9) / avg(power(10, v)) FILTER (freq BETWEEN 13 AND 30) AS tb, avg(power) FILTER (freq BETWEEN 4 AND 7.9) / avg(power) FILTER (freq BETWEEN 13 AND 30) AS raw,
        avg(power(10, v)) FILTER (freq BETWEEN 8 AND 30) AS corrected FROM q GROUP BY trial_id)"""
)

QUERIES = {
    "f6_peak_frequency": (lambda i: _round(op.peak_frequency(i.psd, ["trial_id"], 8.0, 20.0), "peak_freq", "peak_power", "peak_ratio", "peak_residual", keep=("trial_id",)), sql("psd", PEAK + f" SELECT trial_id, {r('peak_freq')} AS peak_freq, {r('power')} AS peak_power, {r('power / power(10, fit)')} AS peak_ratio, {r('log10(power) - fit')} AS peak_residual FROM g")),
    "f7_aperiodic": (lambda i: _round(op.aperiodic_fit(i.psd, ["trial_id"]), "offset", "exponent", "r2", "rms", keep=("trial_id", "n_valid", "n_kept")), sql("psd", robust_sql("psd", "trial_id", 3, 3.5) + f", v AS (SELECT trial_id, count(*)::INT AS n_valid FROM k0 GROUP BY trial_id), f AS (SELECT trial_id, count(*)::INT AS n_kept, any_value(a) AS a, any_value(b) AS b, sum(power(y - a - b * x, 2)) AS ss, var_pop(y) * count(*) AS st FROM k3 JOIN l USING (trial_id) GROUP BY trial_id) SELECT trial_id, n_valid, n_kept, {r('a')} AS \"offset\", {r('-b')} AS exponent, {r('1 - ss / st')} AS r2, {r('sqrt(ss / n_kept)')} AS rms FROM f JOIN v USING (trial_id)")),
    "f8_periodic_peaks": (lambda i: _round(op.periodic_measures(i.psd, ["trial_id"], (8.0, 30.0)), "center", "height", "bandwidth", "theta_beta", "theta_beta_raw", "corrected_power", keep=("trial_id",)), sql("psd", PERIODIC + f" SELECT trial_id, {r('center')} AS center, {r('height')} AS height, {r('CASE WHEN center IS NOT NULL THEN greatest(width, 1e-6) END')} AS bandwidth, {r('tb')} AS theta_beta, {r('raw')} AS theta_beta_raw, {r('corrected')} AS corrected_power FROM z LEFT JOIN b USING (trial_id)")),
    "f9_subject_alpha": (lambda i: _round(op.individual_alpha(i.psd, ["subject"]), "iaf", "prominence", *BANDS, keep=("subject",)), sql("psd", ", g AS (SELECT subject, freq, avg(power) AS power FROM psd GROUP BY ALL)" + alpha_sql("g", "subject"))),
    "f10_fold_peak": (_fold, sql("psd", ", s AS (SELECT DISTINCT subject FROM psd), g AS (SELECT s.subject, freq, avg(power) AS power FROM s JOIN psd ON psd.subject <> s.subject GROUP BY ALL)" + alpha_sql("g", "subject"))),
    "f6_prominent_peaks": (lambda i: _round(op.prominent_peaks(i.psd, ["trial_id"], "freq", "power", 0.01), "power", "prominence", keep=("trial_id", "freq")), sql("psd", ", s AS (SELECT trial_id, freq, power AS v FROM psd)" + prominence_sql("s", "trial_id") + f" SELECT trial_id, freq, {r('v')} AS power, {r('prominence')} AS prominence FROM pr WHERE prominence >= 0.01")),
}
