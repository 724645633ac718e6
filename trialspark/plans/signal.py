"""Queries of the signal features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as op
from ..operators import windows as win
from ..sources.tables import r, rounded, sql
from .windows import BAND_SQL, SEGMENTS, band_table


def _round(df, *columns, keep=()):
    return df.select(*keep, *(rounded(c).alias(c) for c in columns))


def _tfr_segments(i):
    return win.time_mask(i.tfr, win.segments(i.spark, SEGMENTS[:2])).groupBy("trial_id", "freq", "segment").agg(F.avg("power").alias("power"))


def _ratios(i):
    p = op.band_power(i.psd, band_table(i.spark), ["trial_id"])
    side = lambda b: F.max(F.when(F.col("band") == b, F.col("power")))
    t = p.groupBy("trial_id").agg(side("low").alias("low"), side("high").alias("high"))
    return t.select("trial_id", rounded(F.col("low") / F.col("high")).alias("ratio"), rounded(F.ln(F.col("low") / F.col("high"))).alias("log_ratio"))


BP = """, i AS (SELECT trial_id, band, freq, power FROM psd JOIN {b} ON freq BETWEEN f0 AND f1),
    d AS (SELECT *, (coalesce(lead(freq) OVER w, freq) - coalesce(lag(freq) OVER w, freq)) / 2 AS df FROM i WINDOW w AS (PARTITION BY trial_id, band ORDER BY freq)),
    p AS (SELECT trial_id, band, sum(power * df) / sum(df) AS power FROM d GROUP BY ALL)""".format(b=BAND_SQL)


def _asymmetry(i):
    p = i.samples.groupBy("trial_id", "channel").agg(F.avg(F.col("x") * F.col("x")).alias("p"))
    pair = i.spark.createDataFrame([(0, 7), (1, 6), (2, 5)], "l int, r int")
    both = p.join(F.broadcast(pair), F.col("channel") == F.col("l")).select("trial_id", "l", "r", F.col("p").alias("pl")).join(p.select("trial_id", F.col("channel").alias("r"), F.col("p").alias("pr")), ["trial_id", "r"])
    return both.select("trial_id", "l", "r", rounded((F.col("pr") - F.col("pl")) / (F.col("pr") + F.col("pl"))).alias("asymmetry"), rounded(F.ln("pr") - F.ln("pl")).alias("log_difference"))


def _erp(i):
    base = win.baseline_correct(i.samples, "x", ["trial_id", "channel"], F.col("t") < 0, "mean").where("t >= 0")
    return base.groupBy("trial_id", "channel").agg(rounded(F.avg("corrected")).alias("mean"), rounded(F.max("corrected")).alias("peak"), rounded(F.min("corrected")).alias("trough"))


def _erds(i):
    base = win.baseline_correct(i.tfr, "power", ["trial_id", "freq"], F.col("t") < 0, "percent").where("t >= 0")
    return base.groupBy("trial_id", "freq").agg(rounded(F.avg("corrected"), 3).alias("erds"), rounded(F.regr_slope("corrected", "t"), 2).alias("slope"))


def _quality(i):
    x = F.col("x")
    return i.samples.groupBy("trial_id", "channel").agg(rounded(F.var_pop("x")).alias("variance"), rounded(F.max("x") - F.min("x")).alias("ptp"), rounded(F.count("x") / F.count(F.lit(1))).alias("finite"), rounded(F.sqrt(F.avg(x * x))).alias("rms"))


def _artifact(i):
    p = op.pairs(i.samples, ["trial_id", "t"], "channel", ["x"]).where("b = 7")
    c = p.groupBy("trial_id", "a").agg(win.moment_corr(F.col("x_a"), F.col("x_b")).alias("r"))
    return c.groupBy("trial_id").agg(rounded(F.avg(F.abs("r"))).alias("mean_abs_r"))


CROSS = """, p AS (SELECT x.trial_id, x.channel AS a, y.channel AS b, x.t, x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im, x.re * x.re + x.im * x.im AS pa, y.re * y.re + y.im * y.im AS pb
    FROM analytic x JOIN analytic y ON x.trial_id = y.trial_id AND x.t = y.t AND x.channel < y.channel)"""
UNIT = ", u AS (SELECT *, re / sqrt(re * re + im * im) AS c, im / sqrt(re * re + im * im) AS s FROM analytic)"


def _dynamic(i):
    half = i.analytic.withColumn("window", F.floor(F.col("t") / 4).cast("int"))
    c = op.phase_connectivity(half, ["trial_id", "window"])
    return c.groupBy("trial_id", "a", "b").agg(rounded(F.avg("wpli")).alias("mean"), rounded(F.stddev_pop("wpli")).alias("std"))


def _comodulogram(i):
    out = [op.phase_amplitude(i.analytic, ["trial_id"], p, a).select("trial_id", F.lit(p).alias("phase"), F.lit(a).alias("amplitude"), rounded("pac").alias("pac")) for p in (0, 1) for a in (2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


PAC = "SELECT x.trial_id, x.channel AS phase, y.channel AS amplitude, sum(sqrt(y.re * y.re + y.im * y.im) * x.c) AS c, sum(sqrt(y.re * y.re + y.im * y.im) * x.s) AS s, sum(sqrt(y.re * y.re + y.im * y.im)) AS m, count(*) AS n FROM u x JOIN analytic y ON x.trial_id = y.trial_id AND x.t = y.t"

# segments 0-3, 2-5 and 4-7 less their mean under a periodic Hann window of 4 (0, 0.5, 1, 0.5), by the plain transform
WELCH = """, g AS (SELECT trial_id, channel, s, x - avg(x) OVER (PARTITION BY trial_id, channel, s) AS x, sample_idx - s AS n FROM samples, (SELECT unnest([0, 2, 4]) AS s) WHERE sample_idx >= s AND sample_idx < s + 4),
    d AS (SELECT trial_id, channel, s, k, sum(x * [0.0, 0.5, 1.0, 0.5][n + 1] * cos(2 * pi() * k * n / 4)) AS re, sum(x * [0.0, 0.5, 1.0, 0.5][n + 1] * sin(2 * pi() * k * n / 4)) AS im FROM g, (SELECT unnest(range(3)) AS k) GROUP BY ALL)"""
# eight samples at 8 Hz: whole frequencies k, of which 1 to 3 are kept twofold
BAND = """, d AS (SELECT trial_id, channel, k, sum(x * cos(2 * pi() * k * sample_idx / 8)) AS a, -sum(x * sin(2 * pi() * k * sample_idx / 8)) AS b FROM samples, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL),
    z AS (SELECT trial_id, channel, n AS sample_idx, sum(a * cos(2 * pi() * k * n / 8) - b * sin(2 * pi() * k * n / 8)) / 4 AS re, sum(a * sin(2 * pi() * k * n / 8) + b * cos(2 * pi() * k * n / 8)) / 4 AS im FROM d, (SELECT unnest(range(8)) AS n) GROUP BY ALL)"""
# the parse, one bit a step: the phrase so far and the list of those seen
PHRASES = f""", m AS (SELECT trial_id, channel, sample_idx AS i, CASE WHEN x > median(x) OVER (PARTITION BY trial_id, channel) THEN '1' ELSE '0' END AS bit FROM samples),
    w AS (SELECT trial_id, channel, string_agg(bit, '' ORDER BY i) AS bits FROM m GROUP BY ALL),
    p AS (SELECT trial_id, channel, bits, 0 AS i, '' AS phrase, []::VARCHAR[] AS seen FROM w
        UNION ALL SELECT trial_id, channel, bits, i + 1, CASE WHEN list_contains(seen, phrase || bits[i + 1]) THEN phrase || bits[i + 1] ELSE '' END, CASE WHEN list_contains(seen, phrase || bits[i + 1]) THEN seen ELSE list_append(seen, phrase || bits[i + 1]) END FROM p WHERE i < length(bits))
    SELECT trial_id, channel, {r('(len(seen) + (length(phrase) > 0)::INT) / (length(bits) / log2(length(bits)))')} AS complexity FROM p WHERE i = length(bits)"""

QUERIES = {
    "f1_welch": (lambda i: op.welch(i.samples, ["trial_id", "channel"], 8.0, 4).select("trial_id", "channel", "freq", rounded("power").alias("power")), sql("samples", WELCH + f" SELECT trial_id, channel, k * 2.0::DOUBLE AS freq, {r('avg(re * re + im * im) / (8 * 1.5) * CASE WHEN k = 1 THEN 2 ELSE 1 END')} AS power FROM d GROUP BY trial_id, channel, k")),
    "f2_analytic_band": (lambda i: op.analytic_band(i.samples, ["trial_id", "channel"], 8.0, 1.0, 3.0).select("trial_id", "channel", "sample_idx", rounded("re").alias("re"), rounded("im").alias("im")), sql("samples", BAND + f" SELECT trial_id, channel, sample_idx::INT AS sample_idx, {r('re')} AS re, {r('im')} AS im FROM z")),
    "f3_band_power": (lambda i: _round(op.band_power(i.psd, band_table(i.spark), ["trial_id"]), "power", keep=("trial_id", "band")), sql("psd", BP + f" SELECT trial_id, band, {r('power')} AS power FROM p")),
    "f4_relative_power": (lambda i: _round(op.relative_power(_tfr_segments(i), ["trial_id", "freq"], "segment", "base"), "logratio", "db", "log10raw", keep=("trial_id", "freq", "segment")), sql("tfr", f", m AS (SELECT trial_id, freq, greatest(avg(power) FILTER (t < 0), 1e-20) AS b, greatest(avg(power) FILTER (t >= 0 AND t < 0.375), 1e-20) AS p FROM tfr GROUP BY ALL) SELECT trial_id, freq, 'early' AS segment, {r('log10(p / b)')} AS logratio, {r('10 * log10(p / b)')} AS db, {r('log10(p)')} AS log10raw FROM m")),
    "f5_spectral_shape": (lambda i: _round(op.spectral_shape(i.psd, ["trial_id"]), "centre", "edge", "entropy", "bandwidth", keep=("trial_id",)), sql("psd", f", m AS (SELECT *, power * (CASE WHEN freq IN (1, 64) THEN 1.0 ELSE 1.0 END) AS m, sum(power) OVER (PARTITION BY trial_id) AS s, sum(power) OVER (PARTITION BY trial_id ORDER BY freq) AS acc FROM psd) SELECT trial_id, {r('sum(freq * power / s)')} AS centre, {r('min(freq) FILTER (acc >= 0.95 * s)')} AS edge, {r('-sum(power / s * ln(power / s)) / ln(64)')} AS entropy, {r('sqrt(sum(freq * freq * power / s) - power(sum(freq * power / s), 2))')} AS bandwidth FROM m GROUP BY trial_id")),
    "f11_erp": (_erp, sql("samples", f", b AS (SELECT *, x - avg(x) FILTER (t < 0) OVER (PARTITION BY trial_id, channel) AS c FROM samples) SELECT trial_id, channel, {r('avg(c)')} AS mean, {r('max(c)')} AS peak, {r('min(c)')} AS trough FROM b WHERE t >= 0 GROUP BY ALL")),
    "f12_erds": (_erds, sql("tfr", f", b AS (SELECT *, 100 * (power / avg(power) FILTER (t < 0) OVER (PARTITION BY trial_id, freq) - 1) AS c FROM tfr) SELECT trial_id, freq, {r('avg(c)', 3)} AS erds, {r('regr_slope(c, t)', 2)} AS slope FROM b WHERE t >= 0 GROUP BY ALL")),
    "f14_band_ratios": (_ratios, sql("psd", BP + f", q AS (SELECT trial_id, max(power) FILTER (band = 'low') AS l, max(power) FILTER (band = 'high') AS h FROM p GROUP BY trial_id) SELECT trial_id, {r('l / h')} AS ratio, {r('ln(l / h)')} AS log_ratio FROM q")),
    "f15_asymmetry": (_asymmetry, sql("samples", f", p AS (SELECT trial_id, channel, avg(x * x) AS p FROM samples GROUP BY ALL) SELECT a.trial_id, v.l, v.r, {r('(b.p - a.p) / (b.p + a.p)')} AS asymmetry, {r('ln(b.p) - ln(a.p)')} AS log_difference FROM (VALUES (0, 7), (1, 6), (2, 5)) v(l, r) JOIN p a ON a.channel = v.l JOIN p b ON b.channel = v.r AND a.trial_id = b.trial_id")),
    "f16_gfp": (lambda i: _round(op.global_field_power(i.samples), "gfp", keep=("trial_id", "t")), sql("samples", f"SELECT trial_id, t, {r('stddev_pop(x)')} AS gfp FROM samples GROUP BY ALL")),
    "f17_subtract_evoked": (lambda i: _round(op.subtract_evoked(i.samples, ["subject", "condition", "channel", "t"], F.col("trial_id") % 4 > 0), "induced", keep=("trial_id", "channel", "t")), sql("samples", f"SELECT trial_id, channel, t, {r('x - coalesce(avg(x) FILTER (trial_id % 4 > 0) OVER (PARTITION BY subject, condition, channel, t), 0)')} AS induced FROM samples")),
    "f18_bursts": (lambda i: _round(op.bursts(i.trials, ["subject"], "outcome", "trial_id", 0.5, 2), "mean_length", "fraction", keep=("subject", "bursts")), sql("trials", f", a AS (SELECT subject, trial_id, outcome > avg(outcome) OVER w + 0.5 * stddev_pop(outcome) OVER w AS f FROM trials WINDOW w AS (PARTITION BY subject)), g AS (SELECT *, trial_id - row_number() OVER (PARTITION BY subject, f ORDER BY trial_id) AS g FROM a), i AS (SELECT subject, f, count(*) AS n FROM g GROUP BY subject, f, g) SELECT subject, count(*) FILTER (f AND n >= 2) AS bursts, {r('avg(n) FILTER (f AND n >= 2)')} AS mean_length, {r('coalesce(sum(n) FILTER (f), 0) / sum(n)')} AS fraction FROM i GROUP BY subject")),
    "f19_permutation_entropy": (lambda i: _round(op.permutation_entropy(i.trials, ["subject"], "outcome", "trial_id"), "entropy", keep=("subject",)), sql("trials", f", e AS (SELECT subject, outcome AS x, lead(outcome, 1) OVER w AS y, lead(outcome, 2) OVER w AS z FROM trials WINDOW w AS (PARTITION BY subject ORDER BY trial_id)), c AS (SELECT subject, x <= y AS a, y <= z AS b, x <= z AS c, count(*) AS n FROM e WHERE z IS NOT NULL GROUP BY ALL), p AS (SELECT subject, n / sum(n) OVER (PARTITION BY subject) AS p FROM c) SELECT subject, {r('-sum(p * ln(p)) / ln(6.0)')} AS entropy FROM p GROUP BY subject")),
    "f20_sample_entropy": (lambda i: _round(op.sample_entropy(i.trials, ["subject"], "outcome", "trial_id"), "entropy", keep=("subject", "a", "b")), sql("trials", f", e AS (SELECT subject, trial_id AS i, outcome AS x0, lead(outcome, 1) OVER w AS x1, lead(outcome, 2) OVER w AS x2, stddev_pop(outcome) OVER (PARTITION BY subject) * 0.2 AS r FROM trials WINDOW w AS (PARTITION BY subject ORDER BY trial_id)), f AS (SELECT * FROM e WHERE x2 IS NOT NULL), m AS (SELECT f.subject, count(*) FILTER (abs(f.x0 - g.x0) <= f.r AND abs(f.x1 - g.x1) <= f.r AND abs(f.x2 - g.x2) <= f.r) AS a, count(*) FILTER (abs(f.x0 - g.x0) <= f.r AND abs(f.x1 - g.x1) <= f.r) AS b FROM f JOIN f g ON f.subject = g.subject AND f.i < g.i GROUP BY f.subject) SELECT subject, a, b, CASE WHEN a > 0 AND b > 0 THEN {r('-ln(a / b)')} END AS entropy FROM m")),
    "f20_multiscale_entropy": (lambda i: _round(op.multiscale_entropy(i.trials, ["subject"], "outcome", "trial_id", [1, 2, 3]), "entropy", keep=("subject", "scale", "a", "b")), sql("trials", f", g AS (SELECT subject, s AS scale, (trial_id - 1) // s AS i, avg(outcome) AS x FROM trials, (SELECT unnest([1, 2, 3]) AS s) GROUP BY ALL HAVING count(*) = s), e AS (SELECT subject, scale, i, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, stddev_pop(x) OVER (PARTITION BY subject, scale) * 0.2 AS r FROM g WINDOW w AS (PARTITION BY subject, scale ORDER BY i)), f AS (SELECT * FROM e WHERE x2 IS NOT NULL), m AS (SELECT f.subject, f.scale, count(*) FILTER (abs(f.x0 - g.x0) <= f.r AND abs(f.x1 - g.x1) <= f.r AND abs(f.x2 - g.x2) <= f.r) AS a, count(*) FILTER (abs(f.x0 - g.x0) <= f.r AND abs(f.x1 - g.x1) <= f.r) AS b FROM f JOIN f g ON f.subject = g.subject AND f.scale = g.scale AND f.i < g.i GROUP BY ALL) SELECT subject, scale, a, b, CASE WHEN a > 0 AND b > 0 THEN {r('-ln(a / b)')} END AS entropy FROM m")),
    "f21_lempel_ziv": (lambda i: _round(op.lempel_ziv(i.samples, ["trial_id", "channel"]), "complexity", keep=("trial_id", "channel")), sql("samples", PHRASES).replace("WITH ", "WITH RECURSIVE ", 1)),
    "f22_quality": (_quality, sql("samples", f"SELECT trial_id, channel, {r('var_pop(x)')} AS variance, {r('max(x) - min(x)')} AS ptp, 1.0::DOUBLE AS finite, {r('sqrt(avg(x * x))')} AS rms FROM samples GROUP BY ALL")),
    "f23_artifact_correlation": (_artifact, sql("samples", f", c AS (SELECT a.trial_id, a.channel, corr(a.x, b.x) AS r FROM samples a JOIN samples b ON a.trial_id = b.trial_id AND a.t = b.t AND b.channel = 7 WHERE a.channel < 7 GROUP BY ALL) SELECT trial_id, {r('avg(abs(r))')} AS mean_abs_r FROM c GROUP BY trial_id")),
    "f24_phase_connectivity": (lambda i: _round(op.phase_connectivity(i.analytic, ["trial_id"]), "wpli", "pli", "plv", "icoh", keep=("trial_id", "a", "b")), sql("analytic", CROSS + f" SELECT trial_id, a, b, {r('abs(avg(im)) / avg(abs(im))')} AS wpli, {r('abs(avg(sign(im)))')} AS pli, {r('sqrt(power(avg(re / sqrt(re * re + im * im)), 2) + power(avg(im / sqrt(re * re + im * im)), 2))')} AS plv, {r('avg(im) / sqrt(avg(pa) * avg(pb))')} AS icoh FROM p GROUP BY ALL")),
    "f25_envelope_correlation": (lambda i: _round(op.envelope_correlation(i.analytic, ["trial_id"]), "aec", keep=("trial_id", "a", "b")), sql("analytic", CROSS + f" SELECT trial_id, a, b, {r('atanh(greatest(-0.999999, least(0.999999, corr(sqrt(pa), sqrt(pb)))))')} AS aec FROM p GROUP BY ALL")),
    "f26_dynamic_connectivity": (_dynamic, sql("analytic", CROSS + f", w AS (SELECT trial_id, t // 4 AS w, a, b, abs(avg(im)) / avg(abs(im)) AS wpli FROM p GROUP BY ALL) SELECT trial_id, a, b, {r('avg(wpli)')} AS mean, {r('stddev_pop(wpli)')} AS std FROM w GROUP BY ALL")),
    "f28_region_connectivity": (lambda i: op.phase_connectivity(i.analytic, ["trial_id"]).groupBy("trial_id", F.floor(F.col("a") / 2).cast("int").alias("roi_a"), F.floor(F.col("b") / 2).cast("int").alias("roi_b")).agg(rounded(F.avg("plv")).alias("plv")), sql("analytic", CROSS + f", c AS (SELECT trial_id, a, b, sqrt(power(avg(re / sqrt(re * re + im * im)), 2) + power(avg(im / sqrt(re * re + im * im)), 2)) AS plv FROM p GROUP BY ALL) SELECT trial_id, a // 2 AS roi_a, b // 2 AS roi_b, {r('avg(plv)')} AS plv FROM c GROUP BY ALL")),
    "f30_threshold_graph": (lambda i: op.threshold_graph(op.phase_connectivity(i.analytic, ["trial_id"]).select("trial_id", "a", "b", F.round("plv", 9).alias("w")), ["trial_id"], 0.5).select("trial_id", "a", "b", rounded("w").alias("w")), sql("analytic", CROSS + f", c AS (SELECT trial_id, a, b, round(sqrt(power(avg(re / sqrt(re * re + im * im)), 2) + power(avg(im / sqrt(re * re + im * im)), 2)), 9) AS w FROM p GROUP BY ALL), q AS (SELECT trial_id, quantile_cont(w, 0.5) AS q FROM c GROUP BY trial_id) SELECT trial_id, a, b, {r('w')} AS w FROM c JOIN q USING (trial_id) WHERE w >= q")),
    "f32_phase_locking": (lambda i: _round(op.phase_locking(i.analytic, ["subject", "channel", "t"]), "itpc", "loo", keep=("trial_id", "channel", "t")), sql("analytic", UNIT + f" SELECT trial_id, channel, t, {r('sqrt(power(sum(c) OVER w, 2) + power(sum(s) OVER w, 2)) / count(*) OVER w')} AS itpc, CASE WHEN count(*) OVER w > 1 THEN {r('sqrt(power(sum(c) OVER w - c, 2) + power(sum(s) OVER w - s, 2)) / (count(*) OVER w - 1)')} END AS loo FROM u WINDOW w AS (PARTITION BY subject, channel, t)")),
    "f33_phase_alignment": (lambda i: _round(op.phase_locking(i.analytic, ["subject", "channel", "t"]), "alignment", keep=("trial_id", "channel", "t")), sql("analytic", UNIT + f" SELECT trial_id, channel, t, {r('cos(atan2(s, c) - atan2(sum(s) OVER w, sum(c) OVER w))')} AS alignment FROM u WINDOW w AS (PARTITION BY subject, channel, t)")),
    "f34_phase_amplitude": (lambda i: _round(op.phase_amplitude(i.analytic, ["trial_id"], 0, 1), "pac", "pac_raw", keep=("trial_id",)), sql("analytic", UNIT + f", p AS ({PAC} WHERE x.channel = 0 AND y.channel = 1 GROUP BY ALL) SELECT trial_id, {r('sqrt(c * c + s * s) / m')} AS pac, {r('sqrt(c * c + s * s) / n')} AS pac_raw FROM p")),
    "f36_comodulogram": (_comodulogram, sql("analytic", UNIT + f", p AS ({PAC} WHERE x.channel IN (0, 1) AND y.channel IN (2, 3) GROUP BY ALL) SELECT trial_id, phase::INT AS phase, amplitude::INT AS amplitude, {r('sqrt(c * c + s * s) / m')} AS pac FROM p")),
    "f37_harmonic_overlap": (lambda i: op.harmonic_overlap(i.psd.groupBy("subject").agg(F.max("freq").alias("f")).select(F.concat(F.lit("s"), "subject").alias("band"), (F.col("subject") + 1.0).alias("f0"), (F.col("subject") + 1.0 + F.col("f") / 64).alias("f1")), 3, 0.1), sql("psd", ", b AS (SELECT 's' || subject AS band, subject + 1.0 AS f0, subject + 1.0 + max(freq) / 64 AS f1 FROM psd GROUP BY subject) SELECT p.band AS phase, a.band AS amplitude, bool_or(p.f0 * k - 0.1 <= a.f1 AND p.f1 * k + 0.1 >= a.f0) AS overlap FROM b p, b a, (VALUES (2), (3)) h(k) WHERE p.band <> a.band GROUP BY ALL")),
    "f40_windowed_erds": (lambda i: win.baseline_correct(i.tfr, "power", ["trial_id", "freq"], F.col("t") < 0.25, "zscore").where("t >= 0.25").groupBy("trial_id").agg(rounded(F.avg("corrected"), 3).alias("z")), sql("tfr", f", b AS (SELECT trial_id, t, (power - avg(power) FILTER (t < 0.25) OVER w) / nullif(stddev_pop(power) FILTER (t < 0.25) OVER w, 0) AS z FROM tfr WINDOW w AS (PARTITION BY trial_id, freq)) SELECT trial_id, {r('avg(z)', 3)} AS z FROM b WHERE t >= 0.25 GROUP BY trial_id")),
    "f42_trial_band_power": (lambda i: op.bin_widths(i.tfr.where("t >= 0").groupBy("trial_id", "freq").agg(F.avg("power").alias("power")), ["trial_id"]).groupBy("trial_id").agg(rounded(F.sum(F.col("power") * F.col("df")) / F.sum("df")).alias("power")), sql("tfr", f", m AS (SELECT trial_id, freq, avg(power) AS power FROM tfr WHERE t >= 0 GROUP BY ALL) SELECT trial_id, {r('sum(power * CASE WHEN freq IN (1, 8) THEN 0.5 ELSE 1.0 END) / 7')} AS power FROM m GROUP BY trial_id")),
    "f43_condition_power": (lambda i: i.tfr.groupBy("condition", "freq", "t").agg(rounded(F.avg("power")).alias("power"), F.count(F.lit(1)).alias("n")), sql("tfr", f"SELECT condition, freq, t, {r('avg(power)')} AS power, count(*) AS n FROM tfr GROUP BY ALL")),
}
