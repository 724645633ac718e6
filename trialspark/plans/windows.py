"""Queries of the window, ranking and sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as op
from ..sources.tables import r, rounded, sql

SEGMENTS = [("base", -0.25, 0.0), ("early", 0.0, 0.375), ("late", 0.25, 0.75)]
SEG_SQL = "(VALUES ('base', -0.25, 0.0), ('early', 0.0, 0.375), ('late', 0.25, 0.75)) w(segment, t0, t1)"
BANDS = [("low", 1.0, 3.9), ("mid", 4.0, 12.9), ("high", 13.0, 30.0)]
BAND_SQL = "(VALUES ('low', 1.0, 3.9), ('mid', 4.0, 12.9), ('high', 13.0, 30.0)) b(band, f0, f1)"


def band_table(spark):
    return spark.createDataFrame(BANDS, "band string, f0 double, f1 double")


def _masked(i):
    return op.time_mask(i.samples, op.segments(i.spark, SEGMENTS)).groupBy("trial_id", "channel", "segment").agg(rounded(F.avg("x")).alias("mean"), F.count("x").alias("n"))


def _sliding(i):
    return op.sliding_windows(i.samples, 0.25, 0.125, -0.25, 0.75).groupBy("trial_id", "window").agg(rounded(F.avg("x")).alias("mean"), F.count("x").alias("n"))


def _clamped(i):
    return op.clamped_windows(i.samples, 0.3, -0.25, 0.75).groupBy("trial_id", "window", rounded("w0").alias("w0"), rounded("w1").alias("w1")).agg(rounded(F.sum("x")).alias("total"))


def _freq(i):
    return op.bands(i.psd, band_table(i.spark)).groupBy("trial_id", "band").agg(rounded(F.sum("power")).alias("power"), F.count("power").alias("bins"))


def _rank(i):
    return op.rank_normalise(i.features, "value", ["subject", "feature"]).select("subject", "trial_id", "feature", rounded("scaled").alias("scaled"))


def _norm(method, by):
    return lambda i: op.normalise(i.trials, "outcome", by, method).select("subject", "trial_id", rounded("scaled").alias("scaled"))


def _train(i):
    return op.normalise(i.trials, "outcome", ["subject"], "zscore", F.col("run") < 3).where("run >= 3").select("subject", "trial_id", rounded("scaled").alias("scaled"))


def _within(i):
    m = F.avg("predictor").over(Window.partitionBy("subject"))
    return i.trials.select("subject", "trial_id", rounded(F.col("predictor") - m).alias("within"), rounded(m).alias("between"))


def _order(i):
    w = Window.partitionBy("subject", "run").orderBy("trial_id")
    return i.trials.select("subject", "run", "trial_id", F.row_number().over(w).alias("place"), rounded(F.lag("outcome").over(w)).alias("prev_outcome"), rounded(F.lag("predictor").over(w)).alias("prev_predictor"))


def _monotonic(i):
    before = F.lag("onset").over(Window.partitionBy("subject", "run").orderBy("trial_id"))
    return i.trials.withColumn("up", F.coalesce(F.col("onset") >= before, F.lit(True))).groupBy("subject", "run").agg(F.bool_and("up").alias("monotonic"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "w1_time_windows": (_masked, sql("samples", f"SELECT trial_id, channel, segment, {r('avg(x)')} AS mean, count(x) AS n FROM samples JOIN {SEG_SQL} ON t >= t0 AND t < t1 GROUP BY ALL")),
    "w2_sliding_windows": (_sliding, sql("samples", f'SELECT trial_id, k::INT AS "window", {r("avg(x)")} AS mean, count(x) AS n FROM samples, (SELECT unnest(range(7)) AS k) WHERE t >= -0.25 + k * 0.125 AND t < -0.25 + k * 0.125 + 0.25 GROUP BY ALL')),
    "w3_clamped_windows": (_clamped, sql("samples", f'SELECT trial_id, floor((t + 0.25) / 0.3)::INT AS "window", {r("-0.25 + floor((t + 0.25) / 0.3) * 0.3")} AS w0, {r("least(-0.25 + floor((t + 0.25) / 0.3) * 0.3 + 0.3, 0.75)")} AS w1, {r("sum(x)")} AS total FROM samples GROUP BY ALL')),
    "w4_frequency_bands": (_freq, sql("psd", f"SELECT trial_id, band, {r('sum(power)')} AS power, count(power) AS bins FROM psd JOIN {BAND_SQL} ON freq BETWEEN f0 AND f1 GROUP BY ALL")),
    "w5_rank_normalise": (_rank, sql("features", f"SELECT subject, trial_id, feature, {r('(rank() OVER (PARTITION BY subject, feature ORDER BY value) + (count(*) OVER (PARTITION BY subject, feature, value) - 1) / 2.0 - 1) / nullif(count(*) OVER (PARTITION BY subject, feature) - 1, 0)')} AS scaled FROM features")),
    "w6_zscore_by_run": (_norm("zscore", ["subject", "run"]), sql("trials", f"SELECT subject, trial_id, {r('(outcome - avg(outcome) OVER w) / nullif(stddev_pop(outcome) OVER w, 0)')} AS scaled FROM trials WINDOW w AS (PARTITION BY subject, run)")),
    "w6_robust_by_condition": (_norm("robust", ["subject", "condition"]), sql("trials", f", m AS (SELECT *, median(outcome) OVER (PARTITION BY subject, condition) AS m FROM trials) SELECT subject, trial_id, {r('(outcome - m) / nullif(1.4826 * median(abs(outcome - m)) OVER (PARTITION BY subject, condition), 0)')} AS scaled FROM m")),
    "w6_minmax": (_norm("minmax", ["subject"]), sql("trials", f"SELECT subject, trial_id, {r('(outcome - min(outcome) OVER w) / nullif(max(outcome) OVER w - min(outcome) OVER w, 0)')} AS scaled FROM trials WINDOW w AS (PARTITION BY subject)")),
    "w6_log": (_norm("log", ["subject"]), sql("trials", f"SELECT subject, trial_id, {r('ln(1 + greatest(outcome, 0))')} AS scaled FROM trials")),
    "w7_normalise_train_test": (_train, sql("trials", f", s AS (SELECT subject, avg(outcome) AS m, stddev_pop(outcome) AS s FROM trials WHERE run < 3 GROUP BY subject) SELECT subject, trial_id, {r('(outcome - m) / nullif(s, 0)')} AS scaled FROM trials LEFT JOIN s USING (subject) WHERE run >= 3")),
    "w8_subject_zscore": (_norm("zscore", ["subject"]), sql("trials", f"SELECT subject, trial_id, {r('(outcome - avg(outcome) OVER w) / nullif(stddev_pop(outcome) OVER w, 0)')} AS scaled FROM trials WINDOW w AS (PARTITION BY subject)")),
    "w9_robust_by_run": (lambda i: op.normalise(i.trials, "outcome", ["subject", "run"], "robust").select("subject", "trial_id", rounded(F.coalesce("scaled", F.lit(0.0))).alias("scaled")), sql("trials", f", m AS (SELECT *, median(outcome) OVER (PARTITION BY subject, run) AS m FROM trials) SELECT subject, trial_id, {r('coalesce((outcome - m) / nullif(1.4826 * median(abs(outcome - m)) OVER (PARTITION BY subject, run), 0), 0)')} AS scaled FROM m")),
    "w10_within_between": (_within, sql("trials", f"SELECT subject, trial_id, {r('predictor - avg(predictor) OVER w')} AS within, {r('avg(predictor) OVER w')} AS between FROM trials WINDOW w AS (PARTITION BY subject)")),
    "w11_trial_order": (_order, sql("trials", f"SELECT subject, run, trial_id, row_number() OVER w AS place, {r('lag(outcome) OVER w')} AS prev_outcome, {r('lag(predictor) OVER w')} AS prev_predictor FROM trials WINDOW w AS (PARTITION BY subject, run ORDER BY trial_id)")),
    "w12_order_monotonic": (_monotonic, sql("trials", "SELECT subject, run, bool_and(coalesce(up, true)) AS monotonic, count(*) AS n FROM (SELECT subject, run, onset >= lag(onset) OVER (PARTITION BY subject, run ORDER BY trial_id) AS up FROM trials) GROUP BY ALL")),
    "w13_islands": (
        lambda i: op.islands(i.trials, F.col("outcome") > 100, ["subject"], "trial_id").where("flag").select("subject", "first", "last", "n"),
        sql("trials", "SELECT subject, min(trial_id) AS \"first\", max(trial_id) AS \"last\", count(*) AS n FROM (SELECT *, trial_id - row_number() OVER (PARTITION BY subject ORDER BY trial_id) AS g FROM trials WHERE outcome > 100) GROUP BY subject, g"),
    ),
    "w14_first_sustained": (
        lambda i: op.first_sustained(i.trials, F.col("outcome") > 50, ["subject"], "trial_id", 3),
        sql("trials", "SELECT subject, min(f) AS onset FROM (SELECT subject, min(trial_id) AS f, count(*) AS n FROM (SELECT *, trial_id - row_number() OVER (PARTITION BY subject ORDER BY trial_id) AS g FROM trials WHERE outcome > 50) GROUP BY subject, g) WHERE n >= 3 GROUP BY subject"),
    ),
    "w15_autocorrelation": (
        lambda i: op.autocorrelation(i.trials, "outcome", ["subject"], "trial_id", 1).select("subject", "pairs", rounded("r").alias("r")),
        sql("trials", f"SELECT subject, count(*) AS pairs, CASE WHEN count(*) >= 3 THEN {r('corr(outcome, b)')} END AS r FROM (SELECT subject, outcome, lead(outcome) OVER (PARTITION BY subject ORDER BY trial_id) AS b FROM trials) WHERE b IS NOT NULL GROUP BY subject"),
    ),
    "w16_change_scores": (
        lambda i: op.change_scores(op.time_mask(i.tfr, op.segments(i.spark, SEGMENTS)), ["trial_id", "freq"], "segment", "power", "base", "early").select("trial_id", "freq", *(rounded(c).alias(c) for c in ("change", "pct_change", "log_ratio"))),
        sql("tfr", f", m AS (SELECT trial_id, freq, avg(CASE WHEN t < 0 THEN power END) AS ref, avg(CASE WHEN t >= 0 THEN power END) AS act FROM tfr WHERE t < 0.375 GROUP BY ALL) SELECT trial_id, freq, {r('act - ref')} AS change, CASE WHEN abs(ref) > 1e-10 THEN {r('100 * (act - ref) / ref')} END AS pct_change, CASE WHEN ref > 0 AND act > 0 THEN {r('log10(act / ref)')} END AS log_ratio FROM m"),
    ),
    "w17_top_variance": (
        lambda i: op.top_variance(i.features, ["subject"], "feature", "value", 2).select("subject", "feature", F.col("place").cast("int").alias("place"), rounded("variance", 3).alias("variance")),
        sql("features", f", v AS (SELECT subject, feature, var_samp(value) AS v FROM features GROUP BY ALL) SELECT subject, feature, place::INT AS place, {r('v', 3)} AS variance FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY v DESC NULLS LAST, feature) AS place FROM v) WHERE place <= 2"),
    ),
    "w18_area_under": (
        lambda i: op.area_under(i.samples, "x", ["trial_id", "channel"], "t", 0.125).select("trial_id", "channel", rounded("area").alias("area")),
        sql("samples", f"SELECT trial_id, channel, {r('sum(p)')} AS area FROM (SELECT trial_id, channel, CASE WHEN t - lag(t) OVER w <= 0.1875 THEN (t - lag(t) OVER w) * (x + lag(x) OVER w) / 2 END AS p FROM samples WINDOW w AS (PARTITION BY trial_id, channel ORDER BY t)) GROUP BY ALL"),
    ),
    "w19_peaks": (
        lambda i: op.peaks(i.samples.where("t >= 0"), "x", ["trial_id", "channel"], "t", "abs").select("trial_id", "channel", rounded("peak").alias("peak"), rounded("latency").alias("latency")),
        sql("samples", f"SELECT trial_id, channel, {r('x')} AS peak, {r('t')} AS latency FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, channel ORDER BY abs(x) DESC, t) AS k FROM samples WHERE t >= 0) WHERE k = 1"),
    ),
    "w19_peaks_smoothed": (
        lambda i: op.peaks(i.samples, "x", ["trial_id", "channel"], "t", "pos", 1).select("trial_id", "channel", rounded("peak").alias("peak"), rounded("latency").alias("latency")),
        sql("samples", f", s AS (SELECT trial_id, channel, t, avg(x) OVER (PARTITION BY trial_id, channel ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM samples) SELECT trial_id, channel, {r('x')} AS peak, {r('t')} AS latency FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, channel ORDER BY x DESC, t) AS k FROM s) WHERE k = 1"),
    ),
    "w20_baseline_correct": (
        lambda i: op.baseline_correct(i.tfr, "power", ["trial_id", "freq"], F.col("t") < 0, "logratio").select("trial_id", "freq", "t", rounded("corrected").alias("corrected")),
        sql("tfr", f"SELECT trial_id, freq, t, {r('log10(power / avg(CASE WHEN t < 0 THEN power END) OVER (PARTITION BY trial_id, freq))')} AS corrected FROM tfr"),
    ),
    "w20_baseline_zscore": (
        lambda i: op.baseline_correct(i.tfr, "power", ["trial_id", "freq"], F.col("t") < 0.25, "zscore").select("trial_id", "freq", "t", rounded("corrected", 3).alias("corrected")),
        sql("tfr", f"SELECT trial_id, freq, t, {r('(power - avg(CASE WHEN t < 0.25 THEN power END) OVER w) / nullif(stddev_pop(CASE WHEN t < 0.25 THEN power END) OVER w, 0)', 3)} AS corrected FROM tfr WINDOW w AS (PARTITION BY trial_id, freq)"),
    ),
    "w21_check_baseline": (
        lambda i: op.check_baseline(i.trials, ["subject"], "onset", 0.0, 86400.0, 3),
        sql("trials", "SELECT subject, count(*) FILTER (onset >= 0 AND onset < 86400) AS n_baseline, false AS valid FROM trials GROUP BY subject"),
    ),
}
