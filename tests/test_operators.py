"""Edge cases of the operators on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from trialspark.operators import align, extended, groups, imaging, models, names, signal, stats, windows
from trialspark.sources import files


def rows(df, *keys):
    return sorted(tuple(r) for r in df.select(*keys).collect())


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", float(k), 5.0) for k in range(5)] + [("b", float(k), 2.0 * k) for k in range(5)], "g string, x double, y double")
    got = {r.g: r.r for r in stats.correlations(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_partial_correlation_guards_a_perfect_fit(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.0), ("a", 2.0, 1.0, 3.0), ("a", 3.0, 4.0, 2.0), ("a", 4.0, 3.0, 5.0)], "g string, x double, y double, z double")
    r = stats.partial_one(df, ["g"], "x", "y", "z").first()
    assert r.dof == 1 and -1 <= r.r <= 1


def test_hierarchical_fdr_needs_the_gate(spark):
    strong = [(f"s{k}", 0, 1e-4) for k in range(5)]
    middle = [("m", 0, 0.020), ("m", 1, 0.021)]
    weak = [(f"w{k}", 0, 0.9) for k in range(19)]
    df = spark.createDataFrame(strong + middle + weak, "family string, i int, p double")
    got = {(r.family, r.i): (r.q, r.reject) for r in stats.hierarchical_fdr(df, "p", "family", ["i"]).collect()}
    assert got["m", 0][0] < 0.05 and not got["m", 0][1]
    assert all(got[f"s{k}", 0][1] for k in range(5))


def test_q_is_at_least_p_and_null_p_has_none(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, None), (3, float("nan")), (4, 0.03)], "i int, p double").withColumn("all", F.lit(1))
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", ["all"], ["i"]).collect()}
    assert got[2] is None and got[3] is None
    assert got[0] == pytest.approx(0.03) and got[4] == pytest.approx(0.04) and got[1] == pytest.approx(0.04)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.02), (2, 0.03)], "i int, p double").withColumn("all", F.lit(1))
    assert [round(r.p_holm, 6) for r in stats.holm(df, "p", ["all"], ["i"]).orderBy("i").collect()] == [0.03, 0.04, 0.04]


def test_permutation_keeps_each_group(spark):
    df = spark.createDataFrame([(g, i, float(10 * g + i)) for g in range(3) for i in range(4)], "g int, i int, v double")
    got = stats.permuted(df, ["g"], "i", "v", 5).groupBy("g", "perm").agg(F.sort_array(F.collect_list("permuted")).alias("v")).collect()
    assert len(got) == 15 and all(r.v == [float(10 * r.g + i) for i in range(4)] for r in got)


def test_sign_flip_is_exact(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(3)], "g string, i int, v double")
    r = stats.sign_flip(df, ["g"], "i", "v").first()
    assert r.n_perm == 8 and r.extreme == 2 and r.p == pytest.approx(3 / 9)


def test_fisher_run_average_is_weighted(spark):
    df = spark.createDataFrame([("s", "a", "b", 1, 0.1), ("s", "a", "b", 3, 0.5)], "subject string, a string, b string, n int, r double")
    r = imaging.average_runs(df, ["subject"]).first().r
    assert r == pytest.approx(math.tanh((math.atanh(0.1) + 3 * math.atanh(0.5)) / 4))


def test_islands_and_first_sustained(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 1, 0, 1, 1, 1, 0])], "g string, i int, v int")
    got = windows.islands(df, F.col("v") == 1, ["g"], "i").where("flag")
    assert rows(got, "first", "last", "n") == [(1, 1, 1), (3, 5, 3)]
    assert windows.first_sustained(df, F.col("v") == 1, ["g"], "i", 2).first().onset == 3


def test_windows_are_half_open_and_bands_closed(spark):
    t = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "t double")
    assert windows.time_mask(t, windows.segments(spark, [("w", 0.0, 1.0)])).count() == 2
    band = spark.createDataFrame([("b", 0.0, 1.0)], "band string, f0 double, f1 double")
    assert windows.bands(t, band, "t").count() == 3


def test_rank_scale_of_a_single_row_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    assert rows(windows.rank_normalise(df, "v", ["g"]).where("g = 'b'"), "scaled") == [(0.25,), (0.25,), (1.0,)]
    assert windows.rank_normalise(df, "v", ["g"]).where("g = 'a'").first().scaled is None


def test_robust_scale_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0)], "g string, v double")
    assert {r.scaled for r in windows.normalise(df, "v", ["g"], "robust").collect()} == {None}


def test_alignment_follows_the_key(spark):
    events = spark.createDataFrame([(2, 0.2), (1, 0.1)], "trial_id int, rating double")
    features = spark.createDataFrame([(1, "p", 0.1), (2, "p", 0.9)], "trial_id int, feature string, value double")
    assert rows(align.trial_table(events, features, ["trial_id"], ["p"]), "trial_id", "p") == [(1, 0.1), (2, 0.9)]


def test_null_key_and_disagreement_are_refused(spark):
    df = spark.createDataFrame([(None,)], "trial_id long")
    with pytest.raises(Exception, match="null key"):
        df.select(align.checked_key("trial_id")).collect()
    a, b = spark.createDataFrame([(1, 1.0)], "k int, v double"), spark.createDataFrame([(1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="v differs"):
        align.one_to_one(a, b, ["k"], ["v"]).collect()


def test_outer_merge_coalesces(spark):
    a, b = spark.createDataFrame([(1, None), (2, 5)], "k int, v int"), spark.createDataFrame([(1, 7), (3, 8)], "k int, v int")
    assert rows(align.outer_merge(a, b, ["k"]), "k", "v") == [(1, 7), (2, 5), (3, 8)]


def test_names_parse_and_bad_scope(spark):
    df = spark.createDataFrame([("power_active_alpha_ch_Cz_log_ratio",), ("power_active_alpha_global_mean",), ("short_name",)], "name string")
    got = {r.name: (r.identifier, r.stat) for r in names.parsed(df).collect()}
    assert got == {"power_active_alpha_ch_Cz_log_ratio": ("Cz", "log_ratio"), "power_active_alpha_global_mean": (None, "mean")}
    with pytest.raises(Exception, match="unknown scope"):
        df.select(names.build(*map(F.lit, ["p", "a", "b", "planet", "x", "m"]))).collect()


def test_trial_key_forms(spark):
    df = spark.createDataFrame([("run-1_trial-7",), ("1|trial-007",), ("1:7",)], "label string")
    assert {r[0] for r in df.select(align.trial_key(F.col("label"))).collect()} == {"1|trial-007"}


def test_change_scores_guard_small_references(spark):
    df = spark.createDataFrame([("a", "base", 0.0), ("a", "act", 1.0), ("b", "base", 10.0), ("b", "act", 100.0)], "k string, seg string, v double")
    got = {r.k: (r.change, r.pct_change, r.log_ratio) for r in windows.change_scores(df, ["k"], "seg", "v", "base", "act").collect()}
    assert got["a"] == (1.0, None, None) and got["b"] == pytest.approx((90.0, 900.0, 1.0))


def test_unit_phase_coupling_is_one(spark):
    df = spark.createDataFrame([(0, c, t, 1.0, 0.0) for c in (0, 1) for t in range(4)], "trial_id int, channel int, t int, re double, im double")
    r = signal.phase_amplitude(df, ["trial_id"], 0, 1).first()
    assert r.pac == pytest.approx(1.0) and r.pac_raw == pytest.approx(1.0)
    assert signal.phase_connectivity(df, ["trial_id"]).first().plv == pytest.approx(1.0)


def test_welch_finds_a_tone(spark):
    df = spark.createDataFrame([(0, i, math.sin(2 * math.pi * 10 * i / 64)) for i in range(256)], "trial_id int, sample_idx int, x double")
    assert signal.welch(df, ["trial_id"], 64.0, 64).orderBy(F.desc("power")).first().freq == pytest.approx(10.0)


def test_analytic_band_recovers_the_envelope(spark):
    df = spark.createDataFrame([(0, i, math.cos(2 * math.pi * 8 * i / 64)) for i in range(128)], "trial_id int, sample_idx int, x double")
    got = signal.analytic_band(df, ["trial_id"], 64.0, 6.0, 10.0).collect()
    assert all(math.hypot(r.re, r.im) == pytest.approx(1.0, abs=1e-6) for r in got)


def test_lempel_ziv_of_a_constant_is_low(spark):
    df = spark.createDataFrame([(k, i, float(v)) for k in (0, 1) for i, v in enumerate([1] * 16 if k == 0 else [0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 1, 0, 0, 1, 0, 1])], "trial_id int, sample_idx int, x double")
    got = {r.trial_id: r.complexity for r in signal.lempel_ziv(df, ["trial_id"]).collect()}
    assert got[0] < got[1]


def test_conformal_level_of_few_rows(spark):
    df = spark.createDataFrame([("a", float(k), 0.0) for k in range(1, 6)], "g string, y double, p double")
    r = models.split_conformal(df, ["g"], "y", "p", F.lit(True), 0.1).first()
    assert r.n == 5 and r.half_width == pytest.approx(5.0)


def test_identical_columns_and_bins(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (None, None, 3.0)], "a double, b double, c double")
    got = {(r["first"], r["second"]): r.identical for r in files.identical_columns(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}
    x = spark.createDataFrame([(float(k), float(k)) for k in range(11)], "x double, y double")
    assert sum(r.n for r in groups.binned_statistics(x, "x", "y", 5).collect()) == 11


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    files.write_tsv(df, f"file://{tmp_path}/t")
    assert rows(files.read_tsv(spark, f"file://{tmp_path}/t", df.schema), "name") == [("a",), ("b",)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert stats.correlations(df, ["g"], "x", "y").count() == 0
    assert windows.normalise(df, "x", ["g"], "robust").count() == 0
    assert imaging.one_sample(df.withColumnRenamed("x", "value"), ["g"]).count() == 0


def test_correlation_keeps_its_digits_under_a_large_offset(spark):
    df = spark.range(50).selectExpr("1 AS g", "id + 1e9D AS x", "(id * 37) % 50 + 1e9D AS y", "id + 0D AS u", "(id * 37) % 50 + 0D AS v", "3e9D AS c")
    r = df.groupBy("g").agg(windows.moment_corr(F.col("x"), F.col("y")).alias("far"), windows.moment_corr(F.col("u"), F.col("v")).alias("near"), windows.moment_corr(F.col("x"), F.col("c")).alias("flat")).first()
    # doubles near 1e9 lie 1.2e-7 apart, which bounds what the running means can keep
    assert r.near is not None and abs(r.far - r.near) < 1.2e-7 and r.flat is None


def test_nothing_divides_by_zero(spark):
    one = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 4.0, 5.0)], "u int, r int, x double, y double")
    assert stats.leave_one_out(one, "u", "x", "y").first().r is None
    assert stats.icc(one, "u", "r", "x", 2).first().icc11 is None
    silent = spark.createDataFrame([(1, c, t, 0.0, 0.0) for c in (0, 1) for t in range(3)], "k int, channel int, t int, re double, im double")
    assert signal.phase_connectivity(silent, ["k"]).first().plv is None
    assert signal.phase_locking(silent, ["k"]).count() == 6
    assert extended.phase_slope(silent, ["k"], "t", 0, 1).first().psi is None
    assert signal.spectral_shape(spark.createDataFrame([(1, 1.0, 0.0)], "k int, freq double, power double"), ["k"]).count() == 1
    assert groups.binned_statistics(one.withColumn("x", F.lit(1.0)), "x", "y", 4).first().n == 2


def test_sign_flip_samples_patterns_of_large_groups(spark):
    df = spark.createDataFrame([("big", k, 1.0 + k % 3) for k in range(20)] + [("even", k, 1.0 if k % 2 else -1.0) for k in range(20)] + [("small", k, 1.0) for k in range(4)], "g string, k int, v double")
    got = {r.g: r for r in stats.sign_flip(df, ["g"], "k", "v", n_sampled=400).collect()}
    assert got["big"].n_perm == 401 and got["big"].p < 0.02 and got["even"].p == 1.0
    assert got["small"].n_perm == 16 and got["small"].extreme == 2


def test_prepared_features_and_majority(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, float("nan")), ("a", 1, 5.0), ("b", 0, 2.0), ("b", 0, 2.0), ("c", 0, None), ("c", 1, 1.0)], "f string, held int, v double")
    got = sorted((r.f, r.prepared) for r in models.prepared(df, "f", "v", F.col("held") == 0).collect())
    assert got == [("a", -1.0), ("a", 0.0), ("a", 1.0), ("a", 3.0)]
    y = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "y"), (3, None)], "g int, y string")
    assert {r.g: (r.prediction, r.support) for r in models.held_out_majority(y, "g", "y").collect()} == {1: ("y", 2), 2: ("x", 2), 3: ("x", 2)}


def test_interval_order_statistics(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(int(k % 3), float(p), float(r)) for k, (p, r) in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "row string, fold int, prediction double, residual double")
    for r in extended.cv_plus(df.drop("residual"), df.select("fold", "residual"), 0.1).collect():
        fold, p, _ = rows[int(r.row)]
        res = np.sort([q for f, _, q in rows if f == fold])
        n = len(res)
        assert r.low == np.sort(p - res)[max(int(0.1 * (n + 1)), 1) - 1] and r.high == np.sort(p + res)[min(int(np.ceil(0.9 * (n + 1))), n) - 1]
