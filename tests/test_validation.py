"""Held-out models, cluster tests and robust statistics against numpy and brute force on small tables."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import align, clusters, crossval, extended, microstates, models, names, signal, stats


def planted(n_groups=6, per=9, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        for i in range(per):
            a, b, c = rng.normal(size=3)
            out.append((g, i, float(a + offset), float(b), 2.0, float(3 * a - b + 0.3 * c + g / 10)))
    return out


SCHEMA = "g int, i int, a double, b double, flat double, y double"
FEATURES = ["a", "b", "flat"]


def ridge(x, y, penalty):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, np.inf)
    z = (x - mean) / sd
    w = np.linalg.lstsq(np.vstack([z, math.sqrt(penalty) * np.eye(z.shape[1])]), np.concatenate([y - y.mean(), np.zeros(z.shape[1])]), rcond=None)[0] / sd
    return np.concatenate([[y.mean() - w @ mean], w])


def nested(data, penalties, folds):
    out = {}
    g = np.array([r[0] for r in data])
    x, y = np.array([r[2:5] for r in data]), np.array([r[5] for r in data])
    for held in sorted(set(g)):
        errors = np.zeros(len(penalties))
        for f in range(folds):
            train, valid = (g != held) & (g % folds != f), (g != held) & (g % folds == f)
            if train.any() and valid.any():
                for k, p in enumerate(penalties):
                    w = ridge(x[train], y[train], p)
                    errors[k] += ((y[valid] - w[0] - x[valid] @ w[1:]) ** 2).sum()
        best = penalties[int(errors.argmin())]
        out[held] = (best, ridge(x[g != held], y[g != held], best))
    return out


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_nested_ridge_equals_refits(spark, offset):
    data = planted(offset=offset)
    penalties = [0.01, 5.0, 500.0]
    got = crossval.nested_ridge(spark.createDataFrame(data, SCHEMA), [], "g", FEATURES, "y", penalties, F.col("g") % 3).collect()
    want = nested(data, penalties, 3)
    assert len(got) == 6
    for r in got:
        assert r.penalty == want[r.g][0]
        assert np.allclose(r.weights[1:], want[r.g][1][1:], atol=1e-6)
        assert r.weights[3] == 0.0  # a constant feature weighs nothing


def test_keys_are_fitted_apart_and_nulls_left_out(spark):
    data = planted(3)
    both = [("p", *r) for r in data] + [("q", r[0], r[1], r[2], r[3], r[4], -r[5]) for r in data] + [("q", 0, 99, None, 1.0, 2.0, 5.0), ("one", 0, 0, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(both, "k string, " + SCHEMA)
    got = {(r.k, r.g): np.array(r.weights) for r in crossval.nested_ridge(df, ["k"], "g", FEATURES, "y", [1.0]).collect()}
    assert len(got) == 6  # a group without any other has no row
    for g in range(3):
        assert np.allclose(got["p", g], -got["q", g], atol=1e-8)
    p = crossval.predicted(df, crossval.nested_ridge(df, ["k"], "g", FEATURES, "y", [1.0]), ["k", "g"], FEATURES)
    assert p.count() == len(both) and p.where("prediction IS NULL").count() == 2


def test_no_rows_no_weights(spark):
    assert crossval.nested_ridge(spark.createDataFrame([], SCHEMA), [], "g", FEATURES, "y", [1.0]).count() == 0
    with pytest.raises(ValueError):
        crossval.nested_ridge(spark.createDataFrame([], SCHEMA), [], "g", FEATURES, "y", [1.0, 2.0])


def test_planted_signal_is_found(spark):
    df = spark.createDataFrame(planted(), SCHEMA)
    r = crossval.label_permutation(df, "g", ["g"], "i", ["a", "b"], "y", 1.0, 19).first()
    assert r.observed > 0.9 and r.extreme == 0 and r.p == pytest.approx(1 / 20)
    w = crossval.nested_ridge(df, [], "g", ["a", "b"], "y", [1.0])
    rise = crossval.permutation_importance(df, w, "g", "i", ["a", "b"], "y", 10).groupBy("feature").agg(F.avg("importance").alias("v"))
    rise = {r.feature: r.v for r in rise.collect()}
    assert rise["a"] > rise["b"] > 0


def test_permuted_importance_equals_prediction_of_permuted_rows(spark):
    df = spark.createDataFrame(planted(2), SCHEMA)
    w = crossval.nested_ridge(df, [], "g", ["a"], "y", [1.0])
    got = {r.g: r.importance for r in crossval.permutation_importance(df, w, "g", "i", ["a"], "y", 3).collect()}
    mixed = stats.permuted(df.select("g", "i", "a", "y", F.lit("a").alias("feature")), ["g", "feature"], "i", "a", 3)
    weights = {r.g: r.weights for r in w.collect()}
    rows = [(r.g, (r.y - weights[r.g][0] - weights[r.g][1] * r.permuted) ** 2 - (r.y - weights[r.g][0] - weights[r.g][1] * r.a) ** 2) for r in mixed.collect()]
    for g in got:
        assert got[g] == pytest.approx(np.mean([v for k, v in rows if k == g]))


def test_incremental_r2_of_a_constant_target_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("a", 1.0, 2.0, 1.0), ("b", 1.0, 1.0, 1.0), ("b", 3.0, 2.0, 3.0)], "g string, y double, p double, q double")
    got = {r.g: r for r in crossval.incremental_r2(df, "g", "y", "p", "q").collect()}
    assert got["a"].delta is None and got["b"].delta == pytest.approx(0.5)


def flood(cells, near):
    left, out = set(cells), {}
    while left:
        todo, seen = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.discard(c)
                seen.add(c)
                todo += [d for d in left if near(c, d)]
        for c in seen:
            out[c] = min(seen)
    return out


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(5)
    cells = [(x, y, z) for x, y, z in product(range(7), range(7), range(3)) if rng.random() < 0.4]
    snake = [(20 + k, 0, 0) for k in range(40)]
    df = spark.createDataFrame([(*c, 1.0) for c in cells + snake], "x int, y int, z_axis int, v double")
    got = {(r.x, r.y, r.z_axis): tuple(r.label) for r in clusters.components(df, [], ["x", "y", "z_axis"], ["v"]).collect()}
    assert got == flood(cells + snake, lambda a, b: sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1)


def test_components_follow_an_adjacency_table(spark):
    df = spark.createDataFrame([("Cz", 0, 1.0), ("Pz", 0, 1.0), ("Oz", 0, 1.0), ("Oz", 1, 1.0)], "channel string, t int, v double")
    near = spark.createDataFrame([("Cz", "Pz"), ("Pz", "Cz")], "a string, b string")
    got = {(r.channel, r.t): tuple(r.label) for r in clusters.components(df, [], ["channel", "t"], ["v"], near).collect()}
    assert got == {("Cz", 0): ("Cz", 0), ("Pz", 0): ("Cz", 0), ("Oz", 0): ("Oz", 0), ("Oz", 1): ("Oz", 0)}
    assert clusters.components(df.where("v > 2"), [], ["channel", "t"], ["v"], near).count() == 0


def test_cluster_p_counts_empty_permutations_as_zero(spark):
    observed = spark.createDataFrame([("a", 5.0), ("b", 1.0)], "label string, mass double")
    null = spark.createDataFrame([(0, 2.0), (0, 0.5), (1, 6.0)], "perm int, mass double")
    got = {r.label: r.p for r in clusters.max_mass_p(observed, null, [], 9).collect()}
    assert got == {"a": pytest.approx(2 / 10), "b": pytest.approx(3 / 10)}
    assert {r.p for r in clusters.max_mass_p(observed, null.where("perm > 5"), [], 9).collect()} == {0.1}


def test_voxel_clusters_by_q(spark):
    p = [(0, 0, 0, 3.0, 0.001), (1, 0, 0, 3.0, 0.002), (5, 5, 5, 3.0, 0.001), (9, 9, 9, 0.1, 0.9), (9, 9, 8, 0.1, None)]
    df = spark.createDataFrame([("s", *r) for r in p], "k string, x int, y int, z_axis int, z double, p double")
    got = clusters.voxel_clusters(df, ["k"], "z", 2, p="p").collect()
    assert sorted((r.x, r.y, r.z_axis, r.cluster_size) for r in got) == [(0, 0, 0, 2), (1, 0, 0, 2)]


def test_surrogates_of_a_single_trial_are_null(spark):
    df = spark.createDataFrame([(0, 0, c, t, math.cos(t + c), math.sin(t)) for c in (0, 1) for t in range(5)], "s int, trial int, channel int, t int, re double, im double")
    r = clusters.coupling_surrogates(df, ["s"], "trial", 0, 1, 5).first()
    assert r.pac is not None and r.surrogate_mean is None and r.z is None


def test_bayes_factor_words(spark):
    df = spark.createDataFrame([(3, 0.5), (10, None), (10, 1.0), (50, 0.0), (50, 0.8)], "n int, r double")
    got = [(r.n, r.r, r.bf10, r.evidence) for r in clusters.bayes_factor(df).collect()]
    assert [g[3] for g in got[:3]] == ["insufficient_data", "invalid_r", "invalid_r"]
    assert got[3][2] == pytest.approx(2 * math.sqrt(49)) and got[3][3] == "strong_H1"  # the series is 1 at r = 0


def test_normal_p(spark):
    zs = [0.0, 0.5, 1.96, -3.0, 6.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [math.erfc(abs(z) / math.sqrt(2)) for z in zs], atol=1e-13)


def test_partial_correlation_of_residuals(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 5))
    m[:, 0] += m[:, 2] - m[:, 3]
    m[:, 1] += m[:, 2] + m[:, 4]
    df = spark.createDataFrame([("k", *map(float, r), 1.0) for r in m], "k string, x double, y double, a double, b double, c double, one double")
    z = np.column_stack([np.ones(40), m[:, 2:]])
    res = [v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (m[:, 0], m[:, 1])]
    r = stats.partial_many(df, ["k"], "x", "y", ["a", "b", "c"]).first()
    assert r.dof == 35 and r.r == pytest.approx(np.corrcoef(*res)[0, 1])
    assert stats.partial_many(df, ["k"], "x", "y", ["a", "one"]).first().r is None
    assert stats.partial_many(df, ["k"], "x", "y", ["a", "a"]).first().r is None


def test_robust_correlations_shrug_off_an_outlier(spark):
    data = [("k", float(i), float(i) + (i % 3) / 10) for i in range(30)] + [("k", 1000.0, -1000.0)] + [("flat", 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    for f in (stats.percentage_bend, stats.shepherd):
        got = {r.k: r.r for r in f(df, ["k"], "x", "y").collect()}
        assert got["k"] > 0.7 and got["flat"] is None


def test_grid_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 5, (80, 2)))]
    got = {(r.channel, r.other) for r in extended.distance_adjacency(spark.createDataFrame(p, "channel int, x double, y double"), 1.3).collect()}
    assert got == {(a[0], b[0]) for a in p for b in p if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 1.3}


def test_forest_learns_a_step(spark):
    df = spark.createDataFrame([(i, float(i % 20), float(i % 20 >= 10)) for i in range(200)], "i int, x double, y double")
    got = models.forest(df, ["x"], "y", F.col("i") < 150).collect()
    assert len(got) == 50 and all(abs(r.prediction - r.y) < 0.3 for r in got)
    labels = df.withColumn("y", F.col("y").cast("int"))
    assert all(r.prediction == r.y for r in models.forest(labels, ["x"], "y", F.col("i") < 150, classes=True).collect())


def test_balanced_logistic_solves_the_weighted_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 1).astype(int)
    df = spark.createDataFrame([(int(i), float(v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i int, x double, y int")
    got = models.balanced_logistic(df.unionByName(df.withColumn("i", -F.col("i") - 1)), ["x"], "y", F.col("i") >= 0).orderBy(F.desc("i")).collect()
    p = np.array([r.p for r in got])
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    assert abs((w * (p - y)).sum()) < 1e-2 and abs((w * (p - y) * x).sum()) < 1e-2  # the gradient is zero at the optimum


def test_regions_in_any_case(spark):
    df = names.parsed(spark.createDataFrame([("power_active_alpha_roi_Frontal_mean",), ("power_active_alpha_ch_Frontal_mean",), ("power_active_alpha_roi_other_mean",)], "name string"))
    assert [r.name for r in names.in_regions(df, [" frontal ", ""]).collect()] == ["power_active_alpha_roi_Frontal_mean"]


def test_transform_by_the_likeliest_lambda(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=200)) - 1], "y double")
    got = extended.yeo_johnson_transform(df, "y", [0.0, 0.5, 1.0, 2.0]).collect()
    assert {r.lam for r in got} == {0.0} and all(r.transformed == pytest.approx(math.log1p(r.y)) for r in got if r.y >= 0)


def greedy(x, offset, distance):
    def extrema(v):
        at = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] > v[i + 1]]
        kept = []
        for i in sorted(at, key=lambda i: (-v[i], -i)):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)
        return kept

    def mean(at):
        return np.mean([abs(x[i] - x[i - offset]) + abs(x[i] - x[i + offset]) for i in at if i >= offset and i + offset < len(x)])

    return math.log(mean(extrema(x)) / mean(extrema([-v for v in x])))


@pytest.mark.parametrize("distance", [1, 4])
def test_sharpness_equals_greedy_extrema(spark, distance):
    rng = np.random.default_rng(9)
    series = {"a": rng.normal(size=60).tolist(), "b": np.cumsum(rng.normal(size=80)).tolist()}
    data = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)] + [("short", i, float(i % 2)) for i in range(5)]
    got = {r.k: r.sharpness for r in extended.sharpness_ratio(spark.createDataFrame(data, "k string, i int, v double"), ["k"], "i", "v", 3, distance).collect()}
    assert got.pop("short") is None
    assert got == {k: pytest.approx(greedy(x, 3, distance)) for k, x in series.items()}


def test_signed_rank_leaves_out_zeros(spark):
    df = spark.createDataFrame([("k", 0.0, 1.0), ("k", 0.0, -2.0), ("k", 0.0, 3.0), ("k", 5.0, 5.0), ("same", 1.0, 1.0)], "k string, a double, b double")
    r = stats.signed_rank(df, ["k"], "a", "b").collect()
    assert [(x.k, x.n, x.w) for x in r] == [("k", 3, 4.0)] and r[0].z == pytest.approx((4 - 3) / math.sqrt(3.5))


def test_switching_of_a_single_row(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 1, 2), ("b", 2, 2)], "k string, i int, s int")
    got = {r.k: (r.switching, r.entropy) for r in extended.state_switching(df, ["k"], "i", "s").collect()}
    assert got["a"] == (None, 0.0) and got["b"][0] == 0.5 and got["b"][1] == pytest.approx(-(math.log(1 / 3) / 3 + 2 * math.log(2 / 3) / 3))
    assert [tuple(r) for r in extended.state_transitions(df, ["k"], "i", "s").collect()] == [("b", 1, 2, 1, 1.0)]


def _peaks(x, distance, most):
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if j < n - 1 and x[i - 1] < x[i] > x[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    return sorted(kept[:most]) if kept else [int(np.argmax(x))]


def _no_short_runs(states, least):
    edges = [0] + [i for i in range(1, len(states)) if states[i] != states[i - 1]] + [len(states)]
    runs, out = list(zip(edges, edges[1:])), list(states)
    for k, (a, b) in enumerate(runs):
        if b - a >= least or len(runs) == 1:
            continue
        left = runs[k - 1] if k else None
        right = runs[k + 1] if k + 1 < len(runs) else None
        for i in range(a, b):
            if left is None:
                take = right
            elif right is None or states[left[0]] == states[right[0]]:
                take = left
            elif (left[1] - left[0]) != (right[1] - right[0]):
                take = left if left[1] - left[0] > right[1] - right[0] else right
            else:
                take = left if i < a + (b - a) // 2 else right
            out[i] = states[take[0]]
    return out


@pytest.mark.parametrize("distance, least, most", [(1, 1, None), (3, 4, None), (1, 3, 2)])
def test_microstates_by_brute_force(spark, distance, least, most):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(4, 3, 40)), 1)
    x[0, :, 10:13] = x[0, :, 10:11]  # a flat stretch
    x[3] = np.arange(40) * np.array([[1.0], [2.0], [4.0]])  # power grows to the end: no peak
    unit = lambda m: (m - m.mean()) / np.linalg.norm(m - m.mean())
    templates = np.array([unit(m) for m in rng.normal(size=(3, 3))])
    want = {}
    for g in range(4):
        peaks = _peaks(list(np.std(x[g], axis=0)), distance, most)
        state = [int(np.argmax(np.abs(templates @ unit(x[g][:, p])))) for p in peaks]
        borders = [0] + [(a + b) // 2 for a, b in zip(peaks, peaks[1:])]
        labels = [state[max(k for k, s in enumerate(borders) if s <= i)] for i in range(40)]
        want.update({(g, i): s for i, s in enumerate(_no_short_runs(labels, least))})
    rows = [(g, i, c, float(x[g, c, i])) for g in range(4) for c in range(3) for i in range(40)]
    samples = spark.createDataFrame(rows, "g int, i int, c int, x double")
    t = spark.createDataFrame([(s, c, float(templates[s, c])) for s in range(3) for c in range(3)], "state int, c int, weight double")
    got = microstates.microstates(samples, t, ["g"], "i", "c", "x", least, distance, most)
    assert {(r.g, r.i): r.state for r in got.collect()} == want


def test_microstates_without_rows_or_power(spark):
    empty = spark.createDataFrame([], "g int, i int, c int, x double")
    t = spark.createDataFrame([(0, 0, 1.0)], "state int, c int, weight double")
    assert microstates.microstates(empty, t, ["g"], "i", "c", "x", 2).count() == 0
    nulls = spark.createDataFrame([(1, i, c, None) for i in range(4) for c in range(2)], "g int, i int, c int, x double")
    assert microstates.microstates(nulls, t, ["g"], "i", "c", "x", 2).count() == 0


def test_templates_find_planted_maps(spark):
    base = np.array([[3.0, -1, -2, 0], [-2, 3.0, 0, -1]])
    rng = np.random.default_rng(2)
    rows = [(i, c, float(base[i % 2, c] + rng.normal() * 0.05)) for i in range(60) for c in range(4)]
    maps = microstates.unit_maps(spark.createDataFrame(rows, "i int, c int, x double"), ["i"], "c", "x")
    t = microstates.fit_templates(maps, ["i"], "c", [0, 1, 2, 3], 2)
    states = {r.i: r.state for r in microstates.assign_states(maps, t, ["i"], "c").collect()}
    assert len({states[i] for i in range(0, 60, 2)}) == len({states[i] for i in range(1, 60, 2)}) == 1 and states[0] != states[1]


def test_merges_check_their_keys(spark):
    a = spark.createDataFrame([("s", 1, 1, 0.5), ("s", 1, 2, 0.6)], "subject string, run_id int, trial int, x double")
    b = spark.createDataFrame([(1, 2, 7.0), (1, 3, 8.0)], "run_id int, trial int, y double")
    empty = a.where("false")
    assert align.unique_keys(a, b) == ["run_id", "trial"]
    got = {(r.trial, r.x, r.y) for r in align.merge_tables([empty, a, b]).collect()}
    assert got == {(1, 0.5, None), (2, 0.6, 7.0), (3, None, 8.0)}
    with pytest.raises(ValueError):
        align.unique_keys(a, b.unionByName(b))
    with pytest.raises(ValueError):
        align.merge_tables([empty])
    c = spark.createDataFrame([(1, 2, 0.6, "q")], "run_id int, trial int, x double, w string")
    assert align.merge_one_to_one([a, b, c], ["run_id", "trial"]).collect()[0].asDict() == {"subject": "s", "run_id": 1, "trial": 2, "x": 0.6, "y": 7.0, "w": "q"}
    with pytest.raises(Exception, match="repeats"):
        align.merge_one_to_one([a, b.unionByName(b)], ["run_id", "trial"]).collect()
    with pytest.raises(Exception, match="differs"):
        align.merge_one_to_one([a, c.withColumn("x", F.lit(9.0))], ["run_id", "trial"]).collect()


def test_shifts_turn_each_group(spark):
    rows = [(g, i, float(10 * g + i)) for g in range(3) for i in range(5 + g)]
    df = spark.createDataFrame(rows, "g int, i int, v double")
    out = {}
    for r in stats.shifted(df, ["g"], "i", "v", 20, least=2).orderBy("i").collect():
        out.setdefault((r.g, r.perm), []).append(r.permuted)
    for (g, _), got in out.items():
        plain = [float(10 * g + i) for i in range(5 + g)]
        assert got in [plain[-k:] + plain[:-k] if k else plain for k in range(len(plain))]
    assert len({tuple(v) for (g, _), v in out.items() if g == 2}) > 3
    with pytest.raises(Exception, match="fewer than"):
        stats.shifted(df.where("g < 2 OR i = 0"), ["g"], "i", "v", 2, least=2).collect()


def test_entropy_counts_every_matching_pair(spark):
    rng = np.random.default_rng(8)
    data = {0: np.round(rng.normal(size=60), 1), 1: np.full(10, 2.0), 2: np.arange(3.0), 3: np.arange(40.0) ** 3}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in data.items() for i, v in enumerate(x)], "g int, i int, v double")
    got = {(r.g, r.scale): (r.a, r.b) for r in signal.multiscale_entropy(df, ["g"], "v", "i", [1, 2]).collect()}
    want = {}
    for g, x in data.items():
        for s in (1, 2):
            y = x[: len(x) // s * s].reshape(-1, s).mean(1)
            if len(y) - 2 < 2:
                continue
            near = [[abs(y[i + k] - y[j + k]) <= 0.2 * y.std() + 1e-12 for k in range(3)] for i in range(len(y) - 2) for j in range(i + 1, len(y) - 2)]
            want[g, s] = (sum(all(n) for n in near), sum(all(n[:2]) for n in near))
    assert got == want


def test_clustering_of_graphs(spark):
    e = [("full", 0, 1), ("full", 1, 2), ("full", 0, 2), ("full", 2, 0), ("path", 0, 1), ("path", 1, 2), ("kite", 0, 1), ("kite", 1, 2), ("kite", 2, 0), ("kite", 2, 3), ("kite", 3, 3)]
    got = {r.g: r.clustering for r in extended.graph_clustering(spark.createDataFrame(e, "g string, a int, b int"), "g", 4).collect()}
    assert got == pytest.approx({"full": 3 / 4, "path": 0.0, "kite": (1 + 1 + 1 / 3) / 4})


def test_grid_takes_the_penalty_with_least_error(spark):
    df = spark.createDataFrame(planted(), SCHEMA).withColumn("fold", F.col("i") % 3)
    good = models.grid_regression(df, ["a", "b"], "y", F.col("g") < 5, "fold", [0.001, 50.0], [0.0])
    r = good.select("penalty", "mix").distinct().collect()
    assert [(x.penalty, x.mix) for x in r] == [(0.001, 0.0)] and good.count() == 9
    same = models.elastic_net(df, ["a", "b"], "y", F.col("g") < 5, 0.001, 0.0)
    assert {(x.i, round(x.prediction, 9)) for x in good.collect()} == {(x.i, round(x.prediction, 9)) for x in same.collect()}


def test_components_match_a_decomposition(spark):
    data = planted(per=7)
    train = np.array([r[0] < 4 for r in data])
    x = np.array([[r[2], r[3], r[5]] for r in data])
    z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    _, vectors = np.linalg.eigh(np.cov(z[train].T))
    want = np.abs(z @ vectors[:, ::-1][:, :2])
    got = {(r.g, r.i): (abs(r.pc1), abs(r.pc2)) for r in models.principal_components(spark.createDataFrame(data, SCHEMA), ["a", "b", "y"], F.col("g") < 4, 2).collect()}
    assert all(got[r[0], r[1]] == pytest.approx(tuple(want[k]), abs=1e-8) for k, r in enumerate(data))


def test_connectivity_states_find_planted_windows(spark):
    rng = np.random.default_rng(6)
    rows = [(g, w, e, float((e == w % 2) * scale + rng.normal() * 0.01 * scale)) for g in range(4) for w in range(10) for e, scale in ((0, 1.0), (1, 1000.0))]
    df = spark.createDataFrame(rows, "g int, w int, edge int, v double")
    got = extended.connectivity_states(df, ["g"], ["w"], "edge", [0, 1], "v", 2).collect()
    assert len(got) == 40 and all(r.place == r.w + 1 for r in got)
    state = {(r.g, r.w): r.state for r in got}
    assert all(state[g, w] == state[0, w % 2] for g, w in state) and state[0, 0] != state[0, 1]
    m = {r.g: (r.switching, r.entropy) for r in extended.state_switching(extended.connectivity_states(df, ["g"], ["w"], "edge", [0, 1], "v", 2), ["g"], "place", "state").collect()}
    assert m[0] == pytest.approx((1.0, math.log(2)))
