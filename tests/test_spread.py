"""Plans that must not send a multiplied table to one place, whatever size Spark guesses for it."""

import contextlib
import io
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trialspark.operators import align, extended, models, scans, stats
from trialspark.plans import catalog
from trialspark.plans import stats as plans
from trialspark.sources import files


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, t, float((t * 7 + s * 3) % 11) + t / 100) for s in (1, 2) for t in range(40)]
    return spark.createDataFrame([*rows, (None, 1, 2.0)], "s int, t int, v double")


def test_sample_entropy_never_broadcasts_its_grid(spark):
    assert re.search(r"SortMergeJoin \[[^\]]*__c0", plan(catalog.queries()["f20_multiscale_entropy"](spark, "/root/testdata/sf0.001")))


def test_permuted_needs_no_join(series):
    got = stats.permuted(series, ["s"], "t", "v", 3)
    assert "Join" not in plan(got)
    rows = got.collect()
    assert len(rows) == 2 * 40 * 3 and {r.s for r in rows} == {1, 2}
    for s in (1, 2):
        own = sorted(r.v for r in series.collect() if r.s == s)
        shuffles = [[r.permuted for r in sorted(rows, key=lambda r: r.t) if (r.s, r.perm) == (s, p)] for p in range(3)]
        assert all(sorted(x) == own for x in shuffles) and len({tuple(x) for x in shuffles}) == 3


def test_permuted_keeps_nulls_in_their_places(spark):
    rows = spark.createDataFrame([(1, t, None if t % 2 else float(t)) for t in range(10)], "s int, t int, v double")
    got = [r.permuted for r in stats.permuted(rows, ["s"], "t", "v", 1).collect()]
    assert sorted(v for v in got if v is not None) == [0.0, 2.0, 4.0, 6.0, 8.0] and len(got) == 10


def test_carried_minima_use_a_growing_frame(series):
    rows = scans.numbered(series.where("s IS NOT NULL"), ["s"], ["v"])
    text = plan(scans.carried(rows, ["s"], "v", "m", least_after=True)).lower()
    assert not re.search(r"(?<!unboundedpreceding\$\(\), )unboundedfollowing", text)  # Spark folds a frame that shrinks anew for each row


def test_sign_patterns_of_one_group_spread(spark):
    units = spark.range(3000).select(F.lit("a").alias("g"), "id", (F.col("id") % 7 - 2.5).alias("v"))
    got = stats.sign_flip(units, ["g"], "id", "v", n_sampled=50).first()
    assert got.n_perm == 51 and got.observed == pytest.approx(sum(k % 7 - 2.5 for k in range(3000)) / 3000)
    assert re.search(r"__block#\d+L?, \d+\), REPARTITION_BY_NUM", plan(stats.sign_flip(units, ["g"], "id", "v")))


def test_region_pairs_take_no_join(spark):
    frames = spark.createDataFrame([(1, f, r, v) for f in range(9) for r, v in (("x", f * f % 5), ("y", f % 3), ("z", f))] + [(None, 1, "x", 1)], "s int, frame int, roi string, value int")
    got = imaging.region_correlation(frames, ["s"])
    assert "Join" not in plan(got)
    assert sorted((r.s, r.a, r.b, r.n) for r in got.collect()) == [(1, "x", "y", 9), (1, "x", "z", 9), (1, "y", "z", 9)]


def test_halves_do_not_hang_on_the_order_of_a_sum(spark):
    rows = [(1, 1, "click", v) for v in (0.1, 0.2, 0.3, 0.4, 0.5, 0.0)] + [(1, 1, "view", v) for v in (1.1, 1.2, 1.3, 1.4)]
    trials = lambda k: SimpleNamespace(trials=spark.createDataFrame(rows[::k], "subject int, run int, condition string, outcome double").coalesce(1))
    assert [tuple(r) for r in plans._sides(trials(1)).collect()] == [tuple(r) for r in plans._sides(trials(-1)).collect()] == [(1, 1, 3.0, 13.0)]


def test_small_groups_are_resampled_as_large_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(s, t, None if t == 3 else t * 1.5) for s, n in ((1, 5), (2, 30)) for t in range(n)] + [(None, 1, 1.0)], "s int, t int, v double")
    take = lambda: sorted((r.s, r.boot, r.place, r.t, r.v or -1.0) for r in stats.bootstrap_draws(rows, ["s"], "t", 7).collect())
    listed = take()
    assert len(listed) == 35 * 7 and len({r[:2] for r in listed}) == 14
    monkeypatch.setattr(stats, "MOST_LISTED", 10)
    assert take() == listed
    monkeypatch.setattr(stats, "MOST_LISTED", 0)
    assert take() == listed


def test_a_crowded_cell_is_dealt_to_many_tasks(spark):
    spots = [(i, (i % 3) * 0.4, (i % 5) * 0.3) for i in range(600)] + [(None, 0.0, 0.0), (600, None, 0.0)]
    points = spark.createDataFrame(spots, "channel int, x double, y double")
    found = extended.distance_adjacency(points, 1.2, block=64)
    want = {(a[0], b[0]) for a in spots[:600] for b in spots[:600] if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 1.2}
    got = found.collect()
    assert len(got) == len(want) and {(r.channel, r.other) for r in got} == want
    text = plan(found)
    assert "SortMergeJoin [__cx" in text and re.search(r"SortMergeJoin \[[^\]]*__b2", text)  # a block a key, not a cell a key


@pytest.mark.parametrize(
    ("name", "key"), [("m6_prepared_features", "feature"), ("m6_best_features", "feature"), ("m8_deconfound", "condition"), ("m23_linear_attribution", "condition")]
)
def test_rows_meet_what_few_groups_gave_where_they_lie(spark, name, key):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # less than what Spark guesses for the fits, more than they are
    try:
        text = plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    sides = re.findall(rf"(?:SortMergeJoin|ShuffledHashJoin|Window) \[[^\]]*\b{key}#", text)
    assert not sides, text  # else all rows of a group go to one task
    assert "BroadcastHashJoin" in text


@pytest.mark.parametrize("name", ["m1_design_matrix", "j13_finite_in_all"])
def test_the_trial_table_is_grouped_once(spark, name):
    text = plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Join" not in text and "pivotfirst" not in text.lower() and len(re.findall(r"Window \[", text)) == 1


def test_keys_finite_in_every_block(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", float("nan")), (3, "a", 1.0), (3, "b", None), (None, "a", 1.0), (None, "b", 1.0), (4, "c", 1.0), (5, "b", 1.0), (5, "a", 3.0), (5, "a", float("inf"))]
    long = spark.createDataFrame(rows, "k int, block string, v double")
    assert sorted(r.k for r in align.in_every_block(long, "block", ["a", "b"], ["k"], "v").collect()) == [1, 5]
    blocks = [long.where(f"block = '{b}'") for b in "ab"]
    assert sorted(r.k for r in align.in_all_blocks(blocks, ["k"], "v").collect()) == [1, 5]


def test_folders_of_a_bundle_do_not_grow_with_subjects(spark, tmp_path):
    df = spark.range(400).selectExpr("id % 50 AS subject", "IF(id % 2 = 0, 'x', 'y') AS family", "'f' AS feature", "CAST(id AS double) AS value")
    files.save_features(df.repartition(2), str(tmp_path / "bundle"))
    assert sorted(p.name for p in (tmp_path / "bundle").iterdir() if p.is_dir()) == ["family=x", "family=y"]
    assert len(list((tmp_path / "bundle").rglob("*.parquet"))) == 4
    back = files.read_parquet(spark, str(tmp_path / "bundle"))
    assert sorted(back.select("subject", "family", "value").collect()) == sorted(df.select("subject", "family", "value").collect())


def test_forest_rows_are_dealt_evenly(spark):
    got = models._dealt_evenly(spark.range(1000).coalesce(1), 100)
    assert [len(p) for p in got.rdd.glom().collect()] == [100] * 10
    assert models._dealt_evenly(spark.range(0), 100).rdd.getNumPartitions() == 1
