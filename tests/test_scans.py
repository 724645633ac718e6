"""Two-level scans against plain sorting, with one family of nearly all rows over many parts."""

import random

import pytest
from pyspark.sql import functions as F

from trialspark.operators import scans, stats, windows


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 10 else None, k, rng.choice([round(rng.random() ** 4, 3), 0.01, 1.0, None, float("nan")])) for k in range(3000)]
    rows += [("lone", 5000, 0.3), ("none", 5001, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "part string, i int, p double").withColumnRenamed("part", "family")
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def families(rows, drop_nan=True):
    out = {}
    for f, i, p in rows:
        if p is not None and not (drop_nan and p != p):
            out.setdefault(f, []).append((p, i))
    return {f: sorted(v) for f, v in out.items()}


def test_parts_spread_a_hot_group(made):
    _, df = made
    parts = scans.parted(df, ["family"], ["p", "i"]).where("family = 'hot'").groupBy("__part").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 1000


def test_benjamini_hochberg_and_simes(made):
    rows, df = made
    want, simes = {}, {}
    for f, v in families(rows).items():
        low = 1.0
        for k in range(len(v), 0, -1):
            low = min(low, v[k - 1][0] * len(v) / k)
            want[f, v[k - 1][1]] = low
        simes[f] = min(p * len(v) / k for k, (p, _) in enumerate(v, 1))
    got = {(r.family, r.i): r.q for r in stats.benjamini_hochberg(df, "p", ["family"], ["i"]).collect()}
    assert len(got) == len(rows)
    assert all(q == (pytest.approx(want[k]) if k in want else None) for k, q in got.items())
    assert {r.family: r.family_p for r in stats.simes(df, "p", ["family"]).collect()} == pytest.approx(simes)


def test_holm_over_parts(made):
    rows, df = made
    df = df.where("NOT isnan(p) OR p IS NULL")
    want = {}
    for f, v in families(rows).items():
        top = 0.0
        for k, (p, i) in enumerate(v, 1):
            top = max(top, min(1.0, (len(v) - k + 1) * p))
            want[f, i] = top
    got = {(r.family, r.i): r.p_holm for r in stats.holm(df, "p", ["family"], ["i"]).collect()}
    assert got.keys() >= want.keys() and all(v == (pytest.approx(want[k]) if k in want else None) for k, v in got.items())


def test_average_ranks_with_ties_and_nulls(made):
    rows, df = made
    df = df.where("NOT isnan(p) OR p IS NULL")
    got = {(r.family, r.i): r.scaled for r in windows.rank_normalise(df, "p", ["family"]).collect()}
    for f, v in families(rows).items():
        values = [p for p, _ in v]
        first, count = {}, {}
        for k, p in enumerate(values):
            first.setdefault(p, k)
            count[p] = count.get(p, 0) + 1
        for p, i in v:
            rank = first[p] + (count[p] - 1) / 2
            assert got[f, i] == (pytest.approx(rank / (len(v) - 1)) if len(v) > 1 else None)
    assert got["none", 5001] is None


def test_nothing_to_scan(made):
    _, df = made
    empty = df.where("i < 0")
    assert stats.benjamini_hochberg(empty, "p", ["family"], ["i"]).count() == stats.holm(empty, "p", ["family"], ["i"]).count() == 0
    assert windows.rank_normalise(empty, "p", ["family"]).count() == 0
    only = df.where("p IS NULL")
    assert {r.q for r in stats.benjamini_hochberg(only.withColumn("all", F.lit(1)), "p", ["all"], ["i"]).collect()} == {None}


@pytest.fixture
def small_parts(spark, monkeypatch):
    """Parts of about 200 rows in a session of two shuffle partitions; the rows of each part of each table that is parted."""
    monkeypatch.setattr(scans, "PART_ROWS", 200, raising=False)
    old, plain, sizes = spark.conf.get("spark.sql.shuffle.partitions"), scans.parted, []

    def seen(*args):
        rows = plain(*args)
        sizes.append([r["count"] for r in rows.groupBy("__part").count().collect()])
        return rows

    monkeypatch.setattr(scans, "parted", seen)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield sizes
    spark.conf.set("spark.sql.shuffle.partitions", old)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ranks_in_parts_that_do_not_grow(spark, small_parts):
    rows = [(None if i % 50 == 0 else "hot", i, None if i % 7 == 0 else float(i * 37 % 500)) for i in range(3000)]
    got = windows.rank_normalise(spark.createDataFrame(rows, "g string, i int, v double"), "v", ["g"])
    assert "Join" not in plan(got)
    in_task = [r["count"] for r in got.where("v IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert max(map(max, [*small_parts, in_task])) <= 400 and len(in_task) >= 8
    found = {r.i: r.scaled for r in got.collect()}
    for g in (None, "hot"):
        own = sorted(v for k, _, v in rows if k == g and v is not None)
        first, count = {}, {}
        for k, v in enumerate(own):
            first.setdefault(v, k)
            count[v] = count.get(v, 0) + 1
        for k, i, v in rows:
            if k == g:
                assert found[i] == (None if v is None else pytest.approx((first[v] + (count[v] - 1) / 2) / (len(own) - 1)))


def test_hierarchical_fdr_in_parts_that_do_not_grow(spark, small_parts):
    rng = random.Random(5)
    rows = [(f, t, None if t == 2 and f % 9 == 0 else round(rng.random() ** (8 if f % 4 == 0 else 1), 4)) for f in range(700) for t in range(3)]
    got = stats.hierarchical_fdr(spark.createDataFrame(rows, "f int, t int, p double"), "p", "f", ["t"])
    assert max(map(max, small_parts)) <= 400 and len(small_parts) == 2  # the rows once, the families once
    assert plan(got).split("== Physical Plan ==")[1].count("Join") == 1  # of the families to their rows
    want, simes = {}, []
    for f, v in families(rows).items():
        low = 1.0
        for k in range(len(v), 0, -1):
            low = min(low, v[k - 1][0] * len(v) / k)
            want[f, v[k - 1][1]] = low
        simes.append((min(p * len(v) / k for k, (p, _) in enumerate(v, 1)), f))
    low, gate = 1.0, {}
    for k, (p, f) in reversed([*enumerate(sorted(simes), 1)]):
        gate[f] = low = min(low, p * len(simes) / k)
    found = {(r.f, r.t): r for r in got.collect()}
    assert len(found) == len(rows) and any(r.reject for r in found.values())
    for (f, t), r in found.items():
        q = want.get((f, t))
        assert r.q == (None if q is None else pytest.approx(q)) and r.family_q == pytest.approx(gate[f])
        assert r.reject == (q is not None and q < 0.05 and gate[f] < 0.05)
