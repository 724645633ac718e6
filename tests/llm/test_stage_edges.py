"""Filtering and mixing stages on repeated rows, clashing columns and empty tables."""

import collections

import pytest
from pyspark.sql import functions as F

from trialspark.llm import exact_dedup, mixing, near_dedup, quality_rules

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("shard", "__key", "__id", "__copy", "__hash", "__digest", "row_key", "kept", "copies", "rank", "block", "size")


def test_mix_of_identical_rows_keeps_the_cap(spark):
    rows = [(1, "a b c", "en", "s", 5)] * 4 + [(k, "x y z w", "en", "t", 7) for k in range(10, 30)]
    df = spark.createDataFrame(rows, FIELDS)
    taken = sum(r.copies for r in mixing.mix_plan(df, shards=2).collect() if r.doc_id == 1)
    mixed = mixing.mix(df, shards=2).collect()
    assert sum(r.doc_id == 1 for r in mixed) == taken <= 12
    assert all(n <= 3 for i, n in collections.Counter(r.doc_id for r in mixed).items() if i != 1)


def test_mix_of_rows_that_differ_in_other_columns_only(spark):
    rows = [(None if k % 2 else 1, "a b c", "en", "s", k) for k in range(6)] + [(k, "x y z w", "en", None, 7) for k in range(10, 20)]
    df = spark.createDataFrame(rows, FIELDS)
    plan = mixing.mix_plan(df, shards=3).collect()
    mixed = mixing.mix(df, shards=3)
    assert mixed.count() == sum(r.copies for r in plan)
    assert all(r["count"] <= 3 for r in mixed.groupBy(*df.columns).count().collect())
    assert sorted(set(r.shard for r in mixed.collect())) <= [0, 1, 2]


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "mix"])
def test_stages_bear_clashing_columns_and_empty_tables(spark, stage):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, f"{text} {k}", "en", f"s{k % 3}", 0) for k in range(30)] + [(31, f"{text} 1", "en", "s1", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("x") for c in CLASHES})
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(30)], "doc_id long, quality int, toxic int")
    apply = {
        "quality": lambda d: quality_rules.keep_good(d, labels),
        "exact": exact_dedup.drop_exact_copies,
        "near": lambda d: near_dedup.drop_near_copies(d, near_dedup.NearParams()),
        "mix": lambda d: mixing.mix(d, shards=2),
    }[stage]
    out = apply(docs)
    assert set(out.columns) == set(docs.columns)
    plain = apply(docs.drop(*CLASHES))
    rows_of = lambda d: sorted(map(repr, d.select("doc_id", "text", "source").collect()))
    if stage == "mix":  # a row's other columns are part of what it is known by, so only its place among the copies may differ
        assert out.count() == plain.count() and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        assert mixing.mix(out.drop(*set(CLASHES) - {"shard"}), shards=2).count() > 0  # a mixed table can be mixed again
    else:
        assert rows_of(out) == rows_of(plain)
    assert apply(docs.where("doc_id = -5")).count() == 0
