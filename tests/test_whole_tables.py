"""Queries without SQL answer for all rows of their tables, not for a subset of the ids."""

from trialspark.plans import catalog

FOLDER = "/root/testdata/sf0.01"  # the smallest with more ids than the former filters kept


def test_bootstrap_d_covers_all_subjects(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    both = events.groupBy("user_id").pivot("event_type", ["click", "view"]).count().where("click > 0 AND view > 0")
    got = {r.subject for r in catalog.queries()["e4_bootstrap_d"](spark, FOLDER).collect()}
    assert {r.user_id for r in both.collect()} <= got


def test_models_predict_all_held_out_rows(spark):
    held = catalog.queries()["m9_elastic_net"](spark, FOLDER).groupBy().sum("n").first()[0]
    votes = catalog.queries()["m12_soft_vote"](spark, FOLDER).groupBy().sum("n").first()[0]
    assert held == votes == spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_suppkey % 4 = 0").count()
