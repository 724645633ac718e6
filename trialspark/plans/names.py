"""Queries of the name, filter and role operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names as op
from ..sources.tables import r, rounded, sql

P = "SELECT name, split_part(name, '_', 1) AS \"group\", split_part(name, '_', 2) AS segment, split_part(name, '_', 3) AS band, split_part(name, '_', 4) AS scope, split_part(name, '_', 5) AS identifier, split_part(name, '_', 6) AS stat FROM names"
RULES = [(1, "^power_.*_alpha_", "alpha power"), (2, "^power_", "power"), (3, "_ch_", "channel")]
REGIONS = [("front", "^[01]$"), ("mid", "^[2-5]$"), ("back", "^[4-7]$")]


def _parsed(i):
    return op.parsed(i.names)


def _nuisance(i):
    c = i.frames.select("subject", "run", "frame", F.concat(F.lit("comp_cor_0"), F.col("run").cast("string")).alias("a"), "roi", "value")
    c = c.select("subject", "frame", F.when(F.col("roi") == "tax", F.col("a")).otherwise(F.col("roi")).alias("name"), "value")
    return op.select_nuisance(c, ["^quant", "^disc"], ("comp_cor_0", 4)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 3).alias("total"))


QUERIES = {
    "p1_build_name": (lambda i: _parsed(i).select("name", op.build(*(F.col(c) for c in ("group", "segment", "band", "scope", "identifier", "stat"))).alias("built")), sql("names", "SELECT name, name AS built FROM names")),
    "p2_classify": (lambda i: op.classify(i.names, RULES), sql("names", "SELECT name, CASE WHEN name LIKE 'power!_%!_alpha!_%' ESCAPE '!' THEN 'alpha power' WHEN name LIKE 'power!_%' ESCAPE '!' THEN 'power' WHEN contains(name, '_ch_') THEN 'channel' END AS class FROM names")),
    "p3_filter_band": (lambda i: _parsed(i).where(F.col("band").isin("alpha", "beta")), sql("names", f"SELECT * FROM ({P}) WHERE band IN ('alpha', 'beta')")),
    "p4_filter_category": (lambda i: _parsed(i).join(F.broadcast(i.spark.createDataFrame([("power",), ("erds",)], "group string")), "group", "left_semi"), sql("names", f"SELECT * FROM ({P}) WHERE \"group\" IN ('power', 'erds')")),
    "p5_filter_provenance": (lambda i: _parsed(i).join(F.broadcast(i.spark.createDataFrame([("conn", "baseline")], "group string, segment string")), ["group", "segment"], "left_anti"), sql("names", f"SELECT * FROM ({P}) WHERE NOT (\"group\" = 'conn' AND segment = 'baseline')")),
    "p6_filter_scope": (lambda i: _parsed(i).where(F.col("scope") == "roi"), sql("names", f"SELECT * FROM ({P}) WHERE scope = 'roi'")),
    "p7_columns_by_band": (lambda i: _parsed(i).where(F.col("group") == "power").groupBy("band").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("columns")), sql("names", f"SELECT band, string_agg(name, ',' ORDER BY name) AS columns FROM ({P}) WHERE \"group\" = 'power' GROUP BY band")),
    "p8_first_usable": (lambda i: op.first_usable(i.trials.withColumn("as_text", F.when(F.col("trial_id") % 3 == 0, "n/a").otherwise(F.col("predictor").cast("string"))), ["as_text", "outcome"], "value").select("subject", "trial_id", rounded("value").alias("value")), sql("trials", f"SELECT subject, trial_id, {r('coalesce(CASE WHEN trial_id % 3 <> 0 THEN predictor END, outcome)')} AS value FROM trials")),
    "p9_condition_mask": (lambda i: i.trials.withColumn("side", op.condition_mask(F.col("condition"), "click", "error")).where("side IS NOT NULL").groupBy("subject", "side").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT subject, CASE condition WHEN 'click' THEN 'A' ELSE 'B' END AS side, count(*) AS n FROM trials WHERE condition IN ('click', 'error') GROUP BY ALL")),
    "p10_group_masks": (lambda i: i.trials.where(F.col("condition").isin("click", "error", "view")).groupBy("condition").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT condition, count(*) AS n FROM trials WHERE condition IN ('click', 'error', 'view') GROUP BY ALL")),
    "p11_event_mask": (lambda i: i.trials.where(op.event_mask(F.concat(F.lit(" "), F.upper("condition"), F.lit("  x ")), ["cl", "er"], ["view x"])).groupBy("condition").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT condition, count(*) AS n FROM trials WHERE condition LIKE 'cl%' OR condition LIKE 'er%' OR condition = 'view' GROUP BY ALL")),
    "p12_trial_types": (lambda i: i.trials.where(F.col("condition").isin("click", "view") & ~F.col("condition").isin("view")).select("subject", "trial_id"), sql("trials", "SELECT subject, trial_id FROM trials WHERE condition = 'click'")),
    "p13_phase_scope": (lambda i: i.trials.where(op.phase_scope(F.col("condition"), "click", F.col("run").cast("string"), ["1", "2"])).groupBy("condition", "run").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT condition, run, count(*) AS n FROM trials WHERE condition <> 'click' OR run IN (1, 2) GROUP BY ALL")),
    "p14_remap_events": (lambda i: i.trials.select(op.remap(F.col("run").cast("string"), F.col("condition"), "1.0", "2").alias("trial_type")).groupBy("trial_type").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT CASE run WHEN 1 THEN 'cond_a_' WHEN 2 THEN 'cond_b_' ELSE '' END || condition AS trial_type, count(*) AS n FROM trials GROUP BY ALL")),
    "p15_select_nuisance": (_nuisance, sql("frames", f", c AS (SELECT CASE WHEN roi = 'tax' THEN 'comp_cor_0' || run ELSE roi END AS name, run, roi, value FROM frames) SELECT name, count(*) AS n, {r('sum(coalesce(value, 0))', 3)} AS total FROM c WHERE roi IN ('quantity', 'discount') OR (roi = 'tax' AND run < 4) GROUP BY name")),
    "p16_binarise": (lambda i: i.trials.select("subject", "trial_id", op.binarise(F.col("outcome"), 100.0).alias("y")), sql("trials", "SELECT subject, trial_id, CASE WHEN outcome > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM trials")),
    "p17_channel_regions": (lambda i: op.channel_regions(i.samples.select(F.col("channel").cast("string").alias("channel")).distinct(), REGIONS), sql("samples", "SELECT DISTINCT channel::VARCHAR AS channel, roi FROM samples JOIN (VALUES ('front', 0, 1), ('mid', 2, 5), ('back', 4, 7)) g(roi, a, b) ON channel BETWEEN a AND b")),
    "p18_covariate_report": (lambda i: op.covariate_report(i.wide.withColumn("one", F.lit(1.0)), ["quantity", "price", "one"]), sql("wide", ", l AS (SELECT 'quantity' AS c, quantity AS v FROM wide UNION ALL SELECT 'price', price FROM wide UNION ALL SELECT 'one', 1.0 FROM wide) SELECT c AS \"column\", count(DISTINCT v) AS n_distinct, count(*) - count(v) AS n_null, 0 AS n_inf, count(DISTINCT v) > 1 AS usable FROM l GROUP BY c")),
    "p19_extremes": (lambda i: op.extremes(i.trials, "subject", "predictor", -1, 3).groupBy("subject", "side").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("outcome")).alias("outcome")), sql("trials", f", l AS (SELECT *, round(predictor, -1) AS level FROM trials), m AS (SELECT subject, min(level) AS lo, max(level) AS hi FROM l GROUP BY subject HAVING count(DISTINCT level) >= 3) SELECT subject, CASE WHEN level = lo THEN 'min' ELSE 'max' END AS side, count(*) AS n, {r('avg(outcome)')} AS outcome FROM l JOIN m USING (subject) WHERE level IN (lo, hi) GROUP BY ALL")),
    "p20_keep_events": (lambda i: op.keep_events(i.trials, ["subject", "run"], "^(click|view)", "click").select("subject", "trial_id", rounded("shifted").alias("shifted")), sql("trials", f", z AS (SELECT subject, run, min(onset) AS z FROM trials WHERE condition = 'click' GROUP BY ALL) SELECT subject, trial_id, {r('onset - z')} AS shifted FROM trials JOIN z USING (subject, run) WHERE condition IN ('click', 'view') AND onset >= z")),
}
