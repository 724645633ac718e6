"""Queries of the sources, sinks, contracts and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as op
from ..operators import names
from ..operators.windows import moment_corr
from ..sources import files
from ..sources.tables import r, rounded, sql
from ..storage import scratch

REGIONS = [(0, "front"), (1, "front"), (2, "mid"), (3, "mid"), (3, "back"), (4, "back")]
REG_SQL = "(VALUES (0, 'front'), (1, 'front'), (2, 'mid'), (3, 'mid'), (3, 'back'), (4, 'back')) g(channel, roi)"


def _tsv(i):
    path = scratch(i.spark)
    t = i.trials.select("subject", "trial_id", "condition", F.when(F.col("trial_id") % 5 > 0, F.col("predictor")).alias("predictor"))
    files.write_tsv(t, path)
    return files.read_tsv(i.spark, path, t.schema)


def _csv(i):
    path = scratch(i.spark)
    t = i.trials.select("subject", "trial_id", "outcome")
    files.write_csv(t, path)
    return i.spark.read.csv(path, header=True, schema=t.schema)


def _bundle(i):
    path = scratch(i.spark)
    files.save_features(i.features.withColumn("family", F.when(F.col("feature").isin("tax", "discount"), "rate").otherwise("amount")).drop("condition"), path)
    return files.read_parquet(i.spark, path).where("family = 'rate'").groupBy("subject", "feature").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))


def _manifest(i):
    p = names.parsed(i.names)
    return p.select("name", F.to_json(F.struct("group", "segment", "band", "scope", "identifier", "stat")).alias("parts"))


def _edges(i):
    return i.samples.select("subject", F.col("channel").alias("src"), ((F.col("channel") + 1) % 8).alias("dst"), "x")


def _dummies(i):
    return op.run_dummies(i.trials.select("subject", "trial_id", "run"), "run", [1, 2, 3, 4])


def _stats(prefix=""):
    return f"count(outcome) AS n, count(*) - count(outcome) AS n_missing, {r('avg(outcome)')} AS mean, {r('stddev_samp(outcome)')} AS std, min(outcome) AS min, {r('median(outcome)')} AS median, max(outcome) AS max"


QUERIES = {
    "s1_read_tsv": (_tsv, sql("trials", "SELECT subject, trial_id, condition, CASE WHEN trial_id % 5 > 0 THEN predictor END AS predictor FROM trials")),
    "s2_parquet": (lambda i: i.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "s3_write_csv": (_csv, sql("trials", "SELECT subject, trial_id, outcome FROM trials")),
    "s6_catalogue": (lambda i: files.catalogue(i.features, ["subject", "run"]), sql("features", 'SELECT subject, run, count(*) AS "rows", count(DISTINCT feature) AS columns FROM features GROUP BY ALL')),
    "s7_feature_bundle": (_bundle, sql("features", f"SELECT subject, feature, count(*) AS n, {r('sum(value)')} AS total FROM features WHERE feature IN ('tax', 'discount') GROUP BY ALL")),
    "s8_identical_columns": (lambda i: files.identical_columns(i.wide.withColumn("copy", F.col("tax")), ["price", "tax", "copy"]), sql("wide", "SELECT 'price' AS \"first\", 'tax' AS \"second\", count(*) FILTER (price IS DISTINCT FROM tax) AS n_different, count(*) FILTER (price IS DISTINCT FROM tax) = 0 AS identical FROM wide UNION ALL SELECT 'price', 'copy', count(*) FILTER (price IS DISTINCT FROM tax), count(*) FILTER (price IS DISTINCT FROM tax) = 0 FROM wide UNION ALL SELECT 'tax', 'copy', 0, true")),
    "s9_dropped_trials": (lambda i: files.dropped(i.trials.select("subject", "trial_id", "outcome"), i.trials.where("outcome < 100"), ["subject", "trial_id"]), sql("trials", "SELECT subject, trial_id, outcome FROM trials WHERE NOT outcome < 100")),
    "s10_manifest": (_manifest, sql("names", "SELECT name, '{\"group\":\"' || split_part(name, '_', 1) || '\",\"segment\":\"' || split_part(name, '_', 2) || '\",\"band\":\"' || split_part(name, '_', 3) || '\",\"scope\":\"' || split_part(name, '_', 4) || '\",\"identifier\":\"' || split_part(name, '_', 5) || '\",\"stat\":\"' || split_part(name, '_', 6) || '\"}' AS parts FROM names")),
    "s11_contract": (lambda i: files.compare_contracts(files.contract(i.wide, "subject", "trial_id"), files.contract(i.wide.where("subject % 10 > 0 OR trial_id > 1"), "subject", "trial_id"), "subject"), sql("wide", 'SELECT subject, count(*) AS rows_now, count(*) FILTER (subject % 10 > 0 OR trial_id > 1) AS rows_stored, subject % 10 > 0 AS same FROM wide GROUP BY subject')),
    "s12_validate": (lambda i: files.validate(i.trials.withColumn("p", F.when(F.col("predictor") > 50, F.col("predictor"))), "subject", ["outcome", "p"], ["p"]).select("subject", rounded("outcome").alias("outcome"), rounded("p").alias("p"), rounded("any_of").alias("any_of")), sql("trials", f"SELECT subject, 1.0::DOUBLE AS outcome, {r('count(*) FILTER (predictor > 50) / count(*)')} AS p, {r('count(*) FILTER (predictor > 50) / count(*)')} AS any_of FROM trials GROUP BY subject")),
    "s13_outputs_manifest": (lambda i: files.outputs_manifest({"trials": i.trials, "samples": i.samples, "wide": i.wide}), sql("trials samples wide", "SELECT 'trials' AS \"table\", count(*) AS \"rows\" FROM trials UNION ALL SELECT 'samples', count(*) FROM samples UNION ALL SELECT 'wide', count(*) FROM wide")),
    "s14_coverage": (lambda i: files.coverage(i.features.where("subject % 3 > 0 OR feature = 'tax'"), i.features).select("feature", "subjects", rounded("percent").alias("percent")), sql("features", f"SELECT feature, count(DISTINCT subject) AS subjects, {r('100.0 * count(DISTINCT subject) / (SELECT count(DISTINCT subject) FROM features)')} AS percent FROM features WHERE subject % 3 > 0 OR feature = 'tax' GROUP BY feature")),
    "s15_selection_report": (lambda i: files.selection_report(i.raw("customer").select(F.col("c_custkey").alias("subject")), i.raw("orders").select(F.col("o_custkey").alias("subject")), i.raw("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("subject"), F.lit("debt").alias("reason"))), "SELECT c_custkey AS subject, o.k IS NOT NULL AS included, CASE WHEN o.k IS NULL THEN CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'no data' END END AS reason FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey"),
    "s16_participants": (lambda i: files.complete_participants(i.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("subject"), "c_mktsegment"), i.raw("orders").select(F.col("o_custkey").alias("subject"))), "SELECT c_custkey AS subject, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"),
    "g1_run_means": (lambda i: i.trials.groupBy("subject", "run").agg(rounded(F.avg("outcome")).alias("outcome"), rounded(F.avg("predictor")).alias("predictor"), F.count(F.lit(1)).alias("n")), sql("trials", f"SELECT subject, run, {r('avg(outcome)')} AS outcome, {r('avg(predictor)')} AS predictor, count(*) AS n FROM trials GROUP BY ALL")),
    "g2_condition_cells": (lambda i: i.trials.groupBy("subject", "run", "condition").agg(rounded(F.avg("outcome")).alias("mean"), F.count(F.lit(1)).alias("n")), sql("trials", f"SELECT subject, run, condition, {r('avg(outcome)')} AS mean, count(*) AS n FROM trials GROUP BY ALL")),
    "g3_spatial_scopes": (lambda i: op.spatial_scopes(i.samples, i.spark.createDataFrame(REGIONS, "channel int, roi string"), ["trial_id"], "x").select("trial_id", "scope", "identifier", rounded("value").alias("value")), sql("samples", f"SELECT trial_id, 'ch' AS scope, channel::VARCHAR AS identifier, {r('avg(x)')} AS value FROM samples GROUP BY ALL UNION ALL SELECT trial_id, 'roi', roi, {r('avg(x)')} FROM samples JOIN {REG_SQL} USING (channel) GROUP BY ALL UNION ALL SELECT trial_id, 'global', 'all', {r('avg(x)')} FROM samples GROUP BY ALL")),
    "g4_masked_mean": (lambda i: op.masked_mean(i.samples.withColumn("y", F.when(F.col("x") > -0.2, F.col("x"))), ["trial_id"], "y", F.col("t") >= 0).select("trial_id", rounded("mean").alias("mean"), rounded("finite_share").alias("finite_share")), sql("samples", f"SELECT trial_id, {r('avg(x) FILTER (t >= 0 AND x > -0.2)')} AS mean, {r('count(*) FILTER (t >= 0 AND x > -0.2) / count(*) FILTER (t >= 0)')} AS finite_share FROM samples GROUP BY trial_id")),
    "g5_series_statistics": (lambda i: op.series_statistics(i.trials, ["subject"], "outcome").select("subject", "n", "n_missing", rounded("mean").alias("mean"), rounded("std").alias("std"), "min", rounded("median").alias("median"), "max"), sql("trials", f"SELECT subject, {_stats()} FROM trials GROUP BY subject")),
    "g6_behaviour_qc": (lambda i: i.trials.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.when(F.col("condition") == "click", F.col("outcome"))) - F.avg(F.when(F.col("condition") == "error", F.col("outcome")))).alias("contrast"), rounded(moment_corr(F.col("predictor"), F.col("outcome"))).alias("r")), sql("trials", f"SELECT subject, count(*) AS n, {r('avg(outcome) FILTER (condition = $$click$$) - avg(outcome) FILTER (condition = $$error$$)')} AS contrast, {r('corr(predictor, outcome)')} AS r FROM trials GROUP BY subject")),
    "g7_complete_units": (lambda i: op.complete_units(i.wide, ["subject", "condition"], "run", "quantity", 7).select("subject", "condition", "run", rounded("value").alias("value")), sql("wide", f", c AS (SELECT subject, condition, run, avg(quantity) AS v FROM wide GROUP BY ALL) SELECT subject, condition, run, {r('v')} AS value FROM c WHERE (subject, condition) IN (SELECT (subject, condition) FROM c GROUP BY subject, condition HAVING count(*) = 7)")),
    "g8_importance": (lambda i: op.importance(i.features, ["feature", "condition"], "value").select("feature", "condition", rounded("total", 2).alias("total"), rounded("mean").alias("mean"), "n", rounded("share").alias("share")), sql("features", f"SELECT feature, condition, {r('sum(value)', 2)} AS total, {r('avg(value)')} AS mean, count(*) AS n, {r('sum(value) / sum(sum(value)) OVER ()')} AS share FROM features GROUP BY feature, condition")),
    "g9_inverse_variance": (lambda i: op.inverse_variance_mean(i.wide, ["subject"], "quantity", "price").select("subject", rounded("effect").alias("effect"), rounded("variance").alias("variance")), sql("wide", f"SELECT subject, {r('sum(quantity / price) / sum(1 / price)')} AS effect, {r('1 / sum(1 / price)')} AS variance FROM wide GROUP BY subject")),
    "g10_area_weighted": (lambda i: op.area_weighted(i.wide, ["subject"], "price", "tax", "quantity").select("subject", rounded("mean", 3).alias("mean"), rounded("variance", 8).alias("variance")), sql("wide", f"SELECT subject, {r('sum(quantity * price) / sum(quantity)', 3)} AS mean, {r('sum(quantity * quantity * tax) / power(sum(quantity), 2)', 8)} AS variance FROM wide GROUP BY subject")),
    "g11_adjacency": (lambda i: op.adjacency(_edges(i), ["subject"], "x").select("subject", "src", "dst", rounded("w").alias("w")), sql("samples", f", m AS (SELECT subject, channel AS s, (channel + 1) % 8 AS d, {r('avg(x)')} AS w FROM samples GROUP BY ALL) SELECT subject, s AS src, d AS dst, w FROM m UNION ALL SELECT subject, d, s, w FROM m")),
    "g12_preprocessing_summary": (lambda i: i.trials.groupBy("subject").agg(*(F.count_if((F.col("condition") == c) & (F.col("outcome") < 100)).alias(f"kept_{c}") for c in ("click", "error")), *(F.count_if((F.col("condition") == c) & (F.col("outcome") >= 100)).alias(f"removed_{c}") for c in ("click", "error"))), sql("trials", "SELECT subject, count(*) FILTER (condition = 'click' AND outcome < 100) AS kept_click, count(*) FILTER (condition = 'error' AND outcome < 100) AS kept_error, count(*) FILTER (condition = 'click' AND outcome >= 100) AS removed_click, count(*) FILTER (condition = 'error' AND outcome >= 100) AS removed_error FROM trials GROUP BY subject")),
    "g13_subject_cells": (lambda i: i.trials.groupBy("subject", "condition").agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("run").alias("n_runs")).withColumn("status", F.when((F.col("n_trials") >= 10) & (F.col("n_runs") >= 3), "ok").otherwise("too few")), sql("trials", "SELECT subject, condition, count(*) AS n_trials, count(DISTINCT run) AS n_runs, CASE WHEN count(*) >= 10 AND count(DISTINCT run) >= 3 THEN 'ok' ELSE 'too few' END AS status FROM trials GROUP BY ALL")),
    "g14_binned_statistics": (lambda i: op.binned_statistics(i.trials, "predictor", "outcome", 10).select("bin", "n", rounded("mean").alias("mean"), rounded("se").alias("se")), sql("trials", f"SELECT least(9, floor((predictor - lo) * 10 / (hi - lo)))::INT AS bin, count(*) AS n, {r('avg(outcome)')} AS mean, {r('stddev_samp(outcome) / sqrt(count(outcome))')} AS se FROM trials, (SELECT min(predictor) AS lo, max(predictor) AS hi FROM trials) GROUP BY ALL")),
    "g15_conditions": (lambda i: i.trials.select("condition").distinct(), sql("trials", "SELECT DISTINCT condition FROM trials")),
    "g16_run_dummies": (_dummies, sql("trials", "SELECT subject, trial_id, run, (run = 2)::INT::DOUBLE AS run_2, (run = 3)::INT::DOUBLE AS run_3, (run = 4)::INT::DOUBLE AS run_4 FROM trials")),
}
