"""Queries of the join and alignment operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align as op
from ..sources.tables import r, rounded, sql

NAMES = ["quantity", "price", "discount", "tax"]


def _trial_part(i, column, kept):
    return i.trials.where(kept).select("subject", F.col("run").alias("run_id"), F.col("trial_id").alias("trial"), column)


def _numbered(i):
    o = i.raw("orders").select(F.col("o_custkey").alias("subject"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("double").alias("onset"), F.col("o_totalprice").alias("price"))
    return o


def _positions(i):
    left = _numbered(i)
    right = left.select("subject", F.col("o_orderkey").alias("k2"), (F.col("onset") * 1.001).alias("onset2"))
    return op.by_position(left, right, ["subject"], ["onset", "o_orderkey"], ["onset2", "k2"])


def _offset(i):
    w = Window.partitionBy("subject").orderBy("onset", "o_orderkey")
    e = _numbered(i).withColumn("place", F.row_number().over(w))
    b = e.where("place > 2").select("subject", (F.col("place") - 2).alias("place"), (F.col("onset") + 5).alias("onset"))
    return op.best_offset(e, b, ["subject"], 4)


OFFSET_SQL = """e AS (SELECT o_custkey AS subject, epoch(o_orderdate) / 86400.0 AS onset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
    b AS (SELECT subject, place - 2 AS place, onset + 5 AS onset FROM e WHERE place > 2),
    s AS (SELECT b.subject, k AS start, b.place + k AS place, b.onset FROM b, (SELECT unnest(range(4)) AS k)),
    o AS (SELECT s.subject, start, abs((e.onset - first_value(e.onset) OVER w) - (s.onset - first_value(s.onset) OVER w)) AS off FROM s JOIN e ON s.subject = e.subject AND s.place = e.place WINDOW w AS (PARTITION BY s.subject, start ORDER BY s.place)),
    f AS (SELECT subject, start, median(off) AS median, quantile_cont(off, 0.95) AS p95 FROM o GROUP BY ALL)
    SELECT subject, median, p95, start::INT AS start FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY median, p95, start) AS k FROM f) WHERE k = 1"""

QUERIES = {
    "j1_trial_table": (lambda i: op.trial_table(i.wide.select("subject", "trial_id", "run"), i.features, ["subject", "trial_id"], NAMES), sql("wide", "SELECT subject, trial_id, run, quantity, price, discount, tax FROM wide")),
    "j2_align_features": (lambda i: i.trials.select("subject", op.checked_key("trial_id").alias("trial_id"), "outcome").join(i.trials.where("trial_id % 2 = 0").select("subject", "trial_id", F.col("predictor").alias("feature")), ["subject", "trial_id"], "left"), sql("trials", "SELECT subject, trial_id, outcome, CASE WHEN trial_id % 2 = 0 THEN predictor END AS feature FROM trials")),
    "j3_outer_merge": (lambda i: op.outer_merge(i.trials.where("outcome <= 80").select("subject", "trial_id", "outcome"), i.trials.where("outcome >= 20").select("subject", "trial_id", (F.col("outcome") + 1).alias("outcome"), "run"), ["subject", "trial_id"]), sql("trials", "SELECT subject, trial_id, CASE WHEN outcome <= 80 THEN outcome ELSE outcome + 1 END AS outcome, CASE WHEN outcome >= 20 THEN run END AS run FROM trials WHERE outcome IS NOT NULL")),
    "j3_merge_tables": (lambda i: op.merge_tables([_trial_part(i, "outcome", F.col("outcome") <= 80), _trial_part(i, "predictor", F.col("outcome") >= 20), _trial_part(i, "onset", F.col("predictor") >= 50)]), sql("trials", "SELECT subject, run AS run_id, trial_id AS trial, CASE WHEN outcome <= 80 THEN outcome END AS outcome, CASE WHEN outcome >= 20 THEN predictor END AS predictor, CASE WHEN predictor >= 50 THEN onset END AS onset FROM trials WHERE outcome <= 80 OR outcome >= 20 OR predictor >= 50")),
    "j4_union_blocks": (lambda i: op.union_blocks([i.features.where("feature = 'tax'").drop("condition"), i.features.where("feature = 'price'").drop("run")]).groupBy("feature", "condition", "run").agg(F.count(F.lit(1)).alias("n")), sql("features", "SELECT feature, CASE WHEN feature = 'price' THEN condition END AS condition, CASE WHEN feature = 'tax' THEN run END AS run, count(*) AS n FROM features WHERE feature IN ('tax', 'price') GROUP BY ALL")),
    "j4_overlap": (lambda i: op.overlapping([i.features.where("feature <> 'tax'"), i.features.where("feature <> 'price'")]), sql("features", "SELECT DISTINCT feature, 2 AS blocks FROM features WHERE feature IN ('quantity', 'discount')")),
    "j5_one_to_one": (lambda i: op.one_to_one(i.wide.select("subject", "trial_id", "price", "tax"), i.wide.select("subject", "trial_id", "price", "discount"), ["subject", "trial_id"], ["price"]), sql("wide", "SELECT subject, trial_id, price, tax, discount FROM wide")),
    "j5_three_tables": (lambda i: op.merge_one_to_one([i.wide.select("subject", "trial_id", "condition", "price", "tax"), i.wide.where("tax > 0").select("subject", "trial_id", "price", "discount"), i.wide.where("discount > 0").select("subject", "trial_id", "condition", "tax", "quantity")], ["subject", "trial_id"]), sql("wide", "SELECT subject, trial_id, condition, price, tax, discount, quantity FROM wide WHERE tax > 0 AND discount > 0")),
    "j6_concatenate_runs": (lambda i: op.concatenate_runs(i.trials, "subject", "run", "onset").select("subject", "trial_id", rounded("time", 3).alias("time")), sql("trials", f", s AS (SELECT subject, run, max(onset) AS m FROM trials GROUP BY ALL), o AS (SELECT subject, run, coalesce(sum(m) OVER (PARTITION BY subject ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM s) SELECT subject, trial_id, {r('onset + o', 3)} AS time FROM trials JOIN o USING (subject, run)")),
    "j7_kept_trials": (lambda i: op.kept_trials(i.trials, i.trials.where("outcome < 60"), ["subject", "trial_id"], ["subject"], ["trial_id"]).select("subject", "trial_id", "dense_id"), sql("trials", "SELECT subject, trial_id, (row_number() OVER (PARTITION BY subject ORDER BY trial_id) - 1)::INT AS dense_id FROM trials WHERE outcome < 60")),
    "j8_by_position": (lambda i: _positions(i).select("subject", "place", "o_orderkey", "k2"), sql("", "SELECT o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, o_orderkey, o_orderkey AS k2 FROM orders")),
    "j9_interval_qc": (lambda i: op.interval_qc(_positions(i), ["subject"], "onset", "onset2").select("subject", rounded("median_error").alias("median_error"), rounded("p95_error").alias("p95_error"), "n"), sql("", f"WITH d AS (SELECT o_custkey AS subject, epoch(o_orderdate) / 86400.0 AS d, o_orderkey FROM orders), o AS (SELECT subject, abs((d - lag(d) OVER w) - (d * 1.001 - lag(d * 1.001) OVER w)) AS off FROM d WINDOW w AS (PARTITION BY subject ORDER BY d, o_orderkey)) SELECT subject, {r('median(off)')} AS median_error, {r('quantile_cont(off, 0.95)')} AS p95_error, count(off) AS n FROM o GROUP BY subject")),
    "j10_best_offset": (_offset, "WITH " + OFFSET_SQL),
    "j11_bad_channels": (lambda i: op.union_flag(i.samples, ["subject", "channel"], F.abs("x") > 0.35), sql("samples", "SELECT subject, channel, bool_or(abs(x) > 0.35) AS bad FROM samples GROUP BY ALL")),
    "j12_subject_union": (lambda i: op.subject_sets([i.trials.where("outcome > 300"), i.trials.where("predictor > 95")], "union"), sql("trials", "SELECT DISTINCT subject FROM trials WHERE outcome > 300 OR predictor > 95")),
    "j12_subject_intersection": (lambda i: op.subject_sets([i.trials.where("outcome > 300"), i.trials.where("predictor > 95")], "intersection"), sql("trials", "SELECT subject FROM trials WHERE outcome > 300 INTERSECT SELECT subject FROM trials WHERE predictor > 95")),
    "j13_finite_in_all": (lambda i: op.in_every_block(i.features.where("value > 0"), "feature", ["tax", "discount"], ["subject", "trial_id"], "value"), sql("wide", "SELECT subject, trial_id FROM wide WHERE tax > 0 AND discount > 0")),
    "j14_single_trial_events": (lambda i: op.single_trial_events(i.trials.select("subject", "run", "trial_id", "onset"), ["subject", "run"], "trial_id").groupBy("subject", "run", "role").agg(F.count(F.lit(1)).alias("n")), sql("trials", "SELECT a.subject, a.run, CASE WHEN a.trial_id = b.trial_id THEN 'target' ELSE 'other' END AS role, count(*) AS n FROM trials a JOIN trials b ON a.subject = b.subject AND a.run = b.run GROUP BY ALL")),
    "j15_common_channels": (lambda i: op.common_to_all(i.samples.where("x > 0.0"), "subject", "channel"), sql("samples", "SELECT channel, count(DISTINCT subject) AS n FROM samples WHERE x > 0.0 GROUP BY channel HAVING count(DISTINCT subject) = (SELECT count(DISTINCT subject) FROM samples WHERE x > 0.0)")),
    "j16_trial_key": (lambda i: i.trials.select("subject", "trial_id", op.trial_key(F.concat(F.lit("run-"), "run", F.lit("_trial-"), "trial_id")).alias("key")), sql("trials", "SELECT subject, trial_id, printf('%d|trial-%03d', run, trial_id) AS key FROM trials")),
    "j17_attach_scores": (lambda i: i.trials.join(i.trials.where("trial_id % 2 = 0").select("subject", "run", "trial_id", F.col("predictor").alias("s1")), ["subject", "run", "trial_id"], "left").join(i.trials.where("trial_id % 3 = 0").select("subject", "run", "trial_id", (-F.col("predictor")).alias("s2")), ["subject", "run", "trial_id"], "left").select("subject", "trial_id", F.coalesce("s1", "s2").alias("score")), sql("trials", "SELECT subject, trial_id, CASE WHEN trial_id % 2 = 0 THEN predictor WHEN trial_id % 3 = 0 THEN -predictor END AS score FROM trials")),
}
