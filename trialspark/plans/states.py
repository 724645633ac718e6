"""Queries of map states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extended as ext
from ..operators import microstates as op
from ..sources.tables import r, rounded, sql

KEYS = ["trial_id"]


def _templates(i):
    """The mean maps of three groups of conditions."""
    mean = i.samples.groupBy((F.col("condition") % 3).cast("int").alias("state"), "channel").agg(F.avg("x").alias("x"))
    return op.unit_maps(mean, ["state"], "channel", "x")


def _states(i, templates):
    return op.microstates(i.samples, templates, KEYS, "sample_idx", "channel", "x", least=2)


def _fitted(i):
    peaks = op.field_peaks(i.samples, KEYS, "sample_idx", "x").select("trial_id", "sample_idx")
    maps = op.unit_maps(i.samples.join(peaks, ["trial_id", "sample_idx"]), ["trial_id", "sample_idx"], "channel", "x")
    states = _states(i, op.fit_templates(maps, ["trial_id", "sample_idx"], "channel", list(range(8)), 4))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _metrics(i):
    m = ext.state_metrics(_states(i, _templates(i)), KEYS, "sample_idx", "state")
    return m.select("trial_id", "state", "visits", rounded("coverage").alias("coverage"), rounded("dwell").alias("dwell"))


STATES = """, g AS (SELECT trial_id, sample_idx AS k, stddev_pop(x) AS gfp FROM samples GROUP BY ALL),
    pk AS (SELECT trial_id, k FROM (SELECT *, lag(gfp) OVER w AS p, lead(gfp) OVER w AS q FROM g WINDOW w AS (PARTITION BY trial_id ORDER BY k)) WHERE gfp > p AND gfp > q),
    al AS (SELECT trial_id, k FROM pk UNION ALL SELECT trial_id, arg_max(k, gfp) FROM g WHERE trial_id NOT IN (SELECT trial_id FROM pk) GROUP BY trial_id),
    mm AS (SELECT condition % 3 AS state, channel, avg(x) AS x FROM samples GROUP BY ALL), mc AS (SELECT state, channel, x - avg(x) OVER (PARTITION BY state) AS x FROM mm), tm AS (SELECT state, channel, x / sqrt(sum(x * x) OVER (PARTITION BY state)) AS w FROM mc),
    z AS (SELECT trial_id, sample_idx AS k, channel, x - avg(x) OVER (PARTITION BY trial_id, sample_idx) AS x FROM samples),
    si AS (SELECT al.trial_id, al.k, state, abs(sum(z.x * w)) AS s FROM al JOIN z ON z.trial_id = al.trial_id AND z.k = al.k JOIN tm USING (channel) GROUP BY ALL),
    ps AS (SELECT trial_id, k, arg_max(state, s) AS state FROM si GROUP BY ALL),
    st AS (SELECT trial_id, state, coalesce((lag(k) OVER (PARTITION BY trial_id ORDER BY k) + k) // 2, 0) AS start FROM ps),
    lb AS (SELECT g.trial_id, g.k, st.state FROM g ASOF JOIN st ON g.trial_id = st.trial_id AND g.k >= st.start),
    ch AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY trial_id ORDER BY k) = state THEN 0 ELSE 1 END AS c FROM lb),
    ru AS (SELECT *, sum(c) OVER (PARTITION BY trial_id ORDER BY k) AS run FROM ch),
    rn AS (SELECT trial_id, run, any_value(state) AS s, count(*) AS n, min(k) AS k0 FROM ru GROUP BY ALL),
    ne AS (SELECT *, lag(s) OVER w AS sb, lead(s) OVER w AS sa, lag(n) OVER w AS nb, lead(n) OVER w AS na FROM rn WINDOW w AS (PARTITION BY trial_id ORDER BY run)),
    fi AS (SELECT ru.trial_id, ru.k, CASE WHEN n >= 2 OR (sb IS NULL AND sa IS NULL) THEN s WHEN sb IS NULL THEN sa WHEN sa IS NULL OR sa = sb OR nb > na THEN sb WHEN na > nb THEN sa WHEN k - k0 < n // 2 THEN sb ELSE sa END AS state FROM ru JOIN ne USING (trial_id, run)),
    c2 AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY trial_id ORDER BY k) = state THEN 0 ELSE 1 END AS c FROM fi),
    r2 AS (SELECT *, sum(c) OVER (PARTITION BY trial_id ORDER BY k) AS run FROM c2), n2 AS (SELECT trial_id, run, any_value(state) AS state, count(*) AS n FROM r2 GROUP BY ALL)"""

QUERIES = {
    "f39_microstates": (_metrics, sql("samples", STATES + f" SELECT trial_id, state, count(*) AS visits, {r('sum(n) / 8.0')} AS coverage, {r('avg(n)')} AS dwell FROM n2 GROUP BY trial_id, state")),
    "f39_fitted_microstates": (_fitted, None),
}
