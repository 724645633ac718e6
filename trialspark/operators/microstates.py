"""Map states of multi-channel samples: field-power peaks, templates, back-fit to samples and minimum duration."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extended import _spaced


def _runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Numbers the runs of equal values as ``__run``."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def field_peaks(samples: DataFrame, keys: list[str], order: str, value: str, distance: int = 1, most: int | None = None) -> DataFrame:
    """Local maxima of the spread over channels (``power``) of each series: a flat one is at its middle, the ends are none. Peaks nearer
    than ``distance`` are thinned, highest first, and at most ``most`` of a series are kept. A series without a peak has its
    greatest sample (of equal ones the first); one of fewer than three samples has none. ``order`` is a whole number.
    """
    power = samples.groupBy(*keys, order).agg(F.stddev_pop(value).alias("power")).where(F.col("power").isNotNull() & ~F.isnan("power"))
    flat = _runs(power, keys, order, "power").groupBy(*keys, "__run").agg(F.first("power").alias("power"), F.floor((F.min(order) + F.max(order)) / 2).cast("int").alias("__at"))
    w = Window.partitionBy(*keys).orderBy("__run")
    found = flat.withColumn("__up", (F.col("power") > F.lag("power").over(w)) & (F.col("power") > F.lead("power").over(w))).where("__up")
    if distance > 1:
        packed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__at", F.col("power").alias("h")))).alias("e"))
        found = found.join(packed.select(*keys, F.explode(_spaced(distance)("e.__at", "e.h")).alias("__at")), [*keys, "__at"])
    top = power.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(F.col(order).cast("int").alias("at"), F.col("power").alias("h")), F.struct(F.col("power"), -F.col(order))).alias("__top")).where("__n >= 3")
    peaks = top.join(found.select(*keys, "__at", F.col("power").alias("__h")), keys, "left")
    peaks = peaks.select(*keys, F.coalesce("__at", "__top.at").alias(order), F.coalesce("__h", "__top.h").alias("power"))
    if most is None:
        return peaks
    best = Window.partitionBy(*keys).orderBy(F.desc("power"), F.desc(order))
    return peaks.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= most).drop("__k")


def unit_maps(samples: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """Maps over channels with mean 0 and length 1 as ``weight``; flat maps go."""
    w = Window.partitionBy(*keys)
    x = samples.select(*keys, channel, (F.col(value) - F.avg(value).over(w)).alias("__x"))
    return x.withColumn("weight", F.try_divide("__x", F.nullif(F.sqrt(F.sum(F.col("__x") * F.col("__x")).over(w)), F.lit(0.0)))).where("weight IS NOT NULL").drop("__x")


def fit_templates(maps: DataFrame, keys: list[str], channel: str, channels: list, k: int, seed: int = 1) -> DataFrame:
    """``state, channel, weight`` of ``k`` templates by k-means over unit maps; ``channels`` is the fixed list of channels."""
    wide = maps.groupBy(*keys).pivot(channel, channels).agg(F.first("weight")).select(*(F.col(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(channels))).na.drop()
    rows = VectorAssembler(inputCols=[f"__m{i}" for i in range(len(channels))], outputCol="features").transform(wide)
    centers = np.array(KMeans(k=k, seed=seed, maxIter=50).fit(rows).clusterCenters())  # k times channels
    centers = centers - centers.mean(axis=1, keepdims=True)
    centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    kind = maps.schema[channel].dataType.simpleString()
    flat = [(s, c, float(centers[s, i])) for s in range(len(centers)) for i, c in enumerate(channels)]
    return maps.sparkSession.createDataFrame(flat, f"state int, {channel} {kind}, weight double")


def assign_states(maps: DataFrame, templates: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """State whose template is most alike, whatever its sign; of equal ones the least. Templates have a row for each state and channel."""
    t = templates.select(channel, "state", F.col("weight").alias("__t"))
    alike = maps.join(t, channel).groupBy(*keys, "state").agg(F.abs(F.sum(F.col("weight") * F.col("__t"))).alias("__s"))
    return alike.groupBy(*keys).agg(F.max_by("state", F.struct(F.col("__s"), -F.col("state"))).alias("state"))


def back_fit(samples: DataFrame, peaks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state of each sample from its series' peaks: the border between two peaks is their middle, rounded down, and belongs to the
    later one. Samples of series without peaks go."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(order).over(w)
    starts = peaks.select(*keys, F.col(order).alias("__p"), F.when(before.isNotNull(), F.floor((before + F.col(order)) / 2)).cast("int").alias("__start"), "state")
    first = samples.groupBy(*keys).agg(F.min(order).alias("__first"))
    starts = starts.join(first, keys).withColumn(order, F.coalesce("__start", F.least("__first", "__p")))
    starts = starts.groupBy(*keys, order).agg(F.max_by("state", "__p").alias("__s"))
    places = samples.select(*keys, order).distinct()
    marked = places.select(*keys, order, F.lit(1).alias("__kind"), F.lit(None).cast("int").alias("__s")).unionByName(starts.select(*keys, order, F.lit(0).alias("__kind"), "__s"))
    last = F.last("__s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("state", last).where("__kind = 1 AND state IS NOT NULL").select(*keys, order, "state")


def minimum_duration(df: DataFrame, keys: list[str], order: str, state: str, least: int) -> DataFrame:
    """Runs shorter than ``least`` samples go to the longer of the runs beside them, as these were; between runs of one length and
    different states the first half goes to the one before. A run alone in its series stays."""
    rows = _runs(df, keys, order, state)
    w = Window.partitionBy(*keys).orderBy("__run")
    runs = rows.groupBy(*keys, "__run").agg(F.first(state).alias("__s"), F.count(F.lit(1)).alias("__n"))
    beside = runs.select(*keys, "__run", "__n", *(f(c).over(w).alias(f"{c}{n}") for c in ("__s", "__n") for n, f in (("_before", F.lag), ("_after", F.lead))))
    place = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order)) - 1
    before, after, nb, na = (F.col(c) for c in ("__s_before", "__s_after", "__n_before", "__n_after"))
    split = F.when(F.col("__place") < F.floor(F.col("__n") / 2), before).otherwise(after)
    new = F.when((F.col("__n") >= least) | (nb.isNull() & na.isNull()), F.col(state)).when(nb.isNull(), after).when(na.isNull() | before.eqNullSafe(after) | (nb > na), before).when(na > nb, after).otherwise(split)
    both = rows.withColumn("__place", place).join(beside, [*keys, "__run"])
    return both.withColumn(state, new).drop("__place", *(c for c in beside.columns if c not in keys))


def microstates(samples: DataFrame, templates: DataFrame, keys: list[str], order: str, channel: str, value: str, least: int = 1, distance: int = 1, most: int | None = None) -> DataFrame:
    """``keys, order, state`` of every sample: templates are assigned to the maps at field-power peaks, fitted back to the samples and
    short runs removed."""
    peaks = field_peaks(samples, keys, order, value, distance, most).select(*keys, order)
    maps = unit_maps(samples.join(peaks, [*keys, order]), [*keys, order], channel, value)
    states = back_fit(samples, assign_states(maps, templates, [*keys, order], channel), keys, order)
    return states if least <= 1 else minimum_duration(states, keys, order, "state", least)
