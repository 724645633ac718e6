"""Grouped aggregation, pivots and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"))


def spatial_scopes(samples: DataFrame, regions: DataFrame, keys: list[str], value: str, how: str = "mean") -> DataFrame:
    """Channel, region and global aggregates in one long table; a channel may lie in several regions."""
    agg = F.avg(value) if how == "mean" else F.median(value)
    ch = samples.groupBy(*keys, F.col("channel").cast("string").alias("identifier")).agg(agg.alias("value")).withColumn("scope", F.lit("ch"))
    roi = samples.join(F.broadcast(regions), "channel").groupBy(*keys, F.col("roi").alias("identifier")).agg(agg.alias("value")).withColumn("scope", F.lit("roi"))
    whole = samples.groupBy(*keys).agg(agg.alias("value")).withColumn("identifier", F.lit("all")).withColumn("scope", F.lit("global"))
    return ch.unionByName(roi).unionByName(whole)


def masked_mean(df: DataFrame, keys: list[str], value: str, mask: Column) -> DataFrame:
    """Mean of the finite values inside a mask and their share of it."""
    x = F.when(mask, F.col(value))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.try_divide(F.count(x), F.count_if(mask)).alias("finite_share"))


def complete_units(df: DataFrame, unit: list[str], run: str, value: str, n_runs: int) -> DataFrame:
    """Mean per unit and run, for units that every run has."""
    cells = df.groupBy(*unit, run).agg(F.avg(value).alias("value"))
    return cells.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*unit))).where(F.col("__n") == n_runs).drop("__n")


def importance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum, mean and share of all importance."""
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    # the window runs over the aggregated groups, one row for each
    return out.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())))


def inverse_variance_mean(df: DataFrame, keys: list[str], effect: str, variance: str) -> DataFrame:
    w = F.when(F.col(variance) > 0, 1 / F.col(variance))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(effect) * w), F.sum(w)).alias("effect"), F.try_divide(F.lit(1.0), F.sum(w)).alias("variance"))


def area_weighted(df: DataFrame, keys: list[str], value: str, variance: str, area: str) -> DataFrame:
    a = F.col(area)
    return df.groupBy(*keys).agg(F.try_divide(F.sum(a * F.col(value)), F.sum(a)).alias("mean"), F.try_divide(F.sum(a * a * F.col(variance)), F.pow(F.sum(a), F.lit(2.0))).alias("variance"))


def adjacency(edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean weight of each edge, in both directions."""
    mean = edges.groupBy(*keys, "src", "dst").agg(F.avg(value).alias("w"))
    return mean.unionByName(mean.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def binned_statistics(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean and standard error of ``y`` in equal-width bins of ``x``."""
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(x) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    return df.crossJoin(F.broadcast(span)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se"))


def run_dummies(df: DataFrame, run: str, levels: list[int]) -> DataFrame:
    """One 0/1 column for each level but the first."""
    return df.select("*", *(F.when(F.col(run) == k, 1.0).otherwise(0.0).alias(f"run_{k}") for k in levels[1:]))
