"""Operators on voxel and region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import fisher
from .windows import distinct_names, moment_corr


def scrub(frames: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Frames without those that any flag marks, with the number kept."""
    kept = frames.where(~flag)
    return kept.withColumn("n_kept", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def region_correlation(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of every pair of regions over the frames; the number of regions bounds the fan-out."""
    known = frames.where(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "frame"]))
    rows = known.select(*keys, "frame", F.struct(F.col("roi").alias("roi"), F.col("value").alias("value")).alias("__s"))
    # one shuffle by the keys serves the frames and the pairs
    at_once = (rows.repartition(*keys) if keys else rows).groupBy(*keys, "frame").agg(F.collect_list("__s").alias("__all"))
    each = at_once.select(*keys, F.explode("__all").alias("__a"), "__all")
    pairs = each.select(*keys, "__a", F.explode(F.filter("__all", lambda s: s["roi"] > F.col("__a.roi"))).alias("__b"))
    pairs = pairs.select(*keys, F.col("__a.roi").alias("a"), F.col("__b.roi").alias("b"), F.col("__a.value").alias("x"), F.col("__b.value").alias("y"))
    return pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col("x"), F.col("y")).alias("r"))


def average_runs(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """Fisher-z mean over runs, weighted by frames."""
    return matrices.groupBy(*keys, "a", "b").agg(F.tanh(F.try_divide(F.sum(F.col("n") * fisher(F.col("r"))), F.sum(F.when(F.col("r").isNotNull(), F.col("n"))))).alias("r"))


def pattern_expression(maps: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Dot product, cosine and correlation of each map with a weight pattern, and the voxels they share."""
    m = maps.join(weights, "voxel")
    x, w = F.col("value"), F.col("weight")
    dot = F.sum(x * w)
    return m.groupBy(*keys).agg(dot.alias("dot"), F.try_divide(dot, F.nullif(F.sqrt(F.sum(x * x) * F.sum(w * w)), F.lit(0.0))).alias("cosine"), moment_corr(x, w).alias("r"), F.count(F.lit(1)).alias("n_voxels"))


def one_sample(voxels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    s = voxels.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return s.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.nullif("sd", F.lit(0.0))))


def repeated_measures(cells: DataFrame, keys: list[str], unit: str, condition: str, value: str) -> DataFrame:
    """Omnibus F over conditions of complete units, with its degrees of freedom. Sums are about each key's mean."""
    distinct_names(keys, "dof1", "dof2", "f")
    rows = cells.select(*keys, F.col(unit).alias("__unit"), F.col(condition).alias("__condition"), F.col(value).alias("__value"))
    whole = Window.partitionBy(*keys)
    d = rows.withColumn("__k", F.size(F.collect_set("__condition").over(whole))).withColumn("__have", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__unit"))).where("__have = __k")
    d = d.withColumn("__x", F.col("__value") - F.avg("__value").over(whole))
    total = d.groupBy(*keys).agg(F.first("__k").alias("__k"), F.countDistinct("__unit").alias("__n"), F.sum("__x").alias("__g"), F.sum(F.col("__x") * F.col("__x")).alias("__q"))
    side = lambda c, name: d.groupBy(*keys, c).agg(F.sum("__x").alias("__s")).groupBy(*keys).agg(F.sum(F.col("__s") * F.col("__s")).alias(name))
    t = total.join(side("__unit", "__uu"), keys).join(side("__condition", "__cc"), keys)
    k, n = F.col("__k"), F.col("__n")
    base, between, units = F.try_divide(F.col("__g") * F.col("__g"), n * k), F.try_divide(F.col("__cc"), n), F.try_divide(F.col("__uu"), k)
    t = t.withColumn("__ssc", between - base).withColumn("__sse", F.col("__q") - units - between + base)
    t = t.withColumn("dof1", k - 1).withColumn("dof2", (k - 1) * (n - 1))
    return t.select(*keys, "dof1", "dof2", F.try_divide(F.try_divide("__ssc", "dof1"), F.nullif(F.try_divide(F.col("__sse"), F.col("dof2")), F.lit(0.0))).alias("f"))


def max_statistic(voxels: DataFrame, unit: str, n_perm: int, seed: int = 1) -> DataFrame:
    """Per voxel: t and the sign-flip p against the largest |t| over all voxels; units flip by a hash of (perm, unit)."""
    flips = voxels.select(unit).distinct().withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "perm", unit).cast("binary")), 1, 8), 16, 10).cast("long")
    flips = flips.withColumn("sign", F.when(F.col("perm") == 0, 1).otherwise(1 - 2 * (hashed % 2)))
    t = one_sample(voxels.join(flips, unit).withColumn("flipped", F.col("value") * F.col("sign")), ["perm", "voxel"], "flipped")
    top = t.where("perm > 0").groupBy("perm").agg(F.max(F.abs("t")).alias("top"))
    seen = t.where("perm = 0").select("voxel", "t")
    return seen.join(F.broadcast(top)).groupBy("voxel", "t").agg(((F.count_if(F.col("top") >= F.abs("t")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def outlier_share(df: DataFrame, keys: list[str], value: str, z: float) -> DataFrame:
    """Share of values further than ``z`` scaled MADs from the median."""
    w = Window.partitionBy(*keys)
    m = df.withColumn("__m", F.median(value).over(w))
    m = m.withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__s", 1.4826 * F.median("__d").over(w))
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("__s") > 0, (F.col("__d") > z * F.col("__s")).cast("double")).otherwise(0.0)).alias("outlier_share"))


def convolved(trials: DataFrame, frames: DataFrame, keys: list[str], span: float) -> DataFrame:
    """Kernel-weighted mean of a frame series after each trial's onset: a triangle over ``span`` seconds.

    Frames lie in buckets of ``span`` seconds; a trial meets only the two or so buckets that its kernel reaches, so work grows with
    the frames under the kernels and not with the length of a run.
    """
    bucket = lambda t: F.floor(t / F.lit(float(span))).cast("long")
    reach = F.explode(F.sequence(bucket(F.col("onset")), bucket(F.col("onset") + span)))  # rounding never puts a frame beyond
    own = trials.where(F.col("onset").isNotNull()).withColumn("__bucket", reach)
    near = own.join(frames.withColumn("__bucket", bucket(F.col("time"))), [*keys, "__bucket"]).where((F.col("time") >= F.col("onset")) & (F.col("time") < F.col("onset") + span))
    w = 1 - F.abs(2 * (F.col("time") - F.col("onset")) / span - 1)
    return near.groupBy(*keys, "trial_id").agg(F.try_divide(F.sum(w * F.col("value")), F.nullif(F.sum(w), F.lit(0.0))).alias("value"), F.count(F.lit(1)).alias("n_frames"))


def temporal_snr(frames: DataFrame, keys: list[str], run: str, value: str) -> DataFrame:
    """Mean over standard deviation of each run (0 when constant), averaged over runs."""
    s = frames.groupBy(*keys, run).agg(F.coalesce(F.try_divide(F.avg(value), F.nullif(F.stddev_pop(value), F.lit(0.0))), F.lit(0.0)).alias("snr"))
    return s.groupBy(*keys).agg(F.avg("snr").alias("tsnr"))


def trial_censoring(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One boolean column per reason and whether the trial is kept."""
    out = df.select("*", *(v.alias(k) for k, v in reasons.items()))
    kept = F.lit(True)
    for k in reasons:
        kept = kept & ~F.coalesce(F.col(k), F.lit(False))
    return out.withColumn("kept", kept)


def group_effects(effects: DataFrame, keys: list[str], unit: str, value: str, n_boot: int = 100) -> DataFrame:
    """Mean and t of unit effects, percentile interval of the mean over resampled units, sign-flip p, and Holm p over the keys."""
    from .stats import bootstrap_draws, holm, sign_flip

    ok = effects.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, unit, value)
    means = bootstrap_draws(ok, keys, unit, n_boot).groupBy(*keys, "boot").agg(F.avg(value).alias("__m"))
    span = means.groupBy(*keys).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))
    tested = holm(sign_flip(ok, keys, unit, value).select(*keys, "p").withColumn("__one", F.lit(1)), "p", ["__one"], keys).drop("__one")
    return one_sample(ok, keys, value).join(span, keys).join(tested, keys)


def concordance(primary: DataFrame, other: DataFrame, keys: list[str], region: str, value: str, least: int = 3) -> DataFrame:
    """Correlation by region of two tables of the same trials; null under ``least`` shared trials."""
    both = primary.select(*keys, region, F.col(value).alias("__a")).join(other.select(*keys, region, F.col(value).alias("__b")), [*keys, region])
    s = both.where("__a IS NOT NULL AND __b IS NOT NULL").groupBy(region).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col("__a"), F.col("__b")).alias("r"))
    return s.withColumn("r", F.when(F.col("n") >= least, F.col("r")))
