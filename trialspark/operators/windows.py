"""Windows over samples and trials: segments, sliding windows, ranks, islands, areas, peaks, baselines, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scans import average_ranks


def distinct_names(keys: list[str], *made: str) -> None:
    """ValueError if a key has the name of a column that is made (Spark takes no notice of case): it would be overwritten."""
    if clash := sorted({k.lower() for k in keys} & {m.lower() for m in made}):
        raise ValueError(f"keys have the names of result columns: {', '.join(clash)}")


def segments(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    """A small table of named half-open windows."""
    return spark.createDataFrame(rows, "segment string, t0 double, t1 double")


def time_mask(samples: DataFrame, windows: DataFrame, t: str = "t") -> DataFrame:
    """Each sample with every window ``[t0, t1)`` that holds it; the window table is small and given by the caller."""
    return samples.join(F.broadcast(windows), (F.col(t) >= F.col("t0")) & (F.col(t) < F.col("t1")))


def sliding_windows(samples: DataFrame, length: float, step: float, start: float, stop: float, t: str = "t") -> DataFrame:
    """Samples exploded to the overlapping windows ``start + k * step`` of ``length`` that hold them and end by ``stop``."""
    last = int((stop - start - length) / step + 1e-9)
    k = F.explode(F.sequence(F.lit(0), F.lit(last)))
    each = samples.withColumn("window", k).withColumn("w0", F.lit(start) + F.col("window") * step)
    return each.where((F.col(t) >= F.col("w0")) & (F.col(t) < F.col("w0") + length))


def clamped_windows(samples: DataFrame, length: float, start: float, stop: float, t: str = "t") -> DataFrame:
    """Adjacent windows of fixed length, the last one ending at ``stop``."""
    k = F.floor((F.col(t) - start) / length).cast("int")
    inside = samples.where((F.col(t) >= start) & (F.col(t) < stop)).withColumn("window", k)
    return inside.withColumn("w0", start + F.col("window") * length).withColumn("w1", F.least(F.col("w0") + length, F.lit(stop)))


def bands(frame: DataFrame, table: DataFrame, freq: str = "freq") -> DataFrame:
    """Each bin with every closed band ``[f0, f1]`` that holds it."""
    return frame.join(F.broadcast(table), F.col(freq).between(F.col("f0"), F.col("f1")))


def average_rank(value: str, keys: list[str]) -> Column:
    """Average rank of a value inside its group; null values rank nowhere."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    ties = F.count(value).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def rank_normalise(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``(average rank - 1) / (n - 1)``; null for groups of one."""
    ranked = average_ranks(df, keys, value, "__rank")
    return ranked.select(*df.columns, F.try_divide(F.col("__rank") - 1, F.col("__size") - 1).alias("scaled"))


def normalise(df: DataFrame, value: str, keys: list[str], method: str, where: Column | None = None) -> DataFrame:
    """z-score, robust, min-max or log scaling by group statistics, taken from the rows of ``where`` if given."""
    x = F.col(value) if where is None else F.when(where, F.col(value))
    w = Window.partitionBy(*keys)
    if method == "zscore":
        return df.withColumn("scaled", F.try_divide(F.col(value) - F.avg(x).over(w), F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))))
    if method == "minmax":
        low, high = F.min(x).over(w), F.max(x).over(w)
        return df.withColumn("scaled", F.try_divide(F.col(value) - low, F.nullif(high - low, F.lit(0.0))))
    if method == "log":
        return df.withColumn("scaled", F.log1p(F.greatest(F.col(value), F.lit(0.0))))
    if method == "robust":
        # a median is holistic, so its deviations need a second pass
        centre = df.withColumn("__m", F.median(x).over(w))
        off = F.abs(F.col(value) - F.col("__m")) if where is None else F.when(where, F.abs(F.col(value) - F.col("__m")))
        spread = 1.4826 * F.median(off).over(w)
        return centre.withColumn("scaled", F.try_divide(F.col(value) - F.col("__m"), F.nullif(spread, F.lit(0.0)))).drop("__m")
    raise ValueError(method)


def islands(df: DataFrame, flag: Column, keys: list[str], order: str) -> DataFrame:
    """Runs of rows with the same flag: ``keys, island, flag, first, last, n``."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("flag", flag)
    change = F.when(F.lag("flag").over(w).eqNullSafe(F.col("flag")), 0).otherwise(1)
    numbered = marked.withColumn("__change", change).withColumn("island", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island", "flag").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def first_sustained(df: DataFrame, flag: Column, keys: list[str], order: str, least: int) -> DataFrame:
    """Start of the first run of at least ``least`` rows with the flag."""
    return islands(df, flag, keys, order).where(F.col("flag") & (F.col("n") >= least)).groupBy(*keys).agg(F.min("first").alias("onset"))


def clipped(x: Column, limit: float) -> Column:
    """``x`` inside [-limit, limit]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def moment_corr(x: Column, y: Column, middle: Column | None = None) -> Column:
    """Pearson r from central moments, so a large offset costs no digits; null where either side is constant.

    A side is constant when its spread is lost in the rounding of its values (the built-in ``corr`` raises there). A ``middle``
    near both means is taken off before the moments, which keeps the digits of a side whose spread is tiny beside its mean.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    dx, dy = (x, y) if middle is None else (x - middle, y - middle)
    sx, sy = F.stddev_pop(dx), F.stddev_pop(dy)
    varies = (sx > 1e-14 * F.abs(F.avg(x))) & (sy > 1e-14 * F.abs(F.avg(y)))
    return clipped(F.try_divide(F.covar_pop(dx, dy), F.when(varies, sx * sy)), 1.0)


def autocorrelation(df: DataFrame, value: str, keys: list[str], order: str, lag: int, least: int = 3) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows on; null under ``least`` pairs."""
    later = df.withColumn("__later", F.lead(value, lag).over(Window.partitionBy(*keys).orderBy(order))).where("__later IS NOT NULL")
    out = later.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), moment_corr(F.col(value), F.col("__later")).alias("r"))
    return out.withColumn("r", F.when(F.col("pairs") >= least, F.col("r")))


def change_scores(df: DataFrame, keys: list[str], segment: str, value: str, base: str, target: str) -> DataFrame:
    """Difference, percent change and log ratio between two segments; null where the reference is too small or not positive."""
    side = lambda name, alias: F.avg(F.when(F.col(segment) == name, F.col(value))).alias(alias)
    both = df.where(F.col(segment).isin(base, target)).groupBy(*keys).agg(side(base, "ref"), side(target, "act"))
    ratio = F.when((F.col("ref") > 0) & (F.col("act") > 0), F.log10(F.col("act") / F.col("ref")))
    percent = F.when(F.abs("ref") > 1e-10, 100 * (F.col("act") - F.col("ref")) / F.col("ref"))
    return both.select(*keys, (F.col("act") - F.col("ref")).alias("change"), percent.alias("pct_change"), ratio.alias("log_ratio"))


def top_variance(df: DataFrame, keys: list[str], feature: str, value: str, most: int) -> DataFrame:
    """The ``most`` features of greatest sample variance in each group."""
    v = df.groupBy(*keys, feature).agg(F.var_samp(value).alias("variance"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("variance"), feature))
    return v.withColumn("place", rank).where(F.col("place") <= most)


def area_under(df: DataFrame, value: str, keys: list[str], t: str, step: float) -> DataFrame:
    """Trapezoid area over neighbouring samples; a gap wider than ``step`` or a null breaks the run."""
    w = Window.partitionBy(*keys).orderBy(t)
    dt, before = F.col(t) - F.lag(t).over(w), F.lag(value).over(w)
    part = F.when(dt <= step * 1.5, dt * (F.col(value) + before) / 2)
    return df.withColumn("__part", part).groupBy(*keys).agg(F.sum("__part").alias("area"))


def peaks(df: DataFrame, value: str, keys: list[str], t: str, mode: str, smooth: int = 0) -> DataFrame:
    """Peak value and its time: positive, negative or absolute; optional centred moving average first."""
    x = F.avg(value).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(-smooth, smooth)) if smooth else F.col(value)
    score = {"pos": F.col("__x"), "neg": -F.col("__x"), "abs": F.abs("__x")}[mode]
    best = F.max_by(F.struct("__x", t), F.struct(score, -F.col(t)))
    return df.withColumn("__x", x).where("__x IS NOT NULL").groupBy(*keys).agg(best.alias("p")).select(*keys, F.col("p.__x").alias("peak"), F.col(f"p.{t}").alias("latency"))


def baseline_correct(df: DataFrame, value: str, keys: list[str], base: Column, mode: str) -> DataFrame:
    """Correct by the mean (and spread) of the rows in ``base``: logratio, ratio, percent, zscore or mean."""
    w = Window.partitionBy(*keys)
    m, s = F.avg(F.when(base, F.col(value))).over(w), F.stddev_pop(F.when(base, F.col(value))).over(w)
    x = F.col(value)
    ratio = F.try_divide(x, F.nullif(m, F.lit(0.0)))
    out = {"logratio": F.when(ratio > 0, F.log10(ratio)), "ratio": ratio, "percent": 100 * (ratio - 1), "zscore": F.try_divide(x - m, F.nullif(s, F.lit(0.0))), "mean": x - m}[mode]
    return df.withColumn("corrected", out)


def check_baseline(df: DataFrame, keys: list[str], t: str, t0: float, t1: float, least: int) -> DataFrame:
    """Groups whose baseline has too few samples, or whose window does not end before onset."""
    n = F.count_if((F.col(t) >= t0) & (F.col(t) < t1))
    return df.groupBy(*keys).agg(n.alias("n_baseline")).withColumn("valid", (F.col("n_baseline") >= least) & F.lit(t1 <= 0))
