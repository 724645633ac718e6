"""Measures of single traces: event-related components, bursts over a threshold, artifact metrics of a trial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectra import gathered, with_prominence
from .windows import moment_corr

#: Fixed value: median absolute deviation to standard deviation.
MAD_TO_STD = 1.4826


def component(samples: DataFrame, keys: list[str], t: str, x: str, start: float, stop: float, mode: str = "abs", least: float = 0.0) -> DataFrame:
    """``keys, mean, peak, latency, area`` of each trace in ``[start, stop)``.

    The peak is the most prominent local maximum of the trace (``pos``), its negative (``neg``) or its size (``abs``) with a
    prominence of at least ``least``, the earliest of equals; without such a one, or with ``least`` 0, the greatest sample. For it,
    samples without a finite value count as the median of the others. The area is the sum of trapezoids between neighbouring finite
    samples, null if there are none; a trace without finite samples in the window has no row.
    """
    value = F.col(x).cast("double")
    inside = samples.where((F.col(t) >= start) & (F.col(t) < stop))
    rows = inside.select(*keys, F.col(t).cast("double").alias("__t"), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("__x"))
    order = Window.partitionBy(*keys).orderBy("__t")
    piece = (F.col("__x") + F.lag("__x").over(order)) / 2 * (F.col("__t") - F.lag("__t").over(order))
    filled = F.coalesce("__x", F.median("__x").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("__piece", piece).withColumn("__fill", filled).where("__fill IS NOT NULL")
    sums = rows.groupBy(*keys).agg(F.avg("__x").alias("mean"), F.sum("__piece").alias("area"))
    search = {"pos": "s.p", "neg": "-s.p", "abs": "abs(s.p)"}[mode]
    series = with_prominence(gathered(rows, keys, "__t", "__fill"), f"transform(__s, s -> {search})", "__p")
    wanted = f"p.peak AND p.prominence >= {least}D" if least > 0 else "false"
    best = f"coalesce(array_max(transform(filter(__p, p -> {wanted}), p -> struct(p.prominence AS v, -p.at AS place))), array_max(transform(__p, p -> struct(p.value AS v, -p.at AS place)))).place"
    peaks = series.withColumn("__at", -F.expr(best)).select(*keys, F.expr("get(__s, __at).p").alias("peak"), F.expr("get(__s, __at).f").alias("latency"))
    return sums.join(peaks, keys).select(*keys, "mean", "peak", "latency", "area")


def peak_pair(negative: DataFrame, positive: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ptp, latency_diff`` of two components of the same traces: size of the step from the negative to the positive peak, and its time."""
    both = negative.select(*keys, F.col("peak").alias("__a"), F.col("latency").alias("__ta")).join(positive.select(*keys, F.col("peak").alias("__b"), F.col("latency").alias("__tb")), keys)
    return both.select(*keys, F.abs(F.col("__b") - F.col("__a")).alias("ptp"), (F.col("__tb") - F.col("__ta")).alias("latency_diff"))


def burst_metrics(df: DataFrame, keys: list[str], value: str, order: str, rate: float, *, method: str = "zscore", z: float = 2.0, percentile: float = 95.0, least: int = 2, baseline: Column | None = None) -> DataFrame:
    """``keys, bursts, rate, duration, amplitude, fraction`` of runs strictly over a threshold.

    The threshold is mean + ``z`` SD (``zscore``), median + ``z`` scaled MADs (``mad``) or a percentile (``percentile``) of the
    rows of ``baseline``, of all rows without it. Runs of at least ``least`` samples are bursts; ``rate`` samples make a second.
    The amplitude is the mean of the bursts' greatest values. The fraction counts every sample over the threshold.
    """
    whole = Window.partitionBy(*keys)
    x = F.col(value) if baseline is None else F.when(baseline, F.col(value))
    rows = df.withColumn("__base", x)
    if method == "zscore":
        rows = rows.withColumn("__bar", F.avg("__base").over(whole) + z * F.stddev_pop("__base").over(whole))
    elif method == "mad":
        rows = rows.withColumn("__mid", F.median("__base").over(whole)).withColumn("__off", F.abs(F.col("__base") - F.col("__mid")))
        rows = rows.withColumn("__bar", F.col("__mid") + z * MAD_TO_STD * F.median("__off").over(whole))
    elif method == "percentile":
        rows = rows.withColumn("__bar", F.percentile("__base", percentile / 100).over(whole))
    else:
        raise ValueError(method)
    along = whole.orderBy(order)
    rows = rows.withColumn("__up", F.coalesce(F.col(value) > F.col("__bar"), F.lit(False)))
    change = F.when(F.lag("__up").over(along).eqNullSafe(F.col("__up")), 0).otherwise(1)
    rows = rows.withColumn("__change", change).withColumn("__run", F.sum("__change").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "__run", "__up").agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias("__top"))
    burst = F.col("__up") & (F.col("__n") >= least)
    out = runs.groupBy(*keys).agg(
        F.count_if(burst).alias("bursts"), F.sum("__n").alias("__all"), F.avg(F.when(burst, F.col("__n"))).alias("__length"),
        F.avg(F.when(burst, F.col("__top"))).alias("amplitude"), F.sum(F.when(F.col("__up"), F.col("__n")).otherwise(0)).alias("__over"),
    )
    return out.select(*keys, "bursts", (F.col("bursts") * rate / F.col("__all")).alias("rate"), (F.col("__length") / rate).alias("duration"), "amplitude", (F.col("__over") / F.col("__all")).alias("fraction"))


def artifact_metrics(samples: DataFrame, keys: list[str], t: str, channel: str, x: str, primary: Column, secondary: Column) -> DataFrame:
    """``keys, rms, variance, mean_abs_r`` of each trial: root mean square and population variance over all samples of the primary
    channels, and the mean size of the correlations of primary with secondary channels; a constant channel correlates 0."""
    own = samples.where(primary)
    sizes = own.groupBy(*keys).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.var_pop(x).alias("variance"))
    left = own.select(*keys, t, F.col(channel).alias("__a"), F.col(x).alias("__x"))
    right = samples.where(secondary).select(*keys, t, F.col(channel).alias("__b"), F.col(x).alias("__y"))
    r = left.join(right, [*keys, t]).groupBy(*keys, "__a", "__b").agg(F.coalesce(moment_corr(F.col("__x"), F.col("__y")), F.lit(0.0)).alias("__r"))
    return sizes.join(r.groupBy(*keys).agg(F.avg(F.abs("__r")).alias("mean_abs_r")), keys, "left")


def fold_phase_locking(analytic: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """Inter-trial coherence for a fold: ``itpc`` of the training trials at each place of ``keys``, and ``loo``, what each trial may be
    measured by without itself: a training trial that of the other training trials, any other that of all of them.

    Without training trials all trials count as such. A sample of size 0 has no phase and counts in no sum; a lone training trial
    has the coherence of itself. ``keys`` may hold the condition for the coherence of each condition.
    """
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    w = Window.partitionBy(*keys)
    rows = analytic.withColumn("__c", F.try_divide(F.col("re"), mag)).withColumn("__s", F.try_divide(F.col("im"), mag)).withColumn("__train", F.coalesce(train, F.lit(False)))
    rows = rows.withColumn("__fit", F.col("__train") | ~F.max("__train").over(w))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("__fit"), F.col(c))).over(w), F.lit(0.0))
    rows = rows.withColumn("__n", F.count(F.when(F.col("__fit"), F.col("__c"))).over(w)).withColumn("__tc", part("__c")).withColumn("__ts", part("__s"))
    length = lambda a, b, n: F.try_divide(F.sqrt(a * a + b * b), n)
    whole = length(F.col("__tc"), F.col("__ts"), F.col("__n"))
    other = length(F.col("__tc") - F.col("__c"), F.col("__ts") - F.col("__s"), F.col("__n") - 1)
    own = F.col("__fit") & F.col("__c").isNotNull() & (F.col("__n") > 1)
    return rows.withColumn("itpc", whole).withColumn("loo", F.when(own, other).otherwise(whole)).drop("__c", "__s", "__train", "__fit", "__n", "__tc", "__ts")
