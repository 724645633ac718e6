"""Features of spectra, analytic signals and samples, as plans over long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import clipped, moment_corr

FLOOR = 1e-20
#: Samples of the signals whose tries are held at once.
TRIE_CELLS = 1 << 21


def bin_widths(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid width of each frequency bin; end bins get half their gap."""
    w = Window.partitionBy(*keys).orderBy("freq")
    width = (F.coalesce(F.lead("freq").over(w), F.col("freq")) - F.coalesce(F.lag("freq").over(w), F.col("freq"))) / 2
    return psd.withColumn("df", width)


def band_power(psd: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Width-weighted mean power of each closed band; widths are those of the bins inside the band."""
    inside = psd.join(F.broadcast(bands), F.col("freq").between(F.col("f0"), F.col("f1")))
    weighed = bin_widths(inside, [*keys, "band"])
    return weighed.groupBy(*keys, "band").agg(F.try_divide(F.sum(F.col("power") * F.col("df")), F.sum("df")).alias("power"))


def relative_power(table: DataFrame, keys: list[str], segment: str, base: str) -> DataFrame:
    """log10 of power over baseline power, its decibels, and log10 of the raw power, floored."""
    ref = table.where(F.col(segment) == base).select(*keys, F.col("power").alias("ref"))
    x = F.greatest(F.col("power"), F.lit(FLOOR))
    out = table.where(F.col(segment) != base).join(ref, keys)
    ratio = F.log10(x / F.greatest(F.col("ref"), F.lit(FLOOR)))
    return out.select(*keys, segment, ratio.alias("logratio"), (10 * ratio).alias("db"), F.log10(x).alias("log10raw"))


def spectral_shape(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Centre, bandwidth, 95 % edge and normalised entropy of a spectrum; one bin has no entropy."""
    w = Window.partitionBy(*keys).orderBy("freq")
    # differences as in a gradient: one-sided at the ends, half the span inside
    width = (F.coalesce(F.lead("freq").over(w), F.col("freq")) - F.coalesce(F.lag("freq").over(w), F.col("freq"))) / F.when(F.lead("freq").over(w).isNull() | F.lag("freq").over(w).isNull(), 1).otherwise(2)
    mass = psd.withColumn("m", F.col("power") * width)
    whole = Window.partitionBy(*keys)
    t = mass.withColumn("total", F.sum("m").over(whole)).withColumn("running", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("psum", F.sum("power").over(whole))
    p = F.try_divide(F.col("power"), F.col("psum"))
    edge = F.min(F.when(F.col("running") >= 0.95 * F.col("total"), F.col("freq")))
    s = t.groupBy(*keys).agg(F.sum(F.col("freq") * p).alias("centre"), F.sum(F.col("freq") * F.col("freq") * p).alias("square"), edge.alias("edge"), F.try_divide(-F.sum(F.when(p > 0, p * F.ln(p))), F.nullif(F.ln(F.count(F.lit(1))), F.lit(0.0))).alias("entropy"))
    return s.withColumn("bandwidth", F.sqrt(F.greatest(F.col("square") - F.col("centre") * F.col("centre"), F.lit(0.0)))).drop("square")


def residual_spectrum(psd: DataFrame, keys: list[str]) -> DataFrame:
    """log10 power less the fitted line."""
    x = psd.where("power > 0").withColumn("lf", F.log10("freq")).withColumn("lp", F.log10("power"))
    line = x.groupBy(*keys).agg(F.regr_slope("lp", "lf").alias("b"), F.regr_intercept("lp", "lf").alias("a"))
    return x.join(line, keys).withColumn("residual", F.col("lp") - F.col("a") - F.col("b") * F.col("lf"))


def global_field_power(samples: DataFrame) -> DataFrame:
    return samples.groupBy("trial_id", "t").agg(F.stddev_pop("x").alias("gfp"))


def subtract_evoked(samples: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """Each sample less the mean of the training trials at its place."""
    return samples.withColumn("induced", F.col("x") - F.coalesce(F.avg(F.when(train, F.col("x"))).over(Window.partitionBy(*keys)), F.lit(0.0)))


def pairs(df: DataFrame, on: list[str], key: str, columns: list[str]) -> DataFrame:
    """Rows of two channels (a < b) of the same trial and time; the number of channels bounds the fan-out."""
    left = df.select(*on, F.col(key).alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = df.select(*on, F.col(key).alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return left.join(right, on).where("a < b")


def phase_connectivity(analytic: DataFrame, keys: list[str]) -> DataFrame:
    """wPLI, PLI, PLV and imaginary coherence of every channel pair."""
    p = pairs(analytic, [*keys, "t"], "channel", ["re", "im"])
    re = F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b")
    im = F.col("im_a") * F.col("re_b") - F.col("re_a") * F.col("im_b")
    mag = F.sqrt(re * re + im * im)
    power = lambda s: F.avg(F.col(f"re_{s}") * F.col(f"re_{s}") + F.col(f"im_{s}") * F.col(f"im_{s}"))
    return p.groupBy(*keys, "a", "b").agg(
        F.try_divide(F.abs(F.avg(im)), F.avg(F.abs(im))).alias("wpli"),
        F.abs(F.avg(F.signum(im))).alias("pli"),
        F.sqrt(F.pow(F.avg(F.try_divide(re, mag)), F.lit(2.0)) + F.pow(F.avg(F.try_divide(im, mag)), F.lit(2.0))).alias("plv"),
        F.try_divide(F.avg(im), F.sqrt(power("a") * power("b"))).alias("icoh"),
    )


def envelope_correlation(analytic: DataFrame, keys: list[str]) -> DataFrame:
    """Fisher z of the correlation of two envelopes."""
    env = analytic.withColumn("env", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    p = pairs(env, [*keys, "t"], "channel", ["env"])
    r = moment_corr(F.col("env_a"), F.col("env_b"))
    return p.groupBy(*keys, "a", "b").agg(F.atanh(clipped(r, 0.999999)).alias("aec"))


def phase_locking(analytic: DataFrame, keys: list[str]) -> DataFrame:
    """Inter-trial coherence and the coherence without each trial: window sums less the own row."""
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    u = analytic.withColumn("c", F.try_divide(F.col("re"), mag)).withColumn("s", F.try_divide(F.col("im"), mag))
    w = Window.partitionBy(*keys)
    n, sc, ss = F.count("c").over(w), F.sum("c").over(w), F.sum("s").over(w)
    length = lambda a, b, k: F.try_divide(F.sqrt(a * a + b * b), k)
    u = u.withColumn("itpc", length(sc, ss, n)).withColumn("loo", F.when(n > 1, length(sc - F.col("c"), ss - F.col("s"), n - 1)))
    return u.withColumn("alignment", F.try_divide(F.col("c") * sc + F.col("s") * ss, F.nullif(F.sqrt(sc * sc + ss * ss), F.lit(0.0))))


def phase_amplitude(analytic: DataFrame, keys: list[str], phase: int, amplitude: int) -> DataFrame:
    """Mean vector length of one channel's amplitude at another's phase: normalised and raw. Samples of size 0 have no phase."""
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    side = F.when(F.col("channel") == phase, F.struct(F.try_divide(F.col("re"), mag).alias("c"), F.try_divide(F.col("im"), mag).alias("s")))
    both = analytic.where(F.col("channel").isin(phase, amplitude)).groupBy(*keys, "t").agg(F.max(side).alias("u"), F.max(F.when(F.col("channel") == amplitude, mag)).alias("amp"))
    x, y = F.sum(F.col("amp") * F.col("u.c")), F.sum(F.col("amp") * F.col("u.s"))
    return both.groupBy(*keys).agg(F.try_divide(F.sqrt(x * x + y * y), F.sum("amp")).alias("pac"), F.try_divide(F.sqrt(x * x + y * y), F.count("amp")).alias("pac_raw"))


def bursts(df: DataFrame, keys: list[str], value: str, order: str, z: float, least: int) -> DataFrame:
    """Runs over mean + z SD (strictly): count, mean length; the fraction counts all samples above."""
    from .windows import islands

    w = Window.partitionBy(*keys)
    x = df.withColumn("__above", F.col(value) > F.avg(value).over(w) + z * F.stddev_pop(value).over(w))
    runs = islands(x, F.col("__above"), keys, order)
    kept = F.col("flag") & (F.col("n") >= least)
    return runs.groupBy(*keys).agg(F.count_if(kept).alias("bursts"), F.avg(F.when(kept, F.col("n"))).alias("mean_length"), (F.sum(F.when(F.col("flag"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))


def permutation_entropy(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Normalised entropy of the order patterns of three successive values."""
    w = Window.partitionBy(*keys).orderBy(order)
    x, y, z = F.col(value), F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    bit = lambda c: c.cast("int").cast("string")
    pattern = df.withColumn("pattern", F.concat(bit(x <= y), bit(y <= z), bit(x <= z))).where("pattern IS NOT NULL")
    counts = pattern.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(6.0))).alias("entropy"))


def sample_entropy(df: DataFrame, keys: list[str], value: str, order: str, factor: float = 0.2) -> DataFrame:
    """-ln(A / B) of matching pairs of length 3 and 2 inside one signal, the tolerance a share of its spread.

    Pairs are looked for only among neighbours on a grid of the tolerance's side, so the join grows with the pairs near in their
    first two values. A signal needs two vectors to have a row; its entropy is null when nothing matches.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, F.col(order).alias("__i"), F.col(value).alias("__x0"), F.lead(value, 1).over(w).alias("__x1"), F.lead(value, 2).over(w).alias("__x2"), (F.stddev_pop(value).over(Window.partitionBy(*keys)) * factor).alias("__r")).where("__x2 IS NOT NULL AND __x1 IS NOT NULL AND __x0 IS NOT NULL")
    side = F.col("__r") * (1 + 1e-9)  # a little wider, so that rounding cannot put a match two cells away
    cell = lambda k: F.coalesce(F.floor(F.try_divide(F.col(f"__x{k}"), F.nullif(side, F.lit(0.0)))), F.lit(0))
    own = x.withColumn("__c0", cell(0)).withColumn("__c1", cell(1))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    other = own.select(*keys, F.col("__i").alias("__j"), *(F.col(f"__x{k}").alias(f"__y{k}") for k in range(3)), "__c0", "__c1", F.explode(steps).alias("__s"))
    other = other.withColumn("__c0", F.col("__c0") + F.col("__s.a")).withColumn("__c1", F.col("__c1") + F.col("__s.b")).drop("__s")
    near = lambda k: F.abs(F.col(f"__x{k}") - F.col(f"__y{k}")) <= F.col("__r")
    m = own.join(other.hint("merge"), [*keys, "__c0", "__c1"]).where(F.col("__i") < F.col("__j")).where(near(0) & near(1)).groupBy(*keys).agg(F.count(F.lit(1)).alias("b"), F.count_if(near(2)).alias("a"))
    every = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n").join(m, keys, "left").fillna(0, ["a", "b"])
    return every.withColumn("entropy", F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.try_divide(F.col("a"), F.col("b")))))


def multiscale_entropy(df: DataFrame, keys: list[str], value: str, order: str, scales: list[int], factor: float = 0.2) -> DataFrame:
    """Sample entropy of the signal averaged over blocks of each scale; what is left over at the end of a signal is not used and
    values that are not finite are passed over. The tolerance is of the averaged signal. Column ``scale``."""
    x = F.col(value).cast("double")
    good = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = good.select(*keys, x.alias("__x"), (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("__at")).withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    block = rows.groupBy(*keys, "scale", F.floor(F.col("__at") / F.col("scale")).alias("__block")).agg(F.avg("__x").alias("__x"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == F.col("scale"))
    return sample_entropy(block, [*keys, "scale"], "__x", "__block", factor)


def harmonic_overlap(bands: DataFrame, most: int, tolerance: float) -> DataFrame:
    """Phase and amplitude bands where a harmonic of the first lies in the second."""
    k = F.explode(F.sequence(F.lit(2), F.lit(most)))
    phase = bands.select(F.col("band").alias("phase"), "f0", "f1", k.alias("k"))
    amp = bands.select(F.col("band").alias("amplitude"), F.col("f0").alias("a0"), F.col("f1").alias("a1"))
    hit = (F.col("f0") * F.col("k") - tolerance <= F.col("a1")) & (F.col("f1") * F.col("k") + tolerance >= F.col("a0"))
    return phase.join(F.broadcast(amp), F.col("phase") != F.col("amplitude")).groupBy("phase", "amplitude").agg(F.bool_or(hit).alias("overlap"))


def threshold_graph(edges: DataFrame, keys: list[str], top: float) -> DataFrame:
    """Edges of at least the ``100 (1 - top)`` percentile of each graph."""
    cut = edges.groupBy(*keys).agg(F.percentile("w", 1 - top).alias("cut"))
    return edges.join(cut, keys).where("w >= cut").drop("cut")


def _stacked(samples: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, __i, __x``: each signal as two arrays in ascending order; null values are left out."""
    points = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("i"), F.col(value).cast("double").alias("x")))))
    rows = samples.groupBy(*keys).agg(points.alias("__s"))
    return rows.select(*keys, F.transform("__s", lambda s: s["i"]).alias("__i"), F.transform("__s", lambda s: s["x"]).alias("__x"))


def _by_length(signals: DataFrame, kept: list[str], made: dict[str, str], work: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``kept`` columns and what ``work`` makes of all signals of one length in a batch at once: a row of numbers (or a number) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("__x")
            sizes = listed.value_lengths().to_numpy()
            flat, ends = listed.flatten().to_numpy(), np.cumsum(sizes)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                values = work(flat[(ends[at] - n)[:, None] + np.arange(n)])
                arrays = [pa.array(list(v) if v.ndim > 1 else v, pa.list_(pa.float64()) if v.ndim > 1 else pa.float64(), from_pandas=True) for v in (values[c] for c in made)]
                yield pa.RecordBatch.from_arrays([*batch.select(kept).take(pa.array(at)).columns, *arrays], names=[*kept, *made])

    kinds = {f.name: f.dataType.simpleString() for f in signals.schema}
    return signals.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), *(f"`{c}` {t}" for c, t in made.items())]))


def welch(samples: DataFrame, keys: list[str], rate: float, size: int) -> DataFrame:
    """Power spectrum by averaged windowed segments of ``size`` samples, half overlapping: ``keys, freq, power``.

    All signals of one length in a batch are transformed at once. A signal shorter than a segment has no rows.
    """
    half, window = size // 2, np.hanning(size + 1)[:-1]

    def spectra(x: np.ndarray) -> dict[str, np.ndarray]:
        starts = np.arange(0, x.shape[1] - size + 1, max(1, half))
        if not len(starts):
            return {"__power": np.zeros((len(x), 0))}
        parts = x[:, starts[:, None] + np.arange(size)]
        power = (np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * window)) ** 2).mean(axis=1) / (rate * (window**2).sum())
        power[:, 1 : -1 if size % 2 == 0 else None] *= 2
        return {"__power": power}

    out = _by_length(_stacked(samples, keys, "sample_idx", "x"), keys, {"__power": "array<double>"}, spectra)
    bins = F.posexplode("__power").alias("__k", "power")
    return out.select(*keys, bins).select(*keys, (F.col("__k") * (rate / size)).alias("freq"), "power")


def analytic_band(samples: DataFrame, keys: list[str], rate: float, f0: float, f1: float) -> DataFrame:
    """Band-limited analytic signal by a mask over positive frequencies: ``keys, sample_idx, re, im``; stacked like ``welch``."""

    def band(x: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fftfreq(x.shape[1], 1 / rate) if x.shape[1] else np.zeros(0)
        z = np.fft.ifft(np.where((f >= f0) & (f <= f1), 2 * np.fft.fft(x), 0)) if x.shape[1] else x.astype(complex)
        return {"__re": z.real, "__im": z.imag}

    signals = _stacked(samples, keys, "sample_idx", "x")
    out = _by_length(signals, [*keys, "__i"], {"__re": "array<double>", "__im": "array<double>"}, band)
    return out.select(*keys, F.explode(F.arrays_zip("__i", "__re", "__im")).alias("__z")).select(*keys, F.col("__z.__i").alias("sample_idx"), F.col("__z.__re").alias("re"), F.col("__z.__im").alias("im"))


def phrase_counts(bits: np.ndarray) -> np.ndarray:
    """Phrases of the greedy parse of each row of bits, an unfinished one included.

    Every row has a trie of integer nodes; one step moves all rows on by one bit, and a row that leaves its trie adds a node and
    goes back to the root.
    """
    rows, n = bits.shape
    child = np.zeros((rows, n + 1, 2), np.int32)
    made, node, each = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    for t in range(n):
        bit = bits[:, t]
        to = child[each, node, bit]
        new = to == 0
        made += new
        child[each[new], node[new], bit[new]] = made[new]
        node = np.where(new, 0, to)
    return made + (node > 0)


def lempel_ziv(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy phrase count of the signal over its median, over ``n / log2 n``; null for signals of one sample."""

    def complexity(x: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1]
        if n < 2:
            return {"complexity": np.full(len(x), np.nan)}
        step = max(1, TRIE_CELLS // n)
        bits = (x > np.median(x, axis=1, keepdims=True)).astype(np.int8)
        counts = np.concatenate([phrase_counts(bits[a : a + step]) for a in range(0, len(x), step)])
        return {"complexity": counts / (n / np.log2(n))}

    return _by_length(_stacked(samples, keys, "sample_idx", "x"), keys, {"complexity": "double"}, complexity)
