"""Whole spectra as arrays: robust 1/f lines, topographic prominence, peaks and band measures of what stands above the line.

A series (one spectrum or trace) is one row with an array of bins, so fitting, rejecting and refitting need no shuffle after the
series is gathered. Arrays are folded by JVM functions; a series has as many bins as its axis, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Floors of frequency and power under the logarithm, MAD to standard deviation, the least MAD that rejects.
FREQ_FLOOR, POWER_FLOOR, MAD_SCALE, LEAST_MAD = 1e-6, 1e-20, 1.482602218505602, 1e-12


def gathered(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "__s") -> DataFrame:
    """``keys`` and the array ``name`` of ``{f, p}`` in ascending ``order``; bins with a null, NaN or infinite side are left out."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    bins = F.collect_list(F.when(fine(order) & fine(value), F.struct(F.col(order).cast("double").alias("f"), F.col(value).cast("double").alias("p"))))
    return rows.groupBy(*keys).agg(F.array_sort(bins).alias(name))


def _median(values: str) -> str:
    """SQL of the median of an array of numbers; null when empty."""
    return f"((get(array_sort({values}), (size({values}) - 1) div 2) + get(array_sort({values}), size({values}) div 2)) / 2)"


def _with_line(df: DataFrame, points: str, name: str) -> DataFrame:
    """The least-squares line of ``points`` (``{f, x, y}``) as ``name {slope, intercept}``, by centred sums; null under two x."""
    centre = f"aggregate({points}, struct(0D AS x, 0D AS y), (a, p) -> struct(a.x + p.x AS x, a.y + p.y AS y), a -> struct(try_divide(a.x, size({points})) AS x, try_divide(a.y, size({points})) AS y))"
    slope = f"aggregate({points}, struct(0D AS u, 0D AS v), (a, p) -> struct(a.u + (p.x - __c.x) * (p.x - __c.x) AS u, a.v + (p.x - __c.x) * (p.y - __c.y) AS v), a -> try_divide(a.v, a.u))"
    return df.withColumn("__c", F.expr(centre)).withColumn("__b", F.expr(slope)).withColumn(name, F.expr("struct(__b AS slope, __c.y - __b * __c.x AS intercept)")).drop("__c", "__b")


def _residuals(points: str, line: str) -> str:
    return f"transform({points}, p -> p.y - {line}.intercept - {line}.slope * p.x)"


def robust_lines(spectra: DataFrame, bins: str = "__s", *, low: float = 2.0, high: float = 40.0, rounds: int = 3, z: float = 3.5, least: int = 5) -> DataFrame:
    """Log-log lines with rounds of peak rejection.

    Adds ``__points`` (``{f, x, y}`` of all bins, floored logarithms), ``__kept`` (bins of the fit), ``__last`` (the line that the
    last round rejected by) and ``__line`` (the line of the kept bins); lines are null under ``least`` bins inside ``[low, high]``.
    A round leaves out bins whose residual is over ``z`` scaled MADs, unless no residual is positive, the MAD vanishes or fewer
    than ``least`` bins would stay.
    """
    df = spectra.withColumn("__points", F.expr(f"transform({bins}, s -> struct(s.f AS f, log10(greatest(s.f, {FREQ_FLOOR}D)) AS x, log10(greatest(s.p, {POWER_FLOOR}D)) AS y))"))
    df = df.withColumn("__kept", F.expr(f"filter(__points, p -> p.f BETWEEN {low}D AND {high}D)"))
    df = df.withColumn("__kept", F.expr(f"if(size(__kept) >= {least}, __kept, filter(__kept, p -> false))"))
    df = df.withColumn("__last", F.expr("cast(null AS struct<slope: double, intercept: double>)"))
    for _ in range(rounds):
        df = _with_line(df.drop("__last"), "__kept", "__last").withColumn("__r", F.expr(_residuals("__kept", "__last")))
        # the median is bound once: a column used in one place only would be put into the lambda and sorted anew for every bin
        off = f"get(transform(array({_median('__r')}), m -> transform(__r, r -> abs(r - m))), 0)"
        df = df.withColumn("__off", F.expr(off)).withColumn("__mad", F.expr(f"{MAD_SCALE}D * {_median('__off')}"))
        df = df.withColumn("__next", F.expr(f"filter(__kept, p -> p.y - __last.intercept - __last.slope * p.x <= {z}D * __mad)"))
        able = f"coalesce(exists(__r, r -> r > 0) AND __mad >= {LEAST_MAD}D AND size(__next) >= {least}, false)"
        df = df.withColumn("__kept", F.expr(f"if({able}, __next, __kept)")).drop("__r", "__off", "__mad", "__next")
    return _with_line(df, "__kept", "__line")


def with_residual(df: DataFrame, line: str = "__line", name: str = "__res") -> DataFrame:
    """``name``: an array of ``{f, v}``, the residual of every bin over ``line``; empty where there is no line."""
    return df.withColumn(name, F.expr(f"coalesce(if({line}.slope IS NULL, NULL, transform(__points, p -> struct(p.f AS f, p.y - {line}.intercept - {line}.slope * p.x AS v))), cast(array() AS array<struct<f: double, v: double>>))"))


def _fold(values: str) -> str:
    """For each place the lowest value back to the nearest higher one before it, and where its run of equal values began.

    A monotone stack: places that are not higher than the new one are popped, and their lows with them.
    """
    state = "struct(cast(array() AS array<struct<v: double, low: double>>) AS stack, cast(array() AS array<struct<low: double, run: int>>) AS out)"
    popped = "aggregate(filter(a.stack, e -> e.v <= x), x, (m, e) -> least(m, e.low))"
    run = f"if(size(a.out) > 0 AND get({values}, size(a.out) - 1) = x, get(a.out, size(a.out) - 1).run, size(a.out))"
    step = f"struct(concat(filter(a.stack, e -> e.v > x), array(struct(x AS v, {popped} AS low))) AS stack, concat(a.out, array(struct({popped} AS low, {run} AS run))) AS out)"
    return f"aggregate({values}, {state}, (a, x) -> {step}, a -> a.out)"


def with_prominence(df: DataFrame, values: str, name: str) -> DataFrame:
    """``name``: an array of ``{at, value, prominence, peak}`` for every place of the array ``values`` (no nulls).

    Prominence is the height over the higher one of the two lowest points on the way to a strictly higher value, or to the end, on
    either side. ``peak`` marks local maxima: of a run of equal values lower on both sides the middle place (the left of two);
    places in the first and last run are none.
    """
    df = df.withColumn("__v", F.expr(values)).withColumn("__w", F.expr("reverse(__v)"))
    df = df.withColumn("__left", F.expr(_fold("__v"))).withColumn("__right", F.expr(f"reverse({_fold('__w')})"))
    first, last = "get(__left, i).run", "(size(__v) - 1 - get(__right, i).run)"
    # the run before is lower if the place before the run is, and likewise after it
    peak = f"({first} > 0 AND {last} < size(__v) - 1 AND i = ({first} + {last}) div 2 AND get(__v, {first} - 1) < x AND get(__v, {last} + 1) < x)"
    each = f"transform(__v, (x, i) -> struct(i AS at, x AS value, x - greatest(get(__left, i).low, get(__right, i).low) AS prominence, coalesce({peak}, false) AS peak))"
    return df.withColumn(name, F.expr(each)).drop("__v", "__w", "__left", "__right")


def prominent_peaks(rows: DataFrame, keys: list[str], order: str, value: str, least: float = 0.0) -> DataFrame:
    """``keys, order, value, prominence`` of every local maximum of each series whose prominence is at least ``least``."""
    df = with_prominence(gathered(rows, keys, order, value), "transform(__s, s -> s.p)", "__p")
    found = F.expr(f"transform(filter(__p, p -> p.peak AND p.prominence >= {least}D), p -> struct(get(__s, p.at).f AS `{order}`, p.value AS `{value}`, p.prominence AS prominence))")
    return df.select(*keys, F.explode(found).alias("__e")).select(*keys, "__e.*")


def alpha_peak(df: DataFrame, residual: str = "__res", *, low: float = 7.0, high: float = 13.0, least: float = 0.05) -> DataFrame:
    """Adds ``iaf``: the frequency of the most prominent peak of the residual in ``[low, high]`` (the lower one of equals), else the
    centre of its positive part, else null; and ``prominence`` (null without a peak)."""
    df = df.withColumn("__in", F.expr(f"filter({residual}, r -> r.f BETWEEN {low}D AND {high}D)"))
    df = with_prominence(df, "transform(__in, r -> r.v)", "__p")
    df = df.withColumn("__best", F.expr(f"array_max(transform(filter(__p, p -> p.peak AND p.prominence >= {least}D), p -> struct(p.prominence AS prominence, -p.at AS place)))"))
    centre = "aggregate(__in, struct(0D AS a, 0D AS b), (s, r) -> struct(s.a + r.f * greatest(r.v, 0D) AS a, s.b + greatest(r.v, 0D) AS b), s -> if(s.b > 0, s.a / s.b, NULL))"
    df = df.withColumn("iaf", F.expr(f"coalesce(get(__in, -__best.place).f, {centre})")).withColumn("prominence", F.col("__best.prominence"))
    return df.drop("__in", "__p", "__best")


def shifted_bands(iaf: Column, *, width: float = 2.0, beta: tuple[float, float] = (13.0, 30.0)) -> list[Column]:
    """Theta, alpha and beta limits around an individual alpha frequency, as six columns."""
    low, high = F.greatest(F.lit(6.0), iaf - width), F.least(F.lit(14.0), iaf + width)
    given = lambda c: F.when(iaf.isNotNull(), c)
    limits = {"theta_low": F.greatest(F.lit(3.0), iaf - 6.0), "theta_high": F.greatest(F.lit(4.0), low), "alpha_low": low, "alpha_high": high, "beta_low": F.greatest(F.lit(beta[0]), high), "beta_high": F.lit(beta[1])}
    return [given(c).alias(n) for n, c in limits.items()]


def individual_alpha(psd: DataFrame, keys: list[str], *, least_bins: int = 10, **peak: float) -> DataFrame:
    """``keys, iaf, prominence`` and shifted bands of the mean spectrum of each key, over a robust line through 2 to 40 Hz."""
    mean = psd.groupBy(*keys, "freq").agg(F.avg("power").alias("power"))
    return _alpha(mean, keys, least_bins, **peak)


def _alpha(mean: DataFrame, keys: list[str], least_bins: int, **peak: float) -> DataFrame:
    lines = robust_lines(gathered(mean, keys, "freq", "power"), rounds=2, z=2.5)
    enough = F.expr(f"size(filter(__points, p -> p.f BETWEEN 2D AND 40D)) >= {least_bins}")
    df = alpha_peak(with_residual(lines.withColumn("__line", F.when(enough, F.col("__line")))), **peak)
    return df.select(*keys, "iaf", "prominence", *shifted_bands(F.col("iaf")))


def fold_alpha(psd: DataFrame, fold: str, unit: str = "trial_id", *, least_units: int = 5, least_bins: int = 10, **peak: float) -> DataFrame:
    """``individual_alpha`` for each held-out fold from the mean spectrum of the rows of all other folds.

    Means come from totals less the fold's own sums, so rows are read once. A fold with fewer than ``least_units`` units outside
    it has no frequency.
    """
    own = psd.groupBy(fold, "freq").agg(F.sum("power").alias("__own"), F.count("power").alias("__n"))
    total = own.groupBy("freq").agg(F.sum("__own").alias("__all"), F.sum("__n").alias("__count"))
    units = psd.groupBy(fold).agg(F.countDistinct(unit).alias("__units"))
    # one row with the bins of the axis goes to every fold
    axis = total.agg(F.collect_list(F.struct("freq", "__all", "__count")).alias("__bins")).crossJoin(units.agg(F.sum("__units").alias("__total")))
    every = units.crossJoin(F.broadcast(axis)).withColumn("__outside", F.col("__total") - F.col("__units"))
    every = every.select(fold, "__outside", F.explode("__bins").alias("__b")).select(fold, "__outside", "__b.*")
    rest = every.join(own, [fold, "freq"], "left").withColumn("power", F.try_divide(F.col("__all") - F.coalesce("__own", F.lit(0.0)), F.col("__count") - F.coalesce("__n", F.lit(0))))
    trained = rest.withColumn("power", F.when(F.col("__outside") >= least_units, F.col("power")))
    return _alpha(trained, [fold], least_bins, **peak)


def peak_frequency(psd: DataFrame, keys: list[str], low: float, high: float, *, smoothing_hz: float = 1.0, least: float = 0.1) -> DataFrame:
    """``keys, peak_freq, peak_power, peak_ratio, peak_residual``: the greatest bin in ``[low, high]`` of the spectrum over its robust line.

    Ratio and residual are smoothed over ``smoothing_hz``. If the greatest is less than ``least`` over the median residual of the
    band, the centre of gravity takes its place and power is that of the bin nearest to it.
    """
    # filtered before the fit: a filter on what the fit makes would be pushed down and repeat it
    spectra = gathered(psd, keys, "freq", "power").where(F.expr(f"exists(__s, s -> s.f BETWEEN {low}D AND {high}D)"))
    df = robust_lines(spectra, low=min(2.0, low), high=max(40.0, high), rounds=2, z=2.5)
    df = with_residual(df).withColumn("__in", F.expr(f"filter(__res, r -> r.f BETWEEN {low}D AND {high}D)")).withColumn("__raw", F.expr(f"filter(__s, s -> s.f BETWEEN {low}D AND {high}D)"))
    df = df.withColumn("__steps", F.expr("transform(slice(__in, 2, greatest(size(__in) - 1, 0)), (r, i) -> r.f - get(__in, i).f)"))
    width = f"if(size(__in) > 3 AND {_median('__steps')} > 0, greatest(1, cast(floor({smoothing_hz}D / {_median('__steps')}) AS int)), 1)"
    smooth = lambda v: f"transform(__in, (r, i) -> aggregate(sequence(i - __n div 2, i - __n div 2 + __n - 1), 0D, (a, j) -> a + {v.replace('#', 'get(__in, least(greatest(j, 0), size(__in) - 1)).v')}) / __n)"
    df = df.withColumn("__n", F.expr(width)).withColumn("__ratio", F.expr(smooth("pow(10D, #)"))).withColumn("__level", F.expr(smooth("#")))
    df = df.withColumn("__top", F.expr("-array_max(transform(__ratio, (x, i) -> struct(x AS x, -i AS i))).i"))
    gravity = "aggregate(zip_with(__in, __ratio, (r, x) -> struct(r.f * x AS a, x AS b)), struct(0D AS a, 0D AS b), (s, e) -> struct(s.a + e.a AS a, s.b + e.b AS b), s -> try_divide(s.a, s.b))"
    df = df.withColumn("peak_freq", F.expr(f"if(get(__level, __top) - {_median('__level')} < {least}D, {gravity}, get(__in, __top).f)"))
    df = df.withColumn("__at", F.expr("array_min(transform(__in, (r, i) -> struct(abs(r.f - peak_freq) AS d, i AS i))).i"))
    df = df.withColumn("peak_power", F.expr("get(__raw, __at).p")).withColumn("__fit", F.expr("__line.intercept + __line.slope * log10(get(__in, __at).f)"))
    return df.select(*keys, "peak_freq", "peak_power", F.expr("peak_power / pow(10D, __fit)").alias("peak_ratio"), F.expr("log10(peak_power) - __fit").alias("peak_residual"))


def aperiodic_fit(psd: DataFrame, keys: list[str], *, low: float = 2.0, high: float = 40.0, rounds: int = 3, z: float = 3.5) -> DataFrame:
    """``keys, n_valid, n_kept, offset, exponent, r2, rms``: the robust log-log line and how well it fits the bins it kept."""
    df = robust_lines(gathered(psd, keys, "freq", "power"), low=low, high=high, rounds=rounds, z=z)
    df = df.withColumn("__r", F.expr(_residuals("__kept", "__line"))).withColumn("__my", F.expr("try_divide(aggregate(__kept, 0D, (a, p) -> a + p.y), size(__kept))"))
    squares = "aggregate(__r, 0D, (a, r) -> a + r * r)"
    return df.select(
        *keys,
        F.expr(f"size(filter(__points, p -> p.f BETWEEN {low}D AND {high}D))").alias("n_valid"),
        F.expr("size(__kept)").alias("n_kept"),
        F.col("__line.intercept").alias("offset"),
        (-F.col("__line.slope")).alias("exponent"),
        F.expr(f"1 - try_divide({squares}, nullif(aggregate(__kept, 0D, (a, p) -> a + (p.y - __my) * (p.y - __my)), 0D))").alias("r2"),
        F.expr(f"sqrt(try_divide({squares}, size(__kept)))").alias("rms"),
    )


def periodic_measures(psd: DataFrame, keys: list[str], band: tuple[float, float], *, theta: tuple[float, float] = (4.0, 7.9), beta: tuple[float, float] = (13.0, 30.0), low: float = 2.0, high: float = 40.0, z: float = 3.5) -> DataFrame:
    """``keys, center, height, bandwidth, theta_beta, theta_beta_raw, corrected_power``.

    Peaks are the greatest bins of runs of bins that the line rejected with a positive residual; the highest of those inside
    ``band`` counts. Its bandwidth is the full width at half prominence on the positive residuals, between bins by interpolation.
    ``theta_beta`` is the ratio of mean power over the line, ``theta_beta_raw`` that of mean power, ``corrected_power`` the mean of
    power over the line in ``band``, weighted by bin widths. Only bins in ``[low, high]`` count.
    """
    inside = psd.where(F.col("freq").between(low, high))
    df = with_residual(with_residual(robust_lines(gathered(inside, keys, "freq", "power"), low=low, high=high, z=z), "__last", "__old"))
    df = with_prominence(df, "transform(__old, r -> greatest(r.v, 0D))", "__p")
    # a rejected bin is one that the kept ones do not hold; frequencies are distinct in a spectrum
    df = df.withColumn("__out", F.expr("transform(__old, (r, i) -> r.v > 0 AND NOT exists(__kept, k -> k.f = r.f))"))
    # rejected bins of one run have equally many others before them
    df = df.withColumn("__bins", F.expr("transform(__old, (r, i) -> struct(r.f AS f, r.v AS v, -i AS place, if(get(__out, i), size(filter(slice(__out, 1, i + 1), o -> NOT o)), NULL) AS run))"))
    df = df.withColumn("__apex", F.expr("filter(__bins, b -> b.run IS NOT NULL AND struct(b.v, b.place) = array_max(transform(filter(__bins, c -> c.run = b.run), c -> struct(c.v, c.place))))"))
    best = f"array_max(transform(filter(__apex, b -> b.f BETWEEN {band[0]}D AND {band[1]}D), b -> struct(b.v AS height, b.place AS place, b.f AS f)))"
    df = df.withColumn("__best", F.expr(best)).withColumn("__i", F.expr("-__best.place")).withColumn("__h", F.expr("get(__p, __i).value - get(__p, __i).prominence / 2"))
    below = lambda side: f"filter(sequence(0, size(__p) - 1), j -> get(__p, j).value <= __h AND j {side} __i)"
    df = df.withColumn("__l", F.expr(f"if(get(__p, __i).prominence > 0, array_max({below('<=')}), __i)")).withColumn("__r", F.expr(f"if(get(__p, __i).prominence > 0, array_min({below('>=')}), __i)"))
    step = lambda a, b: f"coalesce(try_divide(__h - get(__p, {a}).value, get(__p, {b}).value - get(__p, {a}).value), 0D)"
    hz = lambda a, b: f"(get(__old, {a}).f + if({a} = __i, 0D, {step(a, b)} * (get(__old, {b}).f - get(__old, {a}).f)))"
    df = df.withColumn("bandwidth", F.expr(f"if(__best IS NULL, NULL, greatest(abs({hz('__r', '__r - 1')} - {hz('__l', '__l + 1')}), 1e-6D))"))
    mean = lambda source, value, limits: f"aggregate(filter({source}, e -> e.f BETWEEN {limits[0]}D AND {limits[1]}D), struct(0D AS s, 0 AS n), (a, e) -> struct(a.s + {value} AS s, a.n + 1 AS n), a -> try_divide(a.s, a.n))"
    ratio = lambda source, value: F.expr(f"try_divide({mean(source, value, theta)}, nullif({mean(source, value, beta)}, 0D))")
    weight = "(coalesce(get(__res, i + 1).f, e.f) - coalesce(if(i > 0, get(__res, i - 1).f, NULL), e.f)) / 2"
    df = df.withColumn("__w", F.expr(f"filter(transform(__res, (e, i) -> struct(e.f AS f, pow(10D, e.v) AS v, {weight} AS w)), e -> e.f BETWEEN {band[0]}D AND {band[1]}D)"))
    corrected = "aggregate(__w, struct(0D AS a, 0D AS b), (s, e) -> struct(s.a + e.v * e.w AS a, s.b + e.w AS b), s -> try_divide(s.a, s.b))"
    return df.select(*keys, F.col("__best.f").alias("center"), F.col("__best.height").alias("height"), "bandwidth", ratio("__res", "pow(10D, e.v)").alias("theta_beta"), ratio("__s", "e.p").alias("theta_beta_raw"), F.expr(corrected).alias("corrected_power"))
