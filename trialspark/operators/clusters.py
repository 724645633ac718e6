"""Clusters of neighbouring cells and their permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .stats import benjamini_hochberg, permuted
from .windows import moment_corr


def components(cells: DataFrame, keys: list[str], axes: list[str], values: list[str], adjacency: DataFrame | None = None) -> DataFrame:
    """Every given cell with the least cell of its cluster (``label``): cells one step apart on one axis are neighbours.

    With ``adjacency`` (columns ``a``, ``b``, both directions) the first axis is a name and neighbours on it are the pairs given.
    Least labels spread over neighbours, and each label is replaced by its own label's label, so rounds grow with the logarithm
    of a cluster's length. A round is written out, which cuts the lineage.
    """
    node = cut(cells.select(*keys, *axes, *values, F.struct(*axes).alias("label")))
    while True:
        moved = [node.withColumn(x, F.col(x) + step).select(*keys, *axes, "label") for x in (axes[1:] if adjacency is not None else axes) for step in (-1, 1)]
        if adjacency is not None:
            moved.append(node.join(adjacency, node[axes[0]] == adjacency["a"]).select(*keys, F.col("b").alias(axes[0]), *axes[1:], "label"))
        near = moved[0]
        for other in moved[1:]:
            near = near.unionByName(other)
        near = near.groupBy(*keys, *axes).agg(F.min("label").alias("__other"))
        spread = node.join(near, [*keys, *axes], "left").withColumn("__next", F.least("label", "__other")).drop("__other")
        above = spread.select(*keys, F.struct(*axes).alias("__next"), F.col("__next").alias("__top"))
        new = cut(spread.join(above, [*keys, "__next"]).select(*keys, *axes, *values, "label", F.least("__next", "__top").alias("__next")))
        if new.where("__next <> label").isEmpty():
            return node
        node = new.select(*keys, *axes, *values, F.col("__next").alias("label"))


def voxel_clusters(voxels: DataFrame, keys: list[str], z: str, least: int, z_cut: float | None = None, p: str | None = None, q_cut: float = 0.05) -> DataFrame:
    """Voxels at ``x, y, z_axis`` that pass a threshold and lie in a cluster of at least ``least`` voxels, each joined by its six
    neighbours: ``|z| >= z_cut``, or q under ``q_cut`` by Benjamini-Hochberg over the column ``p``."""
    axes = ["x", "y", "z_axis"]
    if z_cut is not None:
        kept = voxels.where(F.abs(z) >= z_cut)
    else:
        kept = benjamini_hochberg(voxels.withColumn("__one", F.lit(1)), p, [*keys, "__one"], axes).where(F.col("q") < q_cut)
    node = components(kept, keys, axes, [z])
    size = node.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= least)
    return node.join(size, [*keys, "label"]).select(*keys, *axes, z, "cluster_size")


def max_mass_p(observed: DataFrame, null: DataFrame, keys: list[str], n_perm: int) -> DataFrame:
    """p of each cluster, ``(largest null masses at least its own + 1) / (n_perm + 1)``; a permutation without clusters counts as
    a mass of zero. ``null`` has ``perm`` and ``mass``; its largest mass is over the whole map of a key."""
    top = null.groupBy(*keys, "perm").agg(F.max("mass").alias("__m"))
    tops = top.groupBy(*keys).agg(F.collect_list("__m").alias("__tops"))  # one value a permutation
    both = observed.join(tops, keys, "left") if keys else observed.crossJoin(F.broadcast(tops))
    extreme = F.size(F.filter(F.coalesce("__tops", F.array().cast("array<double>")), lambda m: m >= F.col("mass") - 1e-12))
    return both.withColumn("p", (extreme + 1) / F.lit(n_perm + 1.0)).drop("__tops")


def correlation_cells(df: DataFrame, keys: list[str], cell: list[str], value: str, target: str) -> DataFrame:
    return df.groupBy(*keys, *cell).agg(moment_corr(F.col(value), F.col(target)).alias("r"))


def shuffled_target(df: DataFrame, unit: str, target: str, n_perm: int, blocks: tuple[str, ...] = ()) -> DataFrame:
    """The table once for each permutation, with one target a unit shuffled over the units of its block, or over all units."""
    units = df.select(unit, target, *blocks).distinct().withColumn("__one", F.lit(1))
    mixed = permuted(units, [*blocks, "__one"], unit, target, n_perm).select("perm", unit, F.col("permuted").alias(target))
    return df.drop(target).join(mixed, unit)


def two_condition_cells(df: DataFrame, keys: list[str], cell: list[str], value: str, label: str) -> DataFrame:
    """Welch t of condition 1 against condition 0 in each cell; null when not determined."""
    side = lambda k: F.when(F.col(label) == k, F.col(value))
    s = df.groupBy(*keys, *cell).agg(*(f(side(k)).alias(f"__{n}{k}") for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    se = F.sqrt(F.try_divide("__v0", "__n0") + F.try_divide("__v1", "__n1"))
    return s.select(*keys, *cell, F.try_divide(F.col("__m1") - F.col("__m0"), F.nullif(se, F.lit(0.0))).alias("t"))


def masses(cells: DataFrame, keys: list[str], axes: list[str], stat: str, cut_off: float, adjacency: DataFrame | None = None) -> DataFrame:
    """Clusters of cells over the cut with one sign: ``keys, sign, label, n, mass`` (sum of the absolute statistic)."""
    over = cells.where(F.abs(stat) > cut_off).withColumn("sign", F.signum(stat).cast("int"))
    node = components(over, [*keys, "sign"], axes, [stat], adjacency)
    return node.groupBy(*keys, "sign", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(stat)).alias("mass"))


def two_condition_test(df: DataFrame, unit: str, axes: list[str], value: str, label: str, cut_off: float, n_perm: int, adjacency: DataFrame | None = None) -> DataFrame:
    """Cluster test of two conditions over channel and time: units' labels are shuffled, the largest mass of each shuffle is the null."""
    observed = masses(two_condition_cells(df, [], axes, value, label), [], axes, "t", cut_off, adjacency)
    null = masses(two_condition_cells(shuffled_target(df, unit, label, n_perm), ["perm"], axes, value, label), ["perm"], axes, "t", cut_off, adjacency)
    return max_mass_p(observed, null, [], n_perm)


def largest_cluster(cells: DataFrame, keys: list[str], axes: list[str], stat: str, cut_off: float) -> DataFrame:
    """Cells of the largest cluster with an absolute statistic of at least ``cut_off``."""
    node = components(cells.where(F.abs(stat) >= cut_off), keys, axes, [stat])
    return node.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))


def laterality(df: DataFrame, keys: list[str], t: str, value: str, onset: float, rebound: float, latency: float, least: int) -> DataFrame:
    """Desynchronisation of a percent trace: trough, its magnitude, the first sustained run at or under ``-onset``, and the rebound
    from ``latency`` after the trough on, given only where a run of ``least`` samples reaches ``rebound``."""
    from .windows import first_sustained

    x = F.col(value)
    trough = df.where(x.isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(F.col(t).alias("t"), x.alias("x")), F.struct(x, F.col(t))).alias("__p"))
    trough = trough.select(*keys, F.col("__p.t").alias("peak_latency"), F.greatest(-F.col("__p.x"), F.lit(0.0)).alias("erd_magnitude"))
    first = first_sustained(df, F.coalesce(x <= -onset, F.lit(False)), keys, t, least).withColumnRenamed("onset", "onset_latency")
    late = df.join(trough.select(*keys, "peak_latency"), keys).where(F.col(t) >= F.col("peak_latency") + latency)
    back = first_sustained(late, F.coalesce(x >= rebound, F.lit(False)), keys, t, least)
    top = late.where(x.isNotNull()).groupBy(*keys).agg(F.max(value).alias("rebound_magnitude"), F.max_by(t, F.struct(x, -F.col(t))).alias("rebound_latency"))
    return trough.join(first, keys, "left").join(back.drop("onset").join(top, keys), keys, "left")


def coupling_surrogates(analytic: DataFrame, keys: list[str], trial: str, phase: int, amplitude: int, n_surrogates: int, seed: int = 1) -> DataFrame:
    """Phase-amplitude coupling of each trial against surrogates, where the phase comes from another trial of the keys: the next
    one in a hash order, so no trial is its own donor. ``pac``, mean and spread of the surrogates, and z; null z without spread."""
    mag = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    unit = lambda c: F.try_divide(F.col(c), mag)
    ph = analytic.where(F.col("channel") == phase).select(*keys, trial, "t", unit("re").alias("__c"), unit("im").alias("__s"))
    amp = analytic.where(F.col("channel") == amplitude).select(*keys, trial, "t", mag.alias("__a"))

    def coupled(rows: DataFrame, by: list[str]) -> DataFrame:
        x, y = F.sum(F.col("__a") * F.col("__c")), F.sum(F.col("__a") * F.col("__s"))
        return rows.groupBy(*by).agg(F.try_divide(F.sqrt(x * x + y * y), F.sum("__a")).alias("pac"))

    real = coupled(amp.join(ph, [*keys, trial, "t"]), [*keys, trial])
    each = amp.select(*keys, trial).distinct().withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n_surrogates))))
    w = Window.partitionBy(*keys, "__k").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "__k", trial).cast("binary")), trial)
    donors = each.withColumn("__donor", F.coalesce(F.lead(trial).over(w), F.first(trial).over(w)))
    drawn = donors.where(F.col("__donor") != F.col(trial)).join(amp, [*keys, trial]).join(ph.withColumnRenamed(trial, "__donor"), [*keys, "__donor", "t"])
    null = coupled(drawn, [*keys, trial, "__k"]).groupBy(*keys, trial).agg(F.avg("pac").alias("surrogate_mean"), F.stddev_pop("pac").alias("surrogate_sd"))
    return real.join(null, [*keys, trial], "left").withColumn("z", F.try_divide(F.col("pac") - F.col("surrogate_mean"), F.nullif("surrogate_sd", F.lit(0.0))))


def bayes_factor(table: DataFrame, prior: float = 0.7071067811865476, least: int = 4, terms: int = 400) -> DataFrame:
    """Bayes factor for ``r`` over ``n`` pairs and Jeffreys' words. The hypergeometric factor is summed by its series."""
    r2, n = F.col("r") * F.col("r"), F.col("n").cast("double")
    c = (n + 1) / 2
    start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))

    def step(acc, k):
        t = acc["t"] * (k + 0.5) * (k + 0.5) / ((c + k) * (k + 1)) * r2
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["s"])
    ok = (F.col("n") >= least) & (F.abs("r") < 1)
    log_bf = F.log(F.lit(2.0**0.5 / prior)) + 0.5 * F.log(n - 1) + (n - 1) / 2 * F.log1p(-r2) + F.log(series)
    bf = F.col("bf10")
    word = F.when(bf < 0.01, "extreme_H0").when(bf < 1 / 30, "very_strong_H0").when(bf < 0.1, "strong_H0").when(bf < 1 / 3, "moderate_H0").when(bf < 1, "anecdotal_H0")
    word = word.when(bf < 3, "anecdotal_H1").when(bf < 10, "moderate_H1").when(bf < 30, "strong_H1").when(bf < 100, "very_strong_H1").when(bf.isNotNull(), "extreme_H1")
    return table.withColumn("bf10", F.when(ok, F.exp(log_bf))).withColumn("evidence", F.coalesce(word, F.when(F.col("n") < least, "insufficient_data").otherwise("invalid_r")))
