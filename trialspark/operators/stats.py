"""Correlation, regression by sums, group comparison, multiple testing, hash permutation and bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .scans import carried, numbered
from .windows import average_rank, clipped, distinct_names, moment_corr

CLIP = 0.999999


def correlations(df: DataFrame, keys: list[str], x: str, y: str, method: str = "pearson", least: int = 3) -> DataFrame:
    """``keys, n, r`` over finite pairs; null under ``least`` pairs or when a side is constant."""
    distinct_names(keys, "n", "r")
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    if method == "spearman":
        both = both.withColumn("__x", average_rank(x, keys)).withColumn("__y", average_rank(y, keys))
        x, y = "__x", "__y"
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col(x), F.col(y)).alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def fisher(r: Column) -> Column:
    return F.atanh(clipped(r, CLIP))


def fisher_interval(table: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Fisher z, its standard error and the interval of r; null under four pairs."""
    se = F.when(F.col("n") > 3, 1 / F.sqrt(F.col("n") - 3.0))
    return table.withColumn("z", fisher(F.col("r"))).withColumn("se", se).withColumn("low", F.tanh(F.col("z") - z * F.col("se"))).withColumn("high", F.tanh(F.col("z") + z * F.col("se")))


def group_correlation(per_subject: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Mean of Fisher z over subjects, turned back."""
    ok = per_subject.where((F.col("n") >= least) & F.col("r").isNotNull())
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_subjects"), F.tanh(F.avg(fisher(F.col("r")))).alias("r"))


def partial_one(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Partial correlation given one covariate, its t and degrees of freedom."""
    c = lambda a, b: moment_corr(F.col(a), F.col(b))
    t = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), c(x, y).alias("xy"), c(x, z).alias("xz"), c(y, z).alias("yz"))
    scale = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    t = t.withColumn("r", F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.nullif(scale, F.lit(0.0)))).withColumn("dof", F.col("n") - 3)
    return t.withColumn("t", F.when(F.col("dof") > 0, F.col("r") * F.sqrt(F.try_divide(F.col("dof"), 1 - F.col("r") * F.col("r")))))


def leave_one_out(df: DataFrame, unit: str, x: str, y: str) -> DataFrame:
    """Correlation without each unit: all moments, about the overall means, less the unit's own; null without other units."""
    middle = df.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    df = df.crossJoin(F.broadcast(middle)).select(unit, (F.col(x) - F.col("__mx")).alias(x), (F.col(y) - F.col("__my")).alias(y))
    sums = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "syy": F.sum(F.col(y) * F.col(y)), "sxy": F.sum(F.col(x) * F.col(y))}
    own = df.groupBy(unit).agg(*(v.cast("double").alias(k) for k, v in sums.items()))
    total = own.agg(*(F.sum(k).alias(f"t_{k}") for k in sums))
    rest = own.crossJoin(F.broadcast(total)).select(unit, *((F.col(f"t_{k}") - F.col(k)).alias(k) for k in sums))
    over_n = lambda a, b: F.try_divide(F.col(a) * F.col(b), F.col("n"))
    cov = F.col("sxy") - over_n("sx", "sy")
    scale = F.sqrt(F.greatest((F.col("sxx") - over_n("sx", "sx")) * (F.col("syy") - over_n("sy", "sy")), F.lit(0.0)))
    return rest.select(unit, F.try_divide(cov, F.nullif(scale, F.lit(0.0))).alias("r"))


def winsorised(df: DataFrame, keys: list[str], x: str, y: str, trim: float = 0.2) -> DataFrame:
    """Correlation after pulling the lowest and highest ``int(trim * n)`` values of each side to their neighbours."""
    k = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) * trim).cast("int")
    out = df.withColumn("__k", k)
    for c in (x, y):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(c))
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        out = out.withColumn("__p", place).withColumn("__n", n)
        low = F.min(F.when(F.col("__p") > F.col("__k"), F.col(c))).over(Window.partitionBy(*keys))
        high = F.max(F.when(F.col("__p") <= F.col("__n") - F.col("__k"), F.col(c))).over(Window.partitionBy(*keys))
        out = out.withColumn(f"__{c}", F.least(F.greatest(F.col(c), low), high))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 2 * F.first("__k")).alias("effective_n"), moment_corr(F.col(f"__{x}"), F.col(f"__{y}")).alias("r"))


def simple_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r squared and standard error of the slope; null when ``x`` is constant."""
    distinct_names(keys, "n", "slope", "intercept", "sxx", "syy", "sxy", "r2", "rss", "se")
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    return s.withColumn("r2", F.try_divide(F.col("sxy") * F.col("sxy"), F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0)))).withColumn("rss", rss).withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.try_divide(F.greatest(F.col("rss"), F.lit(0.0)) / (F.col("n") - 2), F.nullif(F.col("sxx"), F.lit(0.0))))))


def icc(df: DataFrame, unit: str, run: str, value: str, n_runs: int) -> DataFrame:
    """ICC(1,1), ICC(2,1), ICC(3,1) and ICC(3,k) from mean squares over complete units, clipped to [-1, 1]."""
    w = Window.partitionBy(unit)
    d = df.withColumn("__k", F.count(F.lit(1)).over(w)).where(F.col("__k") == n_runs)
    middle = d.agg(F.avg(value).alias("__m"))
    d = d.crossJoin(F.broadcast(middle)).select(F.col(unit).alias("__unit"), F.col(run).alias("__run"), (F.col(value) - F.col("__m")).alias("__x"))
    rows = d.groupBy("__unit").agg(F.sum("__x").alias("u"), F.sum(F.col("__x") * F.col("__x")).alias("q"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("g"), F.sum("q").alias("q"), F.sum(F.col("u") * F.col("u")).alias("uu"))
    c = d.groupBy("__run").agg(F.sum("__x").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    k = float(n_runs)
    t = r.crossJoin(F.broadcast(c)).withColumn("base", F.try_divide(F.col("g") * F.col("g"), F.col("n") * k))
    t = t.withColumn("ssr", F.col("uu") / k - F.col("base")).withColumn("ssc", F.try_divide(F.col("cc"), F.col("n")) - F.col("base")).withColumn("sst", F.col("q") - F.col("base"))
    t = t.withColumn("msr", F.try_divide(F.col("ssr"), F.col("n") - 1)).withColumn("msc", F.col("ssc") / (k - 1)).withColumn("msw", F.try_divide(F.col("sst") - F.col("ssr"), F.col("n") * (k - 1))).withColumn("mse", F.try_divide(F.col("sst") - F.col("ssr") - F.col("ssc"), (F.col("n") - 1) * (k - 1)))
    msr, msc, msw, mse = (F.col(x) for x in ("msr", "msc", "msw", "mse"))
    ratio = lambda a, b: clipped(F.try_divide(a, b), 1.0)
    return t.select("n", ratio(msr - msw, msr + (k - 1) * msw).alias("icc11"), ratio(msr - mse, msr + (k - 1) * mse + k * F.try_divide(msc - mse, F.col("n"))).alias("icc21"), ratio(msr - mse, msr + (k - 1) * mse).alias("icc31"), ratio(msr - mse, msr).alias("icc3k"))


def two_groups(df: DataFrame, keys: list[str], value: str, a: Column, b: Column) -> DataFrame:
    """Welch t with its degrees of freedom, Cohen d and Hedges g of A against B."""
    distinct_names(keys, "na", "nb", "ma", "mb", "va", "vb", "t", "dof", "d", "g")
    x, y = F.when(a, F.col(value)), F.when(b, F.col(value))
    s = df.groupBy(*keys).agg(F.count(x).alias("na"), F.count(y).alias("nb"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_samp(x).alias("va"), F.var_samp(y).alias("vb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    s = s.where("na >= 2 AND nb >= 2").withColumn("t", F.try_divide(F.col("ma") - F.col("mb"), F.nullif(F.sqrt(ea + eb), F.lit(0.0))))
    s = s.withColumn("dof", F.try_divide(F.pow(ea + eb, F.lit(2.0)), F.nullif(ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1), F.lit(0.0))))
    s = s.withColumn("d", F.try_divide(F.col("ma") - F.col("mb"), F.nullif(pooled, F.lit(0.0))))
    return s.withColumn("g", F.col("d") * (1 - 3 / (4 * (F.col("na") + F.col("nb")) - 9)))


def paired(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Cohen dz of the differences, its small-sample form and the paired t."""
    distinct_names(keys, "n", "m", "s", "dz", "gz", "t")
    d = F.col(after) - F.col(before)
    s = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    s = s.withColumn("dz", F.try_divide(F.col("m"), F.nullif("s", F.lit(0.0))))
    return s.withColumn("gz", F.col("dz") * (1 - 3 / (4 * F.col("n") - 5.0))).withColumn("t", F.col("dz") * F.sqrt(F.col("n")))


def rank_sum(df: DataFrame, keys: list[str], value: str, group: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mann-Whitney U and its normal score (tie-corrected, continuity-corrected) for each pair of groups; no score for a lone value."""
    distinct_names(keys, "ga", "gb", "na", "nb", "u", "z")
    table = df.sparkSession.createDataFrame(pairs, "ga string, gb string")
    both = df.join(F.broadcast(table), (F.col(group) == F.col("ga")) | (F.col(group) == F.col("gb")))
    k = [*keys, "ga", "gb"]
    ranked = both.withColumn("__rank", average_rank(value, k)).withColumn("__ties", F.count(F.lit(1)).over(Window.partitionBy(*k, value)))
    is_a = F.col(group) == F.col("ga")
    s = ranked.groupBy(*k).agg(F.count_if(is_a).alias("na"), F.count_if(~is_a).alias("nb"), F.sum(F.when(is_a, F.col("__rank"))).alias("__ra"), F.sum(F.col("__ties") * F.col("__ties") - 1).cast("double").alias("__tie"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    s = s.withColumn("u", F.col("__ra") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide(F.col("__tie"), n * (n - 1))))
    off = F.col("u") - na * nb / 2
    return s.withColumn("z", F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), F.nullif(sd, F.lit(0.0)))).select(*k, "na", "nb", "u", "z")


def effect_words(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").when(x.isNotNull(), "large")


def _tested(p: str) -> Column:
    return F.coalesce(F.col(p).isNotNull() & ~F.isnan(p), F.lit(False))


def _raised(df: DataFrame, p: str, keys: list[str], tie: list[str]) -> DataFrame:
    """The tested rows in their places of their families, with ``__raw``: p * m / rank."""
    return numbered(df.where(_tested(p)), keys, [p, *tie]).withColumn("__raw", F.col(p) * F.col("__size") / F.col("__place"))


def _q_values(df: DataFrame, raised: DataFrame, p: str, keys: list[str]) -> DataFrame:
    out = carried(raised, keys, "__raw", "q", least_after=True).withColumn("q", F.least(F.lit(1.0), F.col("q")))
    return out.select(*df.columns, "q").unionByName(df.where(~_tested(p)).withColumn("q", F.lit(None).cast("double")))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], tie: list[str]) -> DataFrame:
    """q values inside each family; null and NaN p have none. A family of any size spreads over ranges of its p values."""
    df = cut(df)
    return _q_values(df, cut(_raised(df, p, keys, tie)), p, keys)


def simes(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """Simes p of each family: the least of p * m / rank."""
    return _raised(cut(df), p, keys, []).groupBy(*keys).agg(F.min("__raw").alias("family_p"))


def hierarchical_fdr(df: DataFrame, p: str, family: str, tie: list[str], alpha: float = 0.05) -> DataFrame:
    """Families gated by BH over Simes p (strictly under alpha), then BH inside; rejection needs both."""
    df = cut(df)
    raised = cut(_raised(df, p, [family], tie))  # equal p share the least of their p * m / rank whatever their order, so Simes reads it here too
    families = raised.groupBy(family).agg(F.min("__raw").alias("family_p")).withColumn("__all", F.lit(1))
    gate = benjamini_hochberg(families, "family_p", ["__all"], [family])
    gate = gate.select(family, "family_p", F.col("q").alias("family_q"), (F.col("q") < alpha).alias("gate"))
    inside = _q_values(df, raised, p, [family])
    return inside.join(gate, family, "left").withColumn("reject", F.coalesce((F.col("q") < alpha) & F.col("gate"), F.lit(False)))


def holm(df: DataFrame, p: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Holm-adjusted p inside each family; a null p has none and is not counted."""
    df = cut(df)
    rows = numbered(df.where(F.col(p).isNotNull()), keys, [p, *tie])
    rows = cut(rows.withColumn("__h", F.least(F.lit(1.0), (F.col("__size") - F.col("__place") + 1) * F.col(p))))
    out = carried(rows, keys, "__h", "p_holm", least_after=False)
    return out.select(*df.columns, "p_holm").unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def permuted(df: DataFrame, keys: list[str], order: str, value: str, n_perm: int, seed: int = 1) -> DataFrame:
    """``n_perm`` shuffles of a value inside groups: the value at the place of each row's hash rank.

    Rows and permutations are keyed by (keys, perm), so the work spreads over both.
    """
    rows = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true")
    each = rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).repartition(*keys, "perm")  # else all draws of a group stay in its task
    w = Window.partitionBy(*keys, "perm")
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "perm", order).cast("binary"))
    ranked = each.withColumn("place", F.row_number().over(w.orderBy(order))).withColumn("drawn", F.row_number().over(w.orderBy(mark, order)))
    return _dealt(ranked, [*keys, "perm"], value)


def _dealt(ranked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with the value (``permuted``) of the row of its group whose ``drawn`` is its ``place``, without a join: a row goes
    once to its own place and its value once to the place drawn, and both meet as neighbours in a window over the same groups."""
    kept = [c for c in ranked.columns if c not in {*keys, "drawn"}]
    row = F.struct(*kept)
    own = F.struct(F.col("place").alias("at"), F.lit(1).alias("side"), row.alias("row"), F.lit(None).cast(ranked.schema[value].dataType).alias("v"))
    given = F.struct(F.col("drawn").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(ranked.select(*kept).schema).alias("row"), F.col(value).alias("v"))
    both = ranked.select(*keys, F.explode(F.array(own, given)).alias("__b")).select(*keys, "__b.*")
    met = both.withColumn("permuted", F.lag("v").over(Window.partitionBy(*keys).orderBy("at", "side")))
    return met.where("side = 1").select(*keys, "row.*", "permuted")


def shifted(df: DataFrame, keys: list[str], order: str, value: str, n_perm: int, seed: int = 1, least: int = 1) -> DataFrame:
    """``n_perm`` circular shifts of a value inside groups: each group of each permutation is turned by a hash of its key.
    A group of fewer than ``least`` rows is an error."""
    w = Window.partitionBy(*keys)
    rows = df.select("*", F.row_number().over(w.orderBy(order)).alias("place"), F.count(F.lit(1)).over(w).alias("__n"))
    enough = F.when(F.col("__n") >= least, True).otherwise(F.raise_error(F.lit(f"a group has fewer than {least} rows")).cast("boolean"))
    each = rows.where(enough).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "perm", *keys).cast("binary")), 1, 8), 16, 10).cast("long")
    moved = (F.col("place") - 1 + mark % F.col("__n")) % F.col("__n") + 1
    source = each.select(*keys, "perm", moved.cast("int").alias("place"), F.col(value).alias("permuted"))
    return each.drop("__n").join(source, [*keys, "perm", "place"])


def permutation_p(observed: DataFrame, null: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """``(extreme + 1) / (n + 1)``, two-sided."""
    both = null.join(observed.select(*keys, F.col(stat).alias("observed")), keys)
    out = both.groupBy(*keys).agg(F.first("observed").alias("observed"), F.count_if(F.abs(stat) >= F.abs("observed") - 1e-12).alias("extreme"), F.count(stat).alias("n_perm"))
    return out.withColumn("p", (F.col("extreme") + 1) / (F.col("n_perm") + 1))


#: Rows of a group up to which its resamples are taken from one array.
MOST_LISTED = 4096


def bootstrap_draws(df: DataFrame, keys: list[str], order: str, n_boot: int, seed: int = 1) -> DataFrame:
    """``n_boot`` resamples with replacement of each group's rows: the place drawn is a hash modulo the group's size.

    Groups of at most ``MOST_LISTED`` rows are resampled where they lie, without moving a draw; larger ones by a join on the place.
    """
    w = Window.partitionBy(*keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true")
    kept = [c for c in df.columns if c not in keys]
    rows = known.repartition(parts, *keys) if keys else known  # a given number: few rows make many draws
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    boots, row = F.sequence(F.lit(0), F.lit(n_boot - 1)), F.struct("place", *kept)
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "boot", "slot").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = (hashed % F.col("size")).cast("int")
    listed = placed.where(F.col("size") <= MOST_LISTED).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    slots = listed.select(*keys, "__rows", F.size("__rows").alias("size"), F.explode(boots).alias("boot"))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot"))
    small = slots.select(*keys, "boot", F.get("__rows", drawn).alias("__row")).select(*keys, "boot", "__row.*")
    large = placed.where(F.col("size") > MOST_LISTED)
    draws = large.select(*keys, F.col("place").alias("slot"), "size", F.explode(boots).alias("boot")).withColumn("place", drawn).drop("size", "slot")
    joined = draws.join(large.drop("size").hint("merge"), [*keys, "place"])  # its guessed size is no guide
    return small.unionByName(joined.select(small.columns))


def sign_flip(df: DataFrame, keys: list[str], order: str, value: str, most_exact: int = 12, n_sampled: int = 1000, seed: int = 1) -> DataFrame:
    """Sign-flip p of a mean, ``(extreme + 1) / (patterns + 1)``: all patterns for groups of at most ``most_exact`` units,
    ``n_sampled`` hash-drawn ones (and the observed one, pattern 0) for larger groups."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("__place", (F.row_number().over(w.orderBy(order)) - 1).cast("int")).withColumn("__size", F.count(F.lit(1)).over(w).cast("int"))
    exact = F.col("__size") <= most_exact
    last = F.when(exact, F.expr(f"shiftleft(1, least(__size, {most_exact})) - 1")).otherwise(n_sampled)
    # units are few rows, but their patterns many: blocks of units spread over as many tasks as shuffles have
    block = F.floor(F.col("__place") / 256)
    spread = placed.withColumn("__block", block).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__block")
    each = spread.withColumn("pattern", F.explode(F.sequence(F.lit(0), last)))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "pattern", "__place").cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = F.when(F.col("pattern") == 0, 0).otherwise(hashed % 2)
    sign = 1 - 2 * F.when(exact, F.expr("shiftright(pattern, __place) & 1")).otherwise(drawn)
    stats = each.groupBy(*keys, "pattern").agg(F.avg(sign * F.col(value)).alias("stat"))
    return permutation_p(stats.where("pattern = 0"), stats, keys, "stat")


def per_group_beta(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares weight of ``x`` for ``y`` beside one nuisance term, per group, from central moments; null when not determined."""
    c = lambda a, b: F.covar_pop(a, b)
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), c(x, y).alias("__xy"), c(x, z).alias("__xz"), c(y, z).alias("__yz"), F.var_pop(x).alias("__xx"), F.var_pop(z).alias("__zz"))
    span = F.col("__xx") * F.col("__zz") - F.col("__xz") * F.col("__xz")
    known = F.when((F.col("n") > 3) & (span > 1e-12 * F.col("__xx") * F.col("__zz")), span)
    return s.select(*keys, "n", F.try_divide(F.col("__xy") * F.col("__zz") - F.col("__xz") * F.col("__yz"), known).alias("beta"))


def freedman_lane(df: DataFrame, keys: list[str], order: str, x: str, y: str, z: str, n_perm: int, seed: int = 1) -> DataFrame:
    """Partial correlation of ``x`` and ``y`` given ``z`` and its permutation p: residuals of ``y`` on ``z`` are shuffled inside groups
    and put back on the fitted values."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, z).alias("__b"), F.regr_intercept(y, z).alias("__a"))
    rows = df.join(fit, keys).withColumn("__fit", F.col("__a") + F.col("__b") * F.col(z)).withColumn("__e", F.col(y) - F.col("__fit"))
    null = permuted(rows.select(*keys, order, x, z, "__fit", "__e"), keys, order, "__e", n_perm, seed)
    null = partial_one(null.withColumn("__y", F.col("__fit") + F.col("permuted")), [*keys, "perm"], x, "__y", z)
    return permutation_p(partial_one(df, keys, x, y, z), null, keys, "r")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def _centred(df: DataFrame, keys: list[str], x: str, y: str, scale: float) -> DataFrame:
    """Both sides less their median over their scaled median deviation (``__zx``, ``__zy``), and whether both vary (``__ok``)."""
    w = Window.partitionBy(*keys)
    d = _pairs(df, x, y)
    for c, z in ((x, "x"), (y, "y")):
        d = d.withColumn(f"__c{z}", F.col(c) - F.median(c).over(w)).withColumn(f"__d{z}", scale * F.median(F.abs(f"__c{z}")).over(w))
        d = d.withColumn(f"__z{z}", F.try_divide(f"__c{z}", F.nullif(f"__d{z}", F.lit(0.0))))
    return d.withColumn("__ok", (F.col("__dx") > 1e-12) & (F.col("__dy") > 1e-12))


def percentage_bend(df: DataFrame, keys: list[str], x: str, y: str, beta: float = 0.2) -> DataFrame:
    """Correlation of the sides in median deviations, each bent at the ``1 - beta`` quantile of its distances; the rank correlation
    where a median deviation is zero."""
    w = Window.partitionBy(*keys)
    d = _centred(df, keys, x, y, 1.0)
    for c, z in ((x, "x"), (y, "y")):
        limit = F.percentile(F.abs(f"__z{z}"), 1 - beta).over(w)
        d = d.withColumn(f"__b{z}", F.greatest(-limit, F.least(limit, F.col(f"__z{z}")))).withColumn(f"__r{z}", average_rank(c, keys))
    bent = moment_corr(F.when(F.col("__ok"), F.col("__bx")).otherwise(F.col("__rx")), F.when(F.col("__ok"), F.col("__by")).otherwise(F.col("__ry")))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bent.alias("r"))


def shepherd(df: DataFrame, keys: list[str], x: str, y: str, alpha: float = 0.05, least: int = 4) -> DataFrame:
    """Rank correlation of the pairs within the ``1 - alpha`` quantile of the distances from the medians; of all pairs where a
    median deviation is zero or under ``least`` pairs are left."""
    w = Window.partitionBy(*keys)
    d = _centred(df, keys, x, y, 1.4826).withColumn("__far", F.sqrt(F.col("__zx") * F.col("__zx") + F.col("__zy") * F.col("__zy")))
    d = d.withColumn("__in", F.coalesce(F.col("__far") <= F.percentile("__far", 1 - alpha).over(w), F.lit(False)))
    d = d.withColumn("__use", F.when(F.col("__ok") & (F.count_if("__in").over(w) >= least), F.col("__in")).otherwise(True)).where("__use")
    return correlations(d, keys, x, y, "spearman")


def partial_many(df: DataFrame, keys: list[str], x: str, y: str, covariates: list[str]) -> DataFrame:
    """Partial correlation given any number of covariates, with ``n - k - 2`` degrees of freedom and t.

    Pairwise correlations are aggregates; only their small matrix, one row a group, is inverted in numpy. Null where a column is
    constant, the covariates are collinear or no degree of freedom is left.
    """
    cols = [x, y, *covariates]
    size = len(cols)
    places = [(i, j) for i in range(size) for j in range(i + 1, size)]

    @F.pandas_udf("double")
    def invert(flat: pd.Series) -> pd.Series:
        out = np.full(len(flat), np.nan)
        for row, values in enumerate(flat):
            m = np.eye(size)
            for (i, j), v in zip(places, np.array(values, dtype=float), strict=True):
                m[i, j] = m[j, i] = v
            if np.isfinite(m).all() and np.linalg.cond(m[2:, 2:]) < 1e12 and np.linalg.cond(m) < 1e15:
                p = np.linalg.inv(m)
                out[row] = np.clip(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]), -1, 1)
        return pd.Series(out)

    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in cols))
    flat = F.array(*(moment_corr(F.col(cols[i]), F.col(cols[j])) for i, j in places))
    s = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), flat.alias("__flat")).withColumn("dof", F.col("n") - len(covariates) - 2)
    s = s.withColumn("r", F.nanvl(invert("__flat"), F.lit(None).cast("double"))).withColumn("r", F.when(F.col("dof") > 0, F.col("r"))).drop("__flat")
    return s.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("dof"), F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))))


def normal_p(z: Column, terms: int = 200) -> Column:
    """Two-sided p of a normal score, from the all-positive series of the error function; scores over 11 count as 11."""
    x = F.least(F.abs(z) / F.sqrt(F.lit(2.0)), F.lit(8.0))
    start = F.struct(x.alias("s"), x.alias("t"))

    def step(acc, k):
        t = acc["t"] * 2 * x * x / (2 * k + 3)
        return F.struct((acc["s"] + t).alias("s"), t.alias("t"))

    erf = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step, lambda acc: acc["s"]) * 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-x * x)
    return F.when(z.isNotNull(), F.greatest(1 - erf, F.lit(0.0)))


def significant_edges(df: DataFrame, edge: str, value: str, group: str, a: str, b: str, least: int = 3) -> DataFrame:
    """Rank-sum test of every edge between two groups, p of its normal score, and q over all edges; edges with fewer than
    ``least`` values on a side have neither."""
    s = rank_sum(_pairs(df, value, value), [edge], value, group, [(a, b)]).drop("ga", "gb")
    enough = (F.col("na") >= least) & (F.col("nb") >= least)
    tested = s.withColumn("p", F.when(enough, normal_p(F.col("z")))).withColumn("__one", F.lit(1))
    return benjamini_hochberg(tested, "p", ["__one"], [edge]).drop("__one")


def signed_rank(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Wilcoxon's test of paired differences: rank sum of the positive ones, its tie-corrected normal score and two-sided p.
    Differences of zero are left out; a group without others has no row."""
    d = _pairs(df, before, after).withColumn("__d", F.col(after) - F.col(before)).where("__d <> 0").withColumn("__a", F.abs("__d"))
    ranked = d.withColumn("__r", average_rank("__a", keys)).withColumn("__t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__a")))
    s = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__d") > 0, F.col("__r")).otherwise(0.0)).alias("w"), F.sum(F.col("__t") * F.col("__t") - 1).cast("double").alias("__tie"))
    n = F.col("n").cast("double")
    sd = F.sqrt(F.greatest(n * (n + 1) * (2 * n + 1) / 24 - F.col("__tie") / 48, F.lit(0.0)))
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.nullif(sd, F.lit(0.0)))
    return s.withColumn("z", z).withColumn("p", normal_p(F.col("z"))).drop("__tie")
