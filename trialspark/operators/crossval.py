"""Ridge regression and elastic nets over held-out groups from sums of products: one pass over the rows serves all folds and penalties."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .clusters import components
from .stats import holm, permutation_p, permuted, sign_flip
from .windows import moment_corr


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on the keys; without keys the right side has one row for each fold at most."""
    return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))


def _names(n_features: int) -> list[str]:
    return [f"__g{i}_{j}" for i in range(n_features + 2) for j in range(i, n_features + 2)]


def _matrices(flat: pd.Series, size: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles."""
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    if len(flat):
        out[:, i, j] = np.stack(flat.to_numpy())
        out[:, j, i] = out[:, i, j]
    return out


def _ridge(g: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights (intercept first) of ridge fits on scaled features; a constant feature weighs nothing."""
    n = np.maximum(g[:, 0, 0], 1.0)
    mean = g[:, 0, 1:] / n[:, None]
    cov = g[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.einsum("bii->bi", cov)[:, :-1], 0.0))
    scale = np.where(sd > 1e-12 * (1 + np.abs(mean[:, :-1])), sd, np.inf)
    left = cov[:, :-1, :-1] / scale[:, :, None] / scale[:, None, :]
    step = np.arange(left.shape[1])
    left[:, step, step] += penalty[:, None] / n[:, None] + np.where(np.isinf(scale), 1.0, 1e-12)
    w = np.linalg.solve(left, (cov[:, :-1, -1] / scale)[:, :, None])[:, :, 0] / scale
    return np.concatenate([(mean[:, -1] - (w * mean[:, :-1]).sum(axis=1))[:, None], w], axis=1)


def _shrunk(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


def _descended(cov: np.ndarray, c: np.ndarray, start: np.ndarray, l1: float, l2: float, tol: float = 1e-11, most: int = 20_000) -> np.ndarray:
    """Coordinate descent for a batch of scaled problems from ``start``: sweeps over the active weights, and over all of them
    whenever those are at rest, until such a sweep moves nothing."""
    w, own = start.copy(), np.einsum("bii->bi", cov)
    full = True
    for _ in range(most):
        moved = 0.0
        for j in range(w.shape[1]) if full else np.flatnonzero((w != 0).any(axis=0)):
            rho = c[:, j] - np.einsum("bk,bk->b", cov[:, j], w) + own[:, j] * w[:, j]
            new = np.where(own[:, j] > 0, _shrunk(rho, l1) / np.where(own[:, j] > 0, own[:, j] + l2, 1.0), 0.0)
            moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if moved <= tol * (1 + float(np.abs(w).max(initial=0.0))):
            if full:
                break
            full = True
        else:
            full = False
    return w


def _net(g: np.ndarray, grid: list[tuple[float, float]]) -> np.ndarray:
    """Weights (intercept first) of elastic nets on scaled features for each ``(penalty, mix)``: the least of
    squares / 2n + penalty (mix |w| + (1 - mix) w^2 / 2). A mix's penalties are a path from the largest, each started from the last."""
    n = np.maximum(g[:, 0, 0], 1.0)
    mean = g[:, 0, 1:] / n[:, None]
    cov = g[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    sd = np.sqrt(np.maximum(np.einsum("bii->bi", cov)[:, :-1], 0.0))
    scale = np.where(sd > 1e-12 * (1 + np.abs(mean[:, :-1])), sd, np.inf)
    left, right = cov[:, :-1, :-1] / scale[:, :, None] / scale[:, None, :], cov[:, :-1, -1] / scale
    out = np.zeros((len(g), len(grid), left.shape[1] + 1))
    for mix in dict.fromkeys(m for _, m in grid):
        w = np.zeros_like(right)
        for place in sorted((k for k, (_, m) in enumerate(grid) if m == mix), key=lambda k: -grid[k][0]):
            penalty = grid[place][0]
            w = _descended(left, right, w, penalty * mix, penalty * (1 - mix))
            out[:, place, 1:] = w / scale
    out[:, :, 0] = mean[:, -1:] - np.einsum("bpk,bk->bp", out[:, :, 1:], mean[:, :-1])
    return out


def _ridges(g: np.ndarray, grid: list[tuple[float, float]]) -> np.ndarray:
    return np.stack([_ridge(g, np.full(len(g), p)) for p, _ in grid], axis=1)


def _fit(n_features: int, grid: list[tuple[float, float]], solve: Callable):
    @F.pandas_udf("array<double>")
    def fit(flat: pd.Series, place: pd.Series) -> pd.Series:
        every = solve(_matrices(flat, n_features + 2), grid)
        return pd.Series(list(every[np.arange(len(flat)), place.to_numpy(dtype=int)]), index=flat.index, dtype=object)

    return fit


def _errors(n_features: int, grid: list[tuple[float, float]], solve: Callable):
    @F.pandas_udf("array<double>")
    def errors(train: pd.Series, valid: pd.Series) -> pd.Series:
        t, v = _matrices(train, n_features + 2), _matrices(valid, n_features + 2)
        off = solve(t, grid)
        off = np.concatenate([off, np.full((*off.shape[:2], 1), -1.0)], axis=2)
        return pd.Series(list(np.einsum("bpi,bij,bpj->bp", off, v, off)), index=train.index, dtype=object)

    return errors


def _usable(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))


def product_sums(df: DataFrame, by: list[str], cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sums of products of 1 and the columns less their overall means, by the keys, as ``__g<i>_<j>``; and those means."""
    middle = df.agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)))
    z = [F.lit(1.0), *(F.col(c) - F.col(f"__m{i}") for i, c in enumerate(cols))]
    rows = df.crossJoin(F.broadcast(middle))  # one row
    return rows.groupBy(*by).agg(*(F.sum(z[i] * z[j]).alias(f"__g{i}_{j}") for i in range(len(z)) for j in range(i, len(z)))), middle


def _as_array(d: DataFrame, names: list[str], name: str) -> DataFrame:
    return d.withColumn(name, F.array(*names)).drop(*names)


def _less(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def _in_units(w: DataFrame, middle: DataFrame, k: int) -> DataFrame:
    """``weights`` for the columns as given from ``__w`` for deviations from the means."""
    slopes = [F.get("__w", F.lit(i + 1)) for i in range(k)]
    start = F.get("__w", F.lit(0)) + F.col(f"__m{k}")
    for i, b in enumerate(slopes):
        start = start - b * F.col(f"__m{i}")
    return w.crossJoin(F.broadcast(middle)).withColumn("weights", F.array(start, *slopes))


def _nested(df: DataFrame, keys: list[str], group: str, features: list[str], y: str, grid: list[tuple[float, float]], inner: Column | None, solve: Callable) -> DataFrame:
    """``keys, group, __place, weights``: refits on all other groups of the same keys with the grid's place of least inner error."""
    if len(grid) > 1 and inner is None:
        raise ValueError("a grid of penalties needs inner folds")
    k, cols = len(features), [*features, y]
    flat = _names(k)
    own, middle = product_sums(_usable(df, cols).withColumn("__fold", F.lit(0) if inner is None else inner), [*keys, group, "__fold"], cols)
    total = _as_array(own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in flat)), flat, "__all")
    rest = _beside(_as_array(own, flat, "__own"), total, keys).withColumn("__rest", _less("__all", "__own")).where(F.get("__rest", F.lit(0)) > 0.5)
    if len(grid) == 1:
        chosen = rest.withColumn("__place", F.lit(0))
    else:
        folds = _as_array(own.withColumnRenamed("__fold", "__f").groupBy(*keys, "__f").agg(*(F.sum(c).alias(c) for c in flat)), flat, "__valid")
        pairs = _beside(rest, folds, keys).withColumn("__valid", F.when(F.col("__f").eqNullSafe(F.col("__fold")), _less("__valid", "__own")).otherwise(F.col("__valid")))
        pairs = pairs.withColumn("__train", _less("__rest", "__valid")).where((F.get("__valid", F.lit(0)) > 0.5) & (F.get("__train", F.lit(0)) > 0.5))
        scored = pairs.select(*keys, group, F.posexplode(_errors(k, grid, solve)("__train", "__valid")).alias("__p", "__sse"))
        best = scored.groupBy(*keys, group, "__p").agg(F.sum("__sse").alias("__sse")).groupBy(*keys, group).agg(F.min_by("__p", F.struct("__sse", "__p")).alias("__place"))
        chosen = rest.join(best, [*keys, group])
    return _in_units(chosen.withColumn("__w", _fit(k, grid, solve)("__rest", "__place")), middle, k)


def nested_ridge(df: DataFrame, keys: list[str], group: str, features: list[str], y: str, penalties: list[float], inner: Column | None = None) -> DataFrame:
    """Weights of a ridge regression for every held-out group: ``keys, group, penalty, weights`` (intercept first), refitted on
    all other groups of the same keys.

    ``inner`` numbers the inner folds by group; of several penalties the one with the least squared error over the inner folds
    of the other groups is taken, of equal ones the first. All sums are the total less the group's own, about overall means.
    Rows with a null feature or target are left out; a group without any other has no row.
    """
    w = _nested(df, keys, group, features, y, [(float(p), 0.0) for p in penalties], inner, _ridges)
    return w.select(*keys, group, F.get(F.array(*(F.lit(float(p)) for p in penalties)), F.col("__place")).alias("penalty"), "weights")


def nested_net(df: DataFrame, keys: list[str], group: str, features: list[str], y: str, grid: list[tuple[float, float]], inner: Column | None = None) -> DataFrame:
    """``nested_ridge`` for elastic nets: ``keys, group, penalty, mix, weights``, chosen from a grid of ``(penalty, mix)``.

    A mix of 0 is ridge, 1 is lasso; the objective is that of ``_net``. Coordinate descent runs on the sums of products, so all
    folds, penalties and mixes come from one pass over the rows.
    """
    grid = [(float(p), float(m)) for p, m in grid]
    w = _nested(df, keys, group, features, y, grid, inner, _net)
    pick = lambda k: F.get(F.array(*(F.lit(g[k]) for g in grid)), F.col("__place"))
    return w.select(*keys, group, pick(0).alias("penalty"), pick(1).alias("mix"), "weights")


def net_over_folds(df: DataFrame, features: list[str], y: str, fold: str, grid: list[tuple[float, float]]) -> DataFrame:
    """``penalty, mix, weights``: the elastic net of a grid with the least squared error over the folds, fitted anew on all rows.

    One row, from one pass. Folds may be of any type and have gaps; a null fold is one more fold. With one grid point, or one
    fold, the first point is taken.
    """
    k, cols, grid = len(features), [*features, y], [(float(p), float(m)) for p, m in grid]
    flat = _names(k)
    own, middle = product_sums(_usable(df, cols).withColumn("__fold", F.col(fold)), ["__fold"], cols)
    total = _as_array(own.agg(*(F.sum(c).alias(c) for c in flat)), flat, "__all").where(F.get("__all", F.lit(0)) > 0)
    pairs = _as_array(own, flat, "__valid").crossJoin(F.broadcast(total)).withColumn("__train", _less("__all", "__valid")).where(F.get("__train", F.lit(0)) > 0.5)
    scored = pairs.select(F.posexplode(_errors(k, grid, _net)("__train", "__valid")).alias("__p", "__sse")).groupBy("__p").agg(F.sum("__sse").alias("__sse"))
    best = scored.agg(F.coalesce(F.min_by("__p", F.struct("__sse", "__p")), F.lit(0)).alias("__place"))
    w = total.crossJoin(F.broadcast(best)).withColumn("__w", _fit(k, grid, _net)("__all", "__place"))
    pick = lambda j: F.get(F.array(*(F.lit(g[j]) for g in grid)), F.col("__place"))
    return _in_units(w, middle, k).select(pick(0).alias("penalty"), pick(1).alias("mix"), "weights")


def predicted(df: DataFrame, weights: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Rows with the prediction of their keys' weights; rows without weights or with a null feature predict nothing (null)."""
    total = F.get("__w", F.lit(0))
    for i, c in enumerate(features):
        total = total + F.get("__w", F.lit(i + 1)) * F.col(c)
    named = weights.select(*keys, F.col("weights").alias("__w"))
    return df.join(named, keys, "left").withColumn("prediction", total).drop("__w")


def label_permutation(df: DataFrame, group: str, blocks: list[str], order: str, features: list[str], y: str, penalty: float, n_perm: int, fit: Callable[[DataFrame, list[str], str], DataFrame] | None = None) -> DataFrame:
    """Permutation p of the pooled correlation of held-out predictions: labels are shuffled inside the blocks and the model refitted.

    ``fit(rows, keys, y)`` gives ``keys, group, weights`` of any linear model, such as ``nested_net`` with its grid; without it
    the model is the ridge regression of ``penalty``.

    Where no slope survives the penalty, shuffles inside the held-out groups leave every prediction as it is, so that all draws tie
    with the observed r. The predictions then differ by a millionth of their mean or less, and the ties hold only as the
    correlation is taken about the mean label.
    """
    fit = fit or (lambda rows, keys, target: nested_ridge(rows, keys, group, features, target, [penalty]))

    def pooled(rows: DataFrame, keys: list[str]) -> DataFrame:
        guessed = predicted(rows, fit(rows, keys, "__y"), [*keys, group], features).crossJoin(F.broadcast(middle))  # one row
        return guessed.groupBy(*keys).agg(moment_corr(F.col("__y"), F.col("prediction"), F.col("__middle")).alias("r"))

    base = df.select(*dict.fromkeys([group, *blocks, order, *features]), F.col(y).alias("__y"))
    middle = _usable(base, [*features, "__y"]).agg(F.avg("__y").alias("__middle"))
    null = permuted(base, blocks, order, "__y", n_perm).withColumn("__y", F.col("permuted"))
    whole = F.lit(1).alias("__one")
    both = permutation_p(pooled(base, []).select(whole, "r"), pooled(null, ["perm"]).select(whole, "r"), ["__one"], "r")
    return both.drop("__one")


def fold_scores(df: DataFrame, group: str, y: str, prediction: str, model: str, metric: str = "mse") -> DataFrame:
    """``group, model, <metric>`` of one model on the shared held-out groups: ``mse``, ``mae``, ``r2`` or ``r`` (null where undefined)."""
    e = F.col(y) - F.col(prediction)
    measures = {"mse": F.avg(e * e), "mae": F.avg(F.abs(e)), "r2": 1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))), "r": moment_corr(F.col(y), F.col(prediction))}
    return df.groupBy(group).agg(measures[metric].alias(metric)).select(group, F.lit(model).alias("model"), metric)


def compare_models(scores: DataFrame, group: str, pairs: list[tuple[str, str]], metric: str = "mse") -> DataFrame:
    """Mean difference of a metric of each pair of models over shared folds, its sign-flip p and the Holm p over pairs."""
    a = scores.select(group, F.col("model").alias("ma"), F.col(metric).alias("__a"))
    b = scores.select(group, F.col("model").alias("mb"), F.col(metric).alias("__b"))
    wanted = scores.sparkSession.createDataFrame(pairs, "ma string, mb string")
    d = a.join(F.broadcast(wanted), "ma").join(b, [group, "mb"]).select(group, "ma", "mb", (F.col("__a") - F.col("__b")).alias("__d")).where("__d IS NOT NULL")
    tested = sign_flip(d, ["ma", "mb"], group, "__d").withColumn("__one", F.lit(1))
    return holm(tested, "p", ["__one"], ["ma", "mb"]).drop("__one").withColumnRenamed("observed", "difference")


def incremental_r2(df: DataFrame, group: str, y: str, base: str, full: str) -> DataFrame:
    """R squared of two predictions in each held-out group and what the fuller one adds; null where the target is constant."""
    side = lambda p: 1 - F.try_divide(F.sum(F.pow(F.col(y) - F.col(p), F.lit(2.0))), F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0)))
    return df.groupBy(group).agg(side(base).alias("r2_base"), side(full).alias("r2_full")).withColumn("delta", F.col("r2_full") - F.col("r2_base"))


def permutation_importance(df: DataFrame, weights: DataFrame, group: str, order: str, features: list[str], y: str, n_perm: int) -> DataFrame:
    """By held-out group and feature: mean rise of the squared error when the feature is shuffled inside the group."""
    scored = predicted(df, weights, [group], features).where(F.col("prediction").isNotNull() & F.col(y).isNotNull())
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(i + 1).alias("place")) for i, c in enumerate(features))))
    long = scored.withColumn("__f", named).select(group, order, "prediction", F.col(y).alias("__y"), "__f.*")
    mixed = permuted(long.withColumnRenamed("place", "__at"), [group, "feature"], order, "value", n_perm)
    w = mixed.join(weights.select(group, "weights"), group)
    moved = F.col("prediction") + F.get("weights", F.col("__at")) * (F.col("permuted") - F.col("value"))
    old, new = F.col("__y") - F.col("prediction"), F.col("__y") - moved
    return w.groupBy(group, "feature").agg(F.avg(new * new - old * old).alias("importance"))


def time_generalisation(df: DataFrame, keys: list[str], group: str, window: str, features: list[str], y: str, penalty: float) -> DataFrame:
    """Weights fitted at each window on all other groups, applied to every window of the held-out group: ``train, test`` and
    the mean over groups of the Fisher z of prediction and target, turned back."""
    w = nested_ridge(df, [*keys, window], group, features, y, [penalty]).withColumnRenamed(window, "train")
    rows = df.withColumnRenamed(window, "test").join(w.select(*keys, group, "train", F.col("weights").alias("__w")), [*keys, group])
    total = F.get("__w", F.lit(0))
    for i, c in enumerate(features):
        total = total + F.get("__w", F.lit(i + 1)) * F.col(c)
    per = rows.withColumn("__p", total).groupBy(*keys, group, "train", "test").agg(moment_corr(F.col("__p"), F.col(y)).alias("r"))
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r"))))
    return per.where("r IS NOT NULL").groupBy(*keys, "train", "test").agg(F.count(F.lit(1)).alias("n"), F.tanh(F.avg(z)).alias("r"))


def generalisation_significance(observed: DataFrame, null: DataFrame) -> DataFrame:
    """p of each cell against its own null values, q over all cells and whether |r| reaches the 95th percentile of the largest
    null |r| of each permutation."""
    from .stats import benjamini_hochberg

    p = permutation_p(observed, null, ["train", "test"], "r").withColumn("__one", F.lit(1))
    top = null.groupBy("perm").agg(F.max(F.abs("r")).alias("m")).agg(F.percentile("m", 0.95).alias("__top"))
    q = benjamini_hochberg(p, "p", ["__one"], ["train", "test"]).crossJoin(F.broadcast(top))
    return q.withColumn("max_stat", F.abs("observed") >= F.col("__top")).drop("__one", "__top")


def generalisation_clusters(observed: DataFrame, null: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Clusters of cells whose |r| reaches the ``1 - alpha`` percentile of all null |r|, with ``n`` cells each and whether that reaches
    the 95th percentile of the largest null clusters; a permutation without any counts as 0. Axes ``train`` and ``test`` are
    whole numbers; only cells that the observed map has are tested, signs are not told apart."""
    observed, null = cut(observed), cut(null)
    tested = observed.where(F.col("r").isNotNull() & ~F.isnan("r"))
    seen = null.where(F.col("r").isNotNull() & ~F.isnan("r")).join(tested.select("train", "test"), ["train", "test"], "left_semi")
    bar = F.broadcast(seen.agg(F.percentile(F.abs("r"), 1 - alpha).alias("__bar")))  # one row
    over = lambda t: t.crossJoin(bar).where(F.abs("r") >= F.col("__bar")).drop("__bar")
    sizes = lambda t, keys: components(over(t), keys, ["train", "test"], ["r"]).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes(seen, ["perm"]).groupBy("perm").agg(F.max("n").alias("__m"))
    every = null.select("perm").distinct().join(largest, "perm", "left").agg(F.percentile(F.coalesce("__m", F.lit(0)), 0.95).alias("__top"))
    return sizes(tested, []).crossJoin(F.broadcast(every)).select("label", "n", (F.col("n") >= F.col("__top")).alias("significant"))
