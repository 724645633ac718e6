"""Outcome curves of a predictor: polynomials and cubic splines from sums of products, chosen by AIC, whole or cross-fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degree and number of inner knots; knots lie at even quantiles of the predictor.
SPLINES = ((3, 0), (3, 1), (3, 2))


def _knots(curves) -> list[tuple[int, float]]:
    return sorted({(d, k / (n + 1)) for d, n in curves for k in range(1, n + 1)})


def _basis(x: Column, curves) -> list[Column]:
    """Powers of the predictor scaled to 0 ... 1, then the truncated power of each knot."""
    u = F.try_divide(x - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    knot = lambda j: F.try_divide(F.get("__q", F.lit(j)) - F.col("__lo"), F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    powers = [F.pow(u, F.lit(float(p))) for p in range(max(d for d, _ in curves) + 1)]
    return powers + [F.pow(F.greatest(u - knot(j), F.lit(0.0)), F.lit(float(d))) for j, (d, _) in enumerate(_knots(curves))]


def _best(curves, size: int):
    knots, n_powers = _knots(curves), max(d for d, _ in curves) + 1
    used = [[*range(d + 1), *(n_powers + knots.index((d, k / (n + 1))) for k in range(1, n + 1))] for d, n in curves]

    @F.pandas_udf("struct<curve:int,aic:double,weights:array<double>>")
    def best(flat: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        i, j = np.triu_indices(size + 1)
        for values, count in zip(flat, n, strict=True):
            g = np.zeros((size + 1, size + 1))
            g[i, j] = g[j, i] = np.array(values, dtype=float)
            found = (None, None, None)
            for c, terms in enumerate(used):
                if not np.isfinite(g).all() or count <= len(terms):
                    continue
                left = g[np.ix_(terms, terms)]
                w = np.linalg.pinv(left, rcond=1e-13, hermitian=True) @ g[terms, -1]
                rss = max(float(g[-1, -1] - 2 * w @ g[terms, -1] + w @ left @ w), 1e-300)
                aic = count * (np.log(2 * np.pi * rss / count) + 1) + 2 * len(terms)
                if found[1] is None or aic < found[1]:
                    weights = np.zeros(size)
                    weights[terms] = w
                    found = (c, float(aic), weights.tolist())
            out.append(found)
        return pd.DataFrame(out, columns=["curve", "aic", "weights"]).astype({"curve": "Int32"})

    return best


def fit_curves(df: DataFrame, keys: list[str], x: str, y: str, curves=SPLINES, least: int = 10) -> DataFrame:
    """One row for each key: the curve of least AIC (its place in ``curves``) with its weights, and what scales the predictor.

    Rows are aggregated to sums of products, so only a small matrix a key is solved in numpy. Keys with fewer than ``least`` whole
    rows or a constant predictor have no row.
    """
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (x, y)))
    probs = [q for _, q in _knots(curves)] or [0.5]
    scale = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(x).cast("double").alias("__lo"), F.max(x).cast("double").alias("__hi"), F.avg(y).alias("__m"), F.percentile(x, probs).alias("__q")).where((F.col("n") >= least) & (F.col("__hi") > F.col("__lo")))
    terms = [*_basis(F.col(x), curves), F.col(y) - F.col("__m")]
    size = len(terms) - 1
    rows = whole.join(scale, keys).select(*keys, *(t.alias(f"__t{k}") for k, t in enumerate(terms)))
    sums = rows.groupBy(*keys).agg(F.array(*(F.sum(F.col(f"__t{i}") * F.col(f"__t{j}")) for i in range(size + 1) for j in range(i, size + 1))).alias("__flat"))
    fits = scale.join(sums, keys).withColumn("__b", _best(curves, size)("__flat", "n")).drop("__flat")
    return fits.select(*keys, "n", "__lo", "__hi", "__m", "__q", "__b.*").where("weights IS NOT NULL")


def _predicted(rows: DataFrame, fits: DataFrame, keys: list[str], x: str, y: str, curves) -> DataFrame:
    both = rows.join(fits.drop("n"), keys, "left")
    total = F.col("__m")
    for k, term in enumerate(_basis(F.col(x), curves)):
        total = total + F.get("weights", F.lit(k)) * term
    known = F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y)
    out = both.withColumn("predicted", F.when(known, total)).withColumn("residual", F.col(y) - F.col("predicted"))
    return out.drop("__lo", "__hi", "__m", "__q", "weights", "aic")


def curve_residual(df: DataFrame, keys: list[str], x: str, y: str, curves=SPLINES, least: int = 10) -> DataFrame:
    """Every row with ``curve, predicted, residual`` of its key's best curve; null where there is none or a value is missing."""
    return _predicted(df, fit_curves(df, keys, x, y, curves, least), keys, x, y, curves)


def balanced_folds(df: DataFrame, keys: list[str], group: str, n_folds: int) -> DataFrame:
    """``keys, group, fold``: the groups of a key, largest first (of equal ones the least), go each to the fold with the fewest rows.

    Folds are at most the groups. One row a key holds that key's groups, not their rows.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("__n"))
    lists = sizes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(group).alias("g")))).alias("__groups"))
    kind = df.schema[group].dataType.simpleString()
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), F.least(F.lit(n_folds), F.size("__groups"))).alias("sizes"), F.expr(f"cast(array() as array<struct<g:{kind},fold:int>>)").alias("out"))

    def step(acc, item):
        to = (F.array_position(acc["sizes"], F.array_min(acc["sizes"])) - 1).cast("int")
        grown = F.transform(acc["sizes"], lambda v, i: F.when(i == to, v - item["n"]).otherwise(v))
        return F.struct(grown.alias("sizes"), F.concat(acc["out"], F.array(F.struct(item["g"].alias("g"), to.alias("fold")))).alias("out"))

    placed = lists.select(*keys, F.explode(F.aggregate("__groups", start, step, lambda acc: acc["out"])).alias("__p"))
    return placed.select(*keys, F.col("__p.g").alias(group), F.col("__p.fold").alias("fold"))


def crossfit_curve(df: DataFrame, keys: list[str], group: str, x: str, y: str, n_folds: int = 5, curves=SPLINES, least: int = 10) -> DataFrame:
    """Every row with ``fold, curve, predicted, residual``, where the curve comes from the other folds of its key, knots and scale
    included; null where these have fewer than ``least`` whole rows. A row serves the fits of ``n_folds - 1`` folds at most."""
    folds = balanced_folds(df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (x, y))), keys, group, n_folds)
    rows = df.join(folds, [*keys, group], "left")
    held = folds.select(*keys, F.col("fold").alias("__held")).distinct()
    train = rows.select(*keys, "fold", x, y).join(held, keys).where(F.col("fold") != F.col("__held"))
    fits = fit_curves(train, [*keys, "__held"], x, y, curves, least).withColumnRenamed("__held", "fold")
    return _predicted(rows, fits, [*keys, "fold"], x, y, curves)
