"""Balanced logistic regression over held-out groups: every fold's and penalty's fit takes its Newton steps together.

A pass reads the rows once and sums, for each fit that is not yet at rest, the gradient, the curvature and the likelihood of the rows
that are not held out from it; tasks send one row of sums a fit. Steps are solved as a batch on the driver, which holds one small
vector for each fit: groups x (1 + inner folds) x penalties. Passes go on until no fit moves.

Where the rows have few distinct (label, features), every fit needs only how often each of them occurs: the total less the group's
own. Then the driver holds that short table, groups spread over tasks, and the work grows with the groups instead of groups x rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .crossval import predicted

#: Rows times fits worked on at once in a task.
CELLS = 1 << 21
#: Distinct (label, features) up to which fits work on counts; more of them are fitted over the rows.
MOST_DISTINCT = 4096


@dataclass
class _Fits:
    """Held-out group and fold (-1: none) of each fit, its inverse penalty, and the weight of each class."""

    group: np.ndarray
    fold: np.ndarray
    strength: np.ndarray
    classes: np.ndarray

    def some(self, at: np.ndarray) -> _Fits:
        return _Fits(self.group[at], self.fold[at], self.strength[at], self.classes[at])


def _over_rows(rows: DataFrame, names: list[str], work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], n_fits: int) -> np.ndarray:
    """Sums over all rows of ``work(group, fold, y, x)``, a row of numbers a fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_fits, len(names)))
        for batch in batches:
            group, fold, y = (batch.column(c).to_numpy() for c in ("__g", "__f", "__y"))
            x = batch.column("__x").flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 0))
            step = max(1, CELLS // max(1, n_fits))
            for a in range(0, len(y), step):
                part = slice(a, a + step)
                total += work(group[part], fold[part], y[part], x[part])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_fits)), *(pa.array(c) for c in total.T)], names=["fit", *names])

    sums = rows.mapInArrow(run, ", ".join(["fit long", *(f"{n} double" for n in names)])).groupBy("fit").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((n_fits, len(names)))
    for r in sums.collect():  # one row a fit
        out[r[0]] = r[1:]
    return out


def _trained(fits: _Fits, group: np.ndarray, fold: np.ndarray) -> np.ndarray:
    return (group[:, None] != fits.group) & ((fits.fold < 0) | (fold[:, None] != fits.fold))


def _sums(own: np.ndarray, y: np.ndarray, one: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """A row for each fit: likelihood, gradient and upper triangle of the curvature of rows that weigh ``own`` (rows x fits)."""
    i, j = np.triu_indices(one.shape[1])
    eta = one @ beta.T
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    likelihood = -(own * np.logaddexp(0, np.where(y[:, None] > 0, -eta, eta))).sum(0)
    return np.column_stack([likelihood, (own * (y[:, None] - p)).T @ one, (own * p * (1 - p)).T @ (one[:, i] * one[:, j])])


def _unpacked(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(k)
    curve = np.zeros((len(sums), k, k))
    curve[:, i, j] = curve[:, j, i] = sums[:, 1 + k :]
    return sums[:, 0], sums[:, 1 : 1 + k], curve


def _pass(rows: DataFrame, fits: _Fits, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted log likelihood, its gradient and the matrix of its curvature for each fit at its ``beta`` (intercept first)."""
    k = beta.shape[1]

    def work(group: np.ndarray, fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        own = np.where(y[:, None] > 0, fits.classes[:, 1], fits.classes[:, 0]) * _trained(fits, group, fold)
        return _sums(own, y, np.column_stack([np.ones(len(y)), x]), beta)

    names = ["l", *(f"g{a}" for a in range(k)), *(f"h{a}" for a in range(k * (k + 1) // 2))]
    return _unpacked(_over_rows(rows, names, work, len(beta)), k)


def _newton(passed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], strength: np.ndarray, spread: np.ndarray, tol: float, most: int) -> np.ndarray:
    """The weights of every fit: the most of strength x likelihood - sum (spread x weight)^2 / 2, the intercept free.

    ``passed`` gives likelihood, gradient and curvature of some fits (their places) at the weights tried. A step that does not raise the objective is halved.
    """
    n, k = spread.shape
    ridge = np.column_stack([np.zeros(n), np.where(spread > 0, spread**2, 1e30)])
    beta, step, best = np.zeros((n, k + 1)), np.zeros((n, k + 1)), np.full(n, -np.inf)
    moving = np.arange(n)
    for _ in range(most):
        if not len(moving):
            break
        tried = beta[moving] + step[moving]
        likelihood, slope, curve = passed(moving, tried)
        c, r = strength[moving], ridge[moving]
        objective = c * likelihood - (r * tried * tried).sum(1) / 2
        better = objective >= best[moving] - 1e-12 * np.abs(objective)
        step[moving[~better]] /= 2
        at = moving[better]
        beta[at], best[at] = tried[better], objective[better]
        pull = c[:, None] * slope - r * tried
        push = c[:, None, None] * curve + np.eye(k + 1) * (r + 1e-12)[:, None, :]
        step[at] = np.linalg.solve(push[better], pull[better][:, :, None])[:, :, 0]
        size = np.abs(step * np.column_stack([np.ones(n), spread])).max(axis=1)
        moving = moving[size[moving] > tol]
    return beta


def _inner_scores(rows: DataFrame, fits: _Fits, beta: np.ndarray, scoring: str) -> np.ndarray:
    """Score of each fit on the rows of its own fold that are not of its held-out group; higher is better, NaN without rows."""

    def work(group: np.ndarray, fold: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        eta = np.column_stack([np.ones(len(y)), x]) @ beta.T
        held = (group[:, None] != fits.group) & (fold[:, None] == fits.fold)
        ones, zeros = held & (y[:, None] > 0), held & (y[:, None] <= 0)
        loss = np.logaddexp(0, np.where(y[:, None] > 0, -eta, eta))
        return np.column_stack([ones.sum(0), (ones & (eta > 0)).sum(0), zeros.sum(0), (zeros & (eta <= 0)).sum(0), (held * loss).sum(0)])

    return _scores(_over_rows(rows, ["a", "b", "c", "d", "e"], work, len(beta)), scoring)


def _scores(sums: np.ndarray, scoring: str) -> np.ndarray:
    n1, right1, n0, right0, loss = sums.T
    with np.errstate(invalid="ignore", divide="ignore"):
        if scoring == "log_loss":
            return -loss / (n1 + n0)
        return np.nanmean(np.where([n1 > 0, n0 > 0], [right1 / n1, right0 / n0], np.nan), axis=0)


def _best(scores: np.ndarray) -> int:
    """Place of the first best mean score; ``scores``: strengths x folds, NaN where a fold has none."""
    return int(np.argmax([np.nanmean(s) if np.isfinite(s).any() else -np.inf for s in scores]))


def _by_counts(rows: DataFrame, schema: str, k: int, strengths: list[float], shift: np.ndarray, scoring: str, tol: float, most: int) -> DataFrame | None:
    """The weights from counts of equal rows, a group's fits in one task; nothing where there are too many distinct rows."""
    spark = rows.sparkSession
    seen = rows.groupBy("__y", "__x").count().limit(MOST_DISTINCT + 1).collect()
    if not 0 < len(seen) <= MOST_DISTINCT:
        return None
    y, one = np.array([r["__y"] for r in seen]), np.array([[1.0, *r["__x"]] for r in seen])
    numbered = spark.createDataFrame([(r["__y"], r["__x"], j) for j, r in enumerate(seen)], "__y double, __x array<double>, __j int")
    folds = sorted(r[0] for r in rows.select("__f").distinct().collect())
    named = spark.createDataFrame(list(zip(folds, range(len(folds)), strict=True)), "__f int, __k int")
    counts = rows.join(F.broadcast(numbered), ["__y", "__x"]).join(F.broadcast(named), "__f").groupBy("__group", "__k", "__j").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    total = np.zeros((len(folds), len(seen)))
    for r in counts.groupBy("__k", "__j").agg(F.sum("n")).collect():  # at most folds x distinct rows
        total[r[0], r[1]] = r[2]
    plans = [(f, c) for f in ([-1, *range(len(folds))] if len(strengths) > 1 else [-1]) for c in strengths]
    scale = np.where(shift[:, 1] > 0, shift[:, 1], 1.0)
    ones = y > 0

    def fitted(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each group whether it has weights, the place of its strength, and the weights."""
        others = total - own
        whole = others.sum(1)
        fit = np.concatenate([(whole if f < 0 else whole - others[:, f])[:, None] for f, _ in plans], axis=1).reshape(-1, len(y))
        n, n1 = fit.sum(1), fit[:, ones].sum(1)
        able = (n1 > 0) & (n1 < n)
        strength, beta = np.tile([c for _, c in plans], len(own)), np.zeros((len(fit), k + 1))
        at = np.flatnonzero(able)
        n, n1, part = n[at], n1[at], fit[at]
        mean = part @ one[:, 1:] / n[:, None]
        spread = np.sqrt(np.maximum(part @ one[:, 1:] ** 2 / n[:, None] - mean**2, 0))
        spread[spread < 1e-9] = 0
        weighed = part * np.where(ones, (n / (2 * n1))[:, None], (n / (2 * (n - n1)))[:, None])
        beta[at] = _newton(lambda some, tried: _unpacked(_sums(weighed[some].T, y, one, tried), k + 1), strength[at], spread, tol, most)
        able, beta = able.reshape(len(own), -1, len(strengths)), beta.reshape(len(own), -1, len(strengths), k + 1)
        best = np.zeros(len(own), dtype=int)
        if len(strengths) > 1:
            eta = beta[:, 1:] @ one.T
            held, loss = others[:, :, None], np.logaddexp(0, np.where(ones, -eta, eta))
            sums = [held[..., ones].sum(-1) + 0 * eta[..., 0], (held * (ones & (eta > 0))).sum(-1), held[..., ~ones].sum(-1) + 0 * eta[..., 0], (held * (~ones & (eta <= 0))).sum(-1), (held * loss).sum(-1)]
            score = _scores(np.stack(sums, axis=-1).reshape(-1, 5), scoring).reshape(able[:, 1:].shape)
            best = np.array([_best(s.T) for s in np.where(able[:, 1:], score, np.nan)], dtype=int)
        return able[:, 0, 0], best, beta[np.arange(len(own)), 0, best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (len(plans) * len(y)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                listed = part.column("__own")
                row, flat = np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy()), listed.flatten()
                own = np.zeros((len(listed), len(folds), len(y)))
                own[row, flat.field("k").to_numpy(), flat.field("j").to_numpy()] = flat.field("n").to_numpy()
                known, best, w = fitted(own)
                w[:, 1:] /= scale
                w[:, 0] -= w[:, 1:] @ shift[:, 0]
                made = [part.column("__group"), pa.array(np.array(strengths, dtype=float)[best]), pa.array(list(w), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(made, names=names).filter(pa.array(known))

    names = [f.name for f in spark.createDataFrame([], schema).schema]
    listed = counts.groupBy("__group").agg(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__j").alias("j"), "n")).alias("__own"))
    # as many tasks as shuffles have: a group is a short row, but a long fit
    return cut(listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__group").mapInArrow(run, schema))


def nested_logistic(df: DataFrame, group: str, features: list[str], label: str, strengths: list[float], inner: Column | None = None, *, scoring: str = "balanced_accuracy", tol: float = 1e-9, most: int = 100) -> DataFrame:
    """Weights of a balanced logistic regression for every held-out group: ``group, strength, weights`` (intercept first).

    Minimises ``strength`` x the class-weighted loss + half the squared weights of the features scaled by their training spread;
    a class weighs n / (2 x its rows) over the training rows. ``inner`` numbers the inner folds (whole numbers from 0); of several
    strengths the one with the best mean score over the inner folds of the other groups is taken, of equal ones the first.
    ``scoring`` is ``balanced_accuracy`` or ``log_loss``. Rows with a null feature, label, group or fold are left out. A group whose others have one class only has no row;
    an inner fold with one class in training is not scored. A feature that is constant in training weighs nothing.
    """
    if len(strengths) > 1 and inner is None:
        raise ValueError("a grid of strengths needs inner folds")
    if scoring not in ("balanced_accuracy", "log_loss"):
        raise ValueError(scoring)
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in [*features, label])).where(F.col(group).isNotNull())
    middle = ok.agg(*(f(c).alias(f"__{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = [F.try_divide(F.col(c) - F.col(f"__m{i}"), F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0)) for i, c in enumerate(features)]
    rows = ok.crossJoin(F.broadcast(middle)).select(F.col(group).alias("__group"), (F.lit(0) if inner is None else inner).cast("int").alias("__f"), F.col(label).cast("double").alias("__y"), F.array(*scaled).alias("__x")).where("__f IS NOT NULL")
    rows = cut(rows)
    shift = np.array([np.nan if v is None else v for v in middle.first()]).reshape(len(features), 2)
    kind = rows.schema["__group"].dataType.simpleString()
    schema = f"`{group}` {kind}, strength double, weights array<double>"
    if (weights := _by_counts(rows, schema, len(features), strengths, shift, scoring, tol, most)) is not None:
        return weights
    sums = [F.sum(F.get("__x", F.lit(i))).alias(f"s{i}") for i in range(len(features))] + [F.sum(F.get("__x", F.lit(i)) * F.get("__x", F.lit(i))).alias(f"q{i}") for i in range(len(features))]
    own = rows.groupBy("__group", "__f").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y") > 0).alias("n1"), *sums).collect()  # a row for each group and fold
    names = sorted({r["__group"] for r in own})
    place = {g: k for k, g in enumerate(names)}
    folds = sorted({r["__f"] for r in own})
    table = np.zeros((len(names), len(folds), 2 + 2 * len(features)))
    for r in own:
        table[place[r["__group"]], folds.index(r["__f"])] = r[2:]
    numbered = df.sparkSession.createDataFrame(list(place.items()), f"__group {kind}, __g long")
    rows = cut(rows.join(numbered, "__group").select("__g", "__f", "__y", "__x"))

    plans = [(g, f, c) for g in range(len(names)) for f in ([-1, *folds] if len(strengths) > 1 else [-1]) for c in strengths]
    whole = table.sum(axis=(0, 1))
    train = np.array([whole - table[g].sum(0) - (0 if f < 0 else table[:, folds.index(f)].sum(0) - table[g, folds.index(f)]) for g, f, _ in plans]).reshape(len(plans), table.shape[2])
    n, n1 = train[:, :1], train[:, 1:2]
    able = ((n1 > 0) & (n1 < n))[:, 0]
    if not able.any():
        return df.sparkSession.createDataFrame([], schema)
    k = len(features)
    n, n1, train, plans = n[able], n1[able], train[able], [p for p, a in zip(plans, able, strict=True) if a]
    mean = train[:, 2 : 2 + k] / n
    spread = np.sqrt(np.maximum(train[:, 2 + k :] / n - mean**2, 0))
    spread[spread < 1e-9] = 0
    g, f, c = (np.array(v) for v in zip(*plans, strict=True))
    fits = _Fits(g, f, c.astype(float), np.column_stack([n / (2 * (n - n1)), n / (2 * n1)]))
    beta = _newton(lambda at, tried: _pass(rows, fits.some(at), tried), fits.strength, spread, tol, most)
    chosen = {int(h): float(strengths[0]) for h in g[f < 0]}
    if len(strengths) > 1:
        at = np.flatnonzero(f >= 0)
        scores = _inner_scores(rows, fits.some(at), beta[at], scoring) if len(at) else np.zeros(0)
        for h in chosen:
            means = [np.nanmean(s) if len(s := scores[(g[at] == h) & (c[at] == x)]) and np.isfinite(s).any() else -np.inf for x in strengths]
            chosen[h] = float(strengths[int(np.argmax(means))])
    scale = np.where(shift[:, 1] > 0, shift[:, 1], 1.0)
    out = []
    for h, x in chosen.items():
        w = beta[(g == h) & (f < 0) & (c == x)][0]
        slopes = w[1:] / scale
        out.append((names[h], x, [float(w[0] - slopes @ shift[:, 0]), *slopes.tolist()]))
    return df.sparkSession.createDataFrame(out, schema)


def probabilities(df: DataFrame, weights: DataFrame, group: str, features: list[str], name: str = "p") -> DataFrame:
    """Rows with the probability of label 1 by their group's weights; null without weights or with a null feature."""
    return predicted(df, weights, [group], features).withColumn(name, 1 / (1 + F.exp(-F.col("prediction")))).drop("prediction")
