"""Design matrices, folds, baselines, metrics and intervals for models on trial tables.

What is fitted for each group or feature is written before it meets the rows again: then Spark knows its size, sends few groups to
the rows where they are, and shuffles the rows by group only where groups are many.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .crossval import net_over_folds, product_sums
from .stats import fisher
from .windows import average_rank, moment_corr


def block_folds(df: DataFrame, group: str, block: str, n_folds: int) -> DataFrame:
    """Fold of each row by its block's rank inside the group: blocks stay whole."""
    rank = F.dense_rank().over(Window.partitionBy(group).orderBy(block)) - 1
    return df.withColumn("block_rank", rank).withColumn("fold", F.col("block_rank") % n_folds)


def ordered_folds(df: DataFrame, group: str, block: str) -> DataFrame:
    """Training rows of each later block: all rows of the blocks before it."""
    ranked = df.withColumn("block_rank", F.dense_rank().over(Window.partitionBy(group).orderBy(block)) - 1)
    tests = ranked.select(group, F.col("block_rank").alias("test_block")).distinct().where("test_block > 0")
    return ranked.join(tests, group).where("block_rank < test_block")


def held_out_mean(df: DataFrame, group: str, y: str) -> DataFrame:
    """Training mean of every held-out group: the total less the group's own sums."""
    own = df.groupBy(group).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.crossJoin(F.broadcast(total)).select(group, F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("prediction"))


def feature_intersection(df: DataFrame, group: str, feature: str, value: str, held: Column) -> DataFrame:
    """Features for which every training group has a finite value."""
    train = df.where(~held)
    total = train.agg(F.countDistinct(group).alias("total"))
    return train.where(F.col(value).isNotNull()).groupBy(feature).agg(F.countDistinct(group).alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select(feature, "n")


def deconfound(df: DataFrame, keys: list[str], value: str, covariate: str, train: Column) -> DataFrame:
    """Residual of every row after a line fitted on the training rows of its group."""
    fit = cut(df.where(train).groupBy(*keys).agg(F.regr_slope(value, covariate).alias("b"), F.regr_intercept(value, covariate).alias("a")))
    return df.join(fit, keys, "left").withColumn("residual", F.col(value) - F.col("a") - F.col("b") * F.col(covariate)).drop("a", "b")


def undersample(df: DataFrame, group: list[str], label: str, order: list[str], seed: int = 1) -> DataFrame:
    """As many rows of each class as the rarest class has, by hash order."""
    w = Window.partitionBy(*group, label)
    sizes = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n")).groupBy(*group).agg(F.min("n").alias("least"))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), *order).cast("binary"))
    return df.withColumn("__p", F.row_number().over(w.orderBy(mark, *order))).join(sizes, group).where("__p <= least").drop("__p", "least")


def regression_errors(df: DataFrame, keys: list[str], y: str, prediction: str) -> DataFrame:
    e = F.col(y) - F.col(prediction)
    s = df.groupBy(*keys).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"))
    return s.withColumn("r2", 1 - F.try_divide(F.col("sse"), F.nullif("sst", F.lit(0.0)))).drop("sse", "sst")


def subject_level_r(df: DataFrame, subject: str, y: str, prediction: str) -> DataFrame:
    """Mean Fisher z over subjects and its interval: standard error over subjects, equal weights."""
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col(y), F.col(prediction)).alias("r")).where("n >= 3 AND r IS NOT NULL")
    s = per.agg(F.count(F.lit(1)).alias("n_subjects"), F.avg(fisher(F.col("r"))).alias("z"), (F.stddev_samp(fisher(F.col("r"))) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return s.select("n_subjects", F.tanh("z").alias("r"), F.tanh(F.col("z") - 1.96 * F.col("se")).alias("low"), F.tanh(F.col("z") + 1.96 * F.col("se")).alias("high"))


def classification_metrics(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """AUC by rank sum, balanced accuracy, F1, Brier score and expected calibration error."""
    yes = F.col(y) == 1
    ranked = df.withColumn("__r", average_rank(p, keys))
    hit = F.col(p) >= 0.5
    s = ranked.groupBy(*keys).agg(F.count_if(yes).alias("n1"), F.count_if(~yes).alias("n0"), F.sum(F.when(yes, F.col("__r"))).alias("rs"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & ~hit).alias("tn"), F.count_if(~yes & hit).alias("fp"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))
    auc = F.try_divide(F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0"))
    s = s.withColumn("auc", auc).withColumn("balanced", (F.try_divide("tp", "n1") + F.try_divide("tn", "n0")) / 2).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("n1") - F.col("tp")))
    cell = df.groupBy(*keys, F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"))
    ece = cell.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return s.join(ece, keys).select(*keys, "auc", "balanced", "f1", "brier", "ece")


def split_conformal(df: DataFrame, keys: list[str], y: str, prediction: str, calibration: Column, alpha: float) -> DataFrame:
    """Half-width of the interval: the linear quantile of absolute calibration residuals at ``min(1, ceil((n + 1)(1 - alpha)) / n)``."""
    res = F.abs(F.col(y) - F.col(prediction))
    w = Window.partitionBy(*keys)
    placed = df.where(calibration).select(*keys, res.alias("__r")).where("__r IS NOT NULL")
    placed = placed.withColumn("__k", F.row_number().over(w.orderBy("__r")) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    n = F.col("__n").cast("double")
    at = F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n) * (n - 1)
    pick = lambda k: F.max(F.when(F.col("__k") == k, F.col("__r")))
    s = placed.groupBy(*keys).agg(F.max("__n").cast("int").alias("n"), F.max(at - F.floor(at)).alias("__part"), pick(F.floor(at)).alias("__a"), pick(F.floor(at) + 1).alias("__b"))
    return s.select(*keys, "n", (F.col("__a") + F.col("__part") * (F.coalesce("__b", "__a") - F.col("__a"))).alias("half_width"))


def linear_attribution(df: DataFrame, keys: list[str], coefficients: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean absolute ``coefficient * (value - mean)`` of each feature; null keys are groups too."""
    names = [*keys, feature]
    mean = df.groupBy(*names).agg(F.avg(value).alias("__m")).join(coefficients.select(feature, F.col("coefficient").alias("__c")), feature)
    fit = cut(mean.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(names)), "__m", "__c"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)])
    x = df.join(fit, same).withColumn("__phi", F.col("__c") * (F.col(value) - F.col("__m")))
    return x.groupBy(*names).agg(F.avg(F.abs("__phi")).alias("importance"))


def _net_predictions(df: DataFrame, features: list[str], y: str, train: Column, fold: str, grid: list[tuple[float, float]]) -> DataFrame:
    rows = df.withColumn("__train", train)
    w = net_over_folds(rows.where("__train"), features, y, fold, grid).select("penalty", "mix", F.col("weights").alias("__w"))
    total = F.get("__w", F.lit(0))
    for i, c in enumerate(features):
        total = total + F.get("__w", F.lit(i + 1)) * F.col(c)
    return rows.where("NOT __train").drop("__train").crossJoin(F.broadcast(w)).withColumn("prediction", total).drop("__w")  # one row


def elastic_net(df: DataFrame, features: list[str], y: str, train: Column, reg: float = 0.01, mix: float = 0.5) -> DataFrame:
    """Predictions of an elastic net fitted on the scaled training rows, for the others."""
    rows = df.withColumn("__one", F.lit(0))
    return _net_predictions(rows, features, y, train, "__one", [(reg, mix)]).drop("__one", "penalty", "mix")


def grid_regression(df: DataFrame, features: list[str], y: str, train: Column, fold: str, penalties: list[float], mixes: list[float]) -> DataFrame:
    """Predictions for the rows outside the training ones by the penalty and mix (0 is ridge, 1 is lasso) of a grid with the least
    squared error over the training rows' folds ``fold``, as ``penalty`` and ``mix``; fitted anew on all of them. The rows are read
    once for all folds and grid points, and once for the predictions."""
    return _net_predictions(df, features, y, train, fold, [(p, m) for p in penalties for m in mixes])


def principal_components(df: DataFrame, features: list[str], train: Column, k: int) -> DataFrame:
    """The first ``k`` principal components ``pc1, pc2, ...`` of the scaled features, fitted on the training rows; rows with a null go.

    The fit is one pass of sums of products; features squared numbers reach the driver. A component's largest loading is positive; a
    feature without spread weighs nothing. Without training rows the components are null.
    """
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features))
    n = len(features)
    sums, middle = product_sums(rows.where(train), [], features)
    *flat, count = sums.select(*[f"__g{i}_{j}" for i in range(n + 1) for j in range(i, n + 1)], F.col("__g0_0")).first() or [None]
    if not count:
        return rows.withColumns({f"pc{c + 1}": F.lit(None).cast("double") for c in range(k)})
    products = np.zeros((n + 1, n + 1))
    products[np.triu_indices(n + 1)] = flat
    mean = products[0, 1:] / count
    cov = (np.triu(products[1:, 1:]) + np.triu(products[1:, 1:], 1).T) / count - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0) * count / max(count - 1, 1))
    scale = np.where(spread > 0, spread, np.inf)
    _, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    centre = np.array(middle.first()) + mean
    parts = lambda c: sum((F.lit(float(vectors[i, c] / scale[i])) * (F.col(x) - float(centre[i])) for i, x in enumerate(features)), F.lit(0.0))
    return rows.withColumns({f"pc{c + 1}": parts(c) for c in range(k)})


def best_features(df: DataFrame, feature: str, value: str, y: str, train: Column, percentile: float) -> DataFrame:
    """Long features whose squared correlation with the target over the training rows is above the percentile of all features' that
    leaves ``percentile`` of them; features without one go."""
    r = df.where(train).groupBy(feature).agg(moment_corr(F.col(value), F.col(y)).alias("__r")).select(feature, (F.col("__r") * F.col("__r")).alias("__r2")).where("__r2 IS NOT NULL")
    bar = r.agg(F.percentile("__r2", 1 - percentile / 100).alias("__bar"))
    kept = r.crossJoin(F.broadcast(bar)).where((F.col("__r2") > F.col("__bar")) | F.lit(percentile >= 100))
    return df.join(cut(kept.select(feature)), feature, "left_semi")


def as_array(column: str) -> Column:
    return vector_to_array(column)


def held_out_majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent label of all other groups, for every held-out group; of equal counts the least label."""
    own = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy(label).agg(F.sum("n").alias("tn"))
    every = df.select(group).distinct().crossJoin(total)  # groups times labels
    rest = every.join(own, [group, label], "left").withColumn("rest", F.col("tn") - F.coalesce("n", F.lit(0)))
    order = Window.partitionBy(group).orderBy(F.desc("rest"), label)
    return rest.withColumn("__k", F.row_number().over(order)).where("__k = 1 AND rest > 0").select(group, F.col(label).alias("prediction"), F.col("rest").alias("support"))


def prepared(df: DataFrame, feature: str, value: str, train: Column, least_variance: float = 0.0) -> DataFrame:
    """Long features made ready on the training rows: infinities and NaN become null, features without values or with a training
    variance of at most ``least_variance`` go, null values become the training mean, and all are scaled by it and the spread."""
    x = F.col(value).cast("double")
    clean = df.withColumn("__x", F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
    fit = clean.where(train).groupBy(feature).agg(F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__s")).where((F.col("__s") > 0) & (F.col("__s") * F.col("__s") > least_variance))
    return clean.join(cut(fit), feature).withColumn("prepared", (F.coalesce("__x", "__m") - F.col("__m")) / F.col("__s")).drop("__x", "__m", "__s")


def _dealt_evenly(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows in partitions of about ``most`` each, whatever files or shuffles they come from; costs a count."""
    return df.repartition(max(1, -(-df.count() // most)))


def forest(df: DataFrame, features: list[str], y: str, train: Column, classes: bool = False, trees: int = 50, depth: int = 6, seed: int = 1) -> DataFrame:
    """Predictions of a random forest fitted on the training rows, for all other rows.

    MLlib keeps a partition's rows as one block with their draws for all trees, some 300 bytes a row, which each level reads whole; so
    the training rows are dealt into partitions of a bounded number of rows.
    """
    vectors = VectorAssembler(inputCols=features, outputCol="__features")
    rows = df.withColumn("__train", train)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    learnt = vectors.transform(_dealt_evenly(rows.where("__train").select(*features, y)))
    model = kind(featuresCol="__features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(learnt)
    return model.transform(vectors.transform(rows.where("NOT __train"))).drop("__features", "__train", "rawPrediction", "probability")


def balanced_logistic(df: DataFrame, features: list[str], label: str, train: Column, reg: float = 0.0) -> DataFrame:
    """Probability ``p`` of label 1 for the rows outside the training ones; both classes weigh the same in the fit."""
    rows = VectorAssembler(inputCols=features, outputCol="__features").transform(df.withColumn("__train", train))
    share = rows.where("__train").agg(F.avg(F.col(label).cast("double")).alias("__p"))
    weight = F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("__p"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("__p")))
    fit = rows.where("__train").crossJoin(F.broadcast(share)).withColumn("__w", weight)
    model = LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__w", regParam=reg, maxIter=200, tol=1e-9).fit(fit)
    out = model.transform(rows.where("NOT __train")).withColumn("p", vector_to_array("probability")[1])
    return out.drop("__features", "__train", "rawPrediction", "probability", "prediction")
