"""Further features, statistics, clusters and evaluations, built on the other operator modules."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .stats import bootstrap_draws
from .windows import islands, moment_corr


def phase_slope(analytic: DataFrame, keys: list[str], freq: str, a: int, b: int) -> DataFrame:
    """Phase slope index: imaginary part of conj(C(f)) C(f + 1) summed over neighbouring frequencies."""
    side = lambda c, k: F.max(F.when(F.col("channel") == c, F.col(k)))
    p = analytic.where(F.col("channel").isin(a, b)).groupBy(*keys, freq).agg(*(side(c, k).alias(f"{k}{i}") for i, c in enumerate((a, b)) for k in ("re", "im")))
    mag = F.sqrt((F.col("re0") * F.col("re0") + F.col("im0") * F.col("im0")) * (F.col("re1") * F.col("re1") + F.col("im1") * F.col("im1")))
    p = p.withColumn("cr", F.try_divide(F.col("re0") * F.col("re1") + F.col("im0") * F.col("im1"), mag)).withColumn("ci", F.try_divide(F.col("im0") * F.col("re1") - F.col("re0") * F.col("im1"), mag))
    w = Window.partitionBy(*keys).orderBy(freq)
    p = p.withColumn("part", F.col("cr") * F.lead("ci").over(w) - F.col("ci") * F.lead("cr").over(w))
    return p.groupBy(*keys).agg(F.sum("part").alias("psi"))


def global_efficiency(edges: DataFrame, graph: str, n_nodes: int, floor: float = 1e-9) -> DataFrame:
    """Weighted efficiency: mean inverse length of the shortest paths, lengths 1 / w, by repeated min-plus joins inside each graph."""
    d = edges.where(F.col("w") > floor).select(graph, "a", "b", (1 / F.col("w")).alias("d"))
    d = d.unionByName(d.select(graph, F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy(graph, "a", "b").agg(F.min("d").alias("d"))
    for _ in range(max(1, (n_nodes - 1).bit_length())):
        right = d.select(graph, F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("e"))
        longer = d.join(right, [graph, "b"]).where("a <> c").select(graph, "a", F.col("c").alias("b"), (F.col("d") + F.col("e")).alias("d"))
        d = cut(d.unionByName(longer).groupBy(graph, "a", "b").agg(F.min("d").alias("d")))
    return d.groupBy(graph).agg((F.sum(1 / F.col("d")) / (n_nodes * (n_nodes - 1))).alias("efficiency"))


def graph_clustering(edges: DataFrame, graph: str, n_nodes: int) -> DataFrame:
    """Mean over the nodes of a graph of the share of a node's pairs of neighbours that are joined themselves; a node with fewer than
    two neighbours counts as 0. ``edges`` has one row an edge; direction, repeated edges and loops make no difference."""
    e = edges.where(F.col("a") != F.col("b")).select(graph, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = e.select(graph, F.col("a").alias("b"), F.col("b").alias("c"))
    closing = e.select(graph, "a", F.col("b").alias("c"))
    corners = e.join(second, [graph, "b"]).join(closing, [graph, "a", "c"]).select(graph, F.explode(F.array("a", "b", "c")).alias("node"))
    degree = e.select(graph, F.explode(F.array("a", "b")).alias("node")).groupBy(graph, "node").agg(F.count(F.lit(1)).alias("k"))
    shut = corners.groupBy(graph, "node").agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.try_divide(2 * F.col("n"), F.col("k") * (F.col("k") - 1)), F.lit(0.0))
    return degree.join(shut, [graph, "node"], "left").groupBy(graph).agg((F.sum(share) / n_nodes).alias("clustering"))


def spline_basis(df: DataFrame, x: str, knots: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Restricted cubic spline with three quantile knots: the variable and one curved term, 0 where the upper knots coincide."""
    k = df.agg(F.percentile(x, list(knots)).alias("__k")).select(*(F.get("__k", F.lit(i)).alias(f"__k{i}") for i in range(3)))
    cube = lambda c: F.pow(F.greatest(F.col(x) - F.col(c), F.lit(0.0)), F.lit(3.0))
    k0, k1, k2 = (F.col(f"__k{i}") for i in range(3))
    share = lambda a: F.try_divide(a, F.nullif(k2 - k1, F.lit(0.0)))
    term = F.try_divide(cube("__k0") - cube("__k1") * share(k2 - k0) + cube("__k2") * share(k1 - k0), F.nullif(F.pow(k2 - k0, F.lit(2.0)), F.lit(0.0)))
    curve = F.when(F.col(x).isNotNull(), F.coalesce(term, F.lit(0.0)))
    return df.crossJoin(F.broadcast(k)).withColumn("curve", curve).drop("__k0", "__k1", "__k2")  # one row of knots


def crossfit_residual(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Residual after the line of all other folds: their sums are the total less the fold's own, about overall means.

    Null where there is no other fold or ``x`` is constant in the others; pairs with a null side are not fitted. A null fold is a
    fold of its own.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    middle = df.agg(F.avg(F.when(both, F.col(x))).alias("__mx"), F.avg(F.when(both, F.col(y))).alias("__my"))
    rows = df.crossJoin(F.broadcast(middle))  # one row of means
    u, v = F.when(both, F.col(x) - F.col("__mx")), F.when(both, F.col(y) - F.col("__my"))
    terms = {"n": F.count(u).cast("double"), "u": F.sum(u), "v": F.sum(v), "uu": F.sum(u * u), "uv": F.sum(u * v)}
    own = rows.groupBy(F.col(fold).alias("__fold")).agg(*(F.coalesce(t, F.lit(0.0)).alias(f"__{c}") for c, t in terms.items()))
    total = own.agg(*(F.sum(f"__{c}").alias(f"__t_{c}") for c in terms))
    rest = own.crossJoin(F.broadcast(total)).select("__fold", *((F.col(f"__t_{c}") - F.col(f"__{c}")).alias(f"__{c}") for c in terms))
    share = lambda c: F.try_divide(F.col(f"__{c}"), F.nullif("__n", F.lit(0.0)))
    spread = F.col("__uu") - F.col("__u") * share("u")
    slope = F.try_divide(F.col("__uv") - F.col("__u") * share("v"), F.when(spread > 1e-12 * F.col("__uu"), spread))
    line = rest.withColumn("__slope", slope).select("__fold", "__slope", share("u").alias("__u"), share("v").alias("__v"))
    out = rows.join(line, F.col(fold).eqNullSafe(F.col("__fold")))
    residual = F.col(y) - F.col("__my") - F.col("__v") - F.col("__slope") * (F.col(x) - F.col("__mx") - F.col("__u"))
    return out.withColumn("residual", residual).withColumnRenamed("__slope", "slope").drop("__fold", "__u", "__v", "__mx", "__my")


def bootstrap_d(df: DataFrame, keys: list[str], order: str, value: str, a: Column, b: Column, n_boot: int) -> DataFrame:
    """Percentile interval of Cohen d over resampled rows."""
    x, y = F.when(a, F.col(value)), F.when(b, F.col(value))
    pooled = F.sqrt(((F.count(x) - 1) * F.var_samp(x) + (F.count(y) - 1) * F.var_samp(y)) / F.nullif(F.count(x) + F.count(y) - 2, F.lit(0)))
    d = bootstrap_draws(df, keys, order, n_boot).groupBy(*keys, "boot").agg(F.try_divide(F.avg(x) - F.avg(y), F.nullif(pooled, F.lit(0.0))).alias("d"))
    return d.groupBy(*keys).agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def primary_p(df: DataFrame, mode: str, alpha: float = 0.05) -> DataFrame:
    """The permutation p where asked for and present, else the parametric one; reportable when under alpha."""
    p = F.coalesce("p_perm", "p_raw") if mode == "perm_if_available" else F.col("p_perm") if mode == "perm" else F.col("p_raw")
    return df.withColumn("p_primary", p).withColumn("reportable", F.coalesce(F.col("p_primary") < alpha, F.lit(False)))


def clusters_1d(df: DataFrame, keys: list[str], order: str, r: str, cut_off: float) -> DataFrame:
    """Runs of neighbouring cells with |r| over the cut and one sign: first, last, cells and mass (sum of |r|)."""
    signed = df.withColumn("__s", F.when(F.abs(r) > cut_off, F.signum(r)).otherwise(0.0))
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag("__s").over(w).eqNullSafe(F.col("__s")), 0).otherwise(1)
    runs = signed.withColumn("__c", change).withColumn("cluster", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("__s <> 0").groupBy(*keys, "cluster").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.abs(r)).alias("mass"))


_HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # a cell and half its neighbours: the other half see it as theirs


def distance_adjacency(points: DataFrame, limit: float, block: int = 2048) -> DataFrame:
    """Pairs of channels no further apart than ``limit``, found among the neighbours on a grid of that side.

    The members of a cell are dealt into blocks of about ``block`` by their hash, and each two blocks of neighbouring cells meet once,
    so a crowded cell spreads over the tasks and no task holds more than one block; the tests stay quadratic in a cell's members.
    """
    cell = lambda c: F.floor(F.col(c) / limit).cast("long")
    own = points.select("channel", "x", "y").where("channel IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("__cx", cell("x")).withColumn("__cy", cell("y"))
    cells = cut(own.groupBy("__cx", "__cy").agg(F.count(F.lit(1)).alias("__n")).withColumn("__blocks", F.ceil(F.col("__n") / block).cast("int")))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _HALF))
    here = cells.select("__cx", "__cy", F.col("__n").alias("__n1"), F.col("__blocks").alias("__k1"), F.explode(steps).alias("__s"))
    there = cells.select(F.col("__cx").alias("__ox"), F.col("__cy").alias("__oy"), F.col("__n").alias("__n2"), F.col("__blocks").alias("__k2"))
    met = cut(here.withColumns({"__ox": F.col("__cx") + F.col("__s.i"), "__oy": F.col("__cy") + F.col("__s.j")}).join(there, ["__ox", "__oy"]))
    tests = met.agg(F.sum(F.col("__n1").cast("double") * F.col("__n2"))).first()[0] or 0.0
    tasks = int(min(max(tests / 2**21, 1), 20_000))  # rows are few and tests many, so the size of the rows is no guide

    same = F.col("__cx").eqNullSafe(F.col("__ox")) & F.col("__cy").eqNullSafe(F.col("__oy"))
    dealt = own.join(cells.drop("__n"), ["__cx", "__cy"]).withColumn("__b", F.pmod(F.xxhash64("channel"), F.col("__blocks")).cast("int")).drop("__blocks")
    place = ["__cx", "__cy", "__ox", "__oy", "__b", "__b2"]
    from_first = F.explode(F.sequence(F.when(same, F.col("__b")).otherwise(F.lit(0)), F.col("__k2") - 1))  # in one cell, blocks b <= b2
    to_last = F.explode(F.sequence(F.lit(0), F.when(same, F.col("__b2")).otherwise(F.col("__k1") - 1)))
    left = dealt.join(met.select("__cx", "__cy", "__ox", "__oy", "__k2"), ["__cx", "__cy"]).withColumn("__b2", from_first).withColumn("__one", same & (F.col("__b") == F.col("__b2"))).drop("__k2")
    right = dealt.select(F.col("channel").alias("__c2"), F.col("x").alias("__x2"), F.col("y").alias("__y2"), F.col("__cx").alias("__ox"), F.col("__cy").alias("__oy"), F.col("__b").alias("__b2"))
    right = right.join(met.select("__cx", "__cy", "__ox", "__oy", "__k1"), ["__ox", "__oy"]).withColumn("__b", to_last).drop("__k1")

    dx, dy = F.col("x") - F.col("__x2"), F.col("y") - F.col("__y2")
    distance = F.sqrt(dx * dx + dy * dy)
    once = (F.col("channel") < F.col("__c2")) | (~F.col("__one") & (F.col("channel") > F.col("__c2")))
    pairs = left.repartition(tasks, *place).join(right.repartition(tasks, *place).hint("merge"), place).where((distance <= limit) & once)
    pairs = pairs.withColumn("distance", distance)
    return pairs.select(F.least("channel", "__c2").alias("channel"), F.greatest("channel", "__c2").alias("other"), "distance")


def _power(x: Column, lam: Column) -> Column:
    pos = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.nullif(lam, F.lit(0.0)))
    neg = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / F.nullif(2 - lam, F.lit(0.0)))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson(df: DataFrame, y: str, grid: list[float]) -> DataFrame:
    """Log-likelihood of each lambda of a grid; the best one is the transform."""
    x = F.col(y)
    each = df.select(x, F.explode(F.array(*map(F.lit, grid))).alias("lam")).where(x.isNotNull() & ~F.isnan(x))
    s = each.withColumn("t", _power(x, F.col("lam"))).withColumn("g", F.signum(x) * F.log1p(F.abs(x))).groupBy("lam").agg(F.count("t").alias("n"), F.var_pop("t").alias("v"), F.sum("g").alias("g"))
    return s.select("lam", (-F.col("n") / 2 * F.ln("v") + (F.col("lam") - 1) * F.col("g")).alias("llf"))


def yeo_johnson_transform(df: DataFrame, y: str, grid: list[float]) -> DataFrame:
    """The target transformed by the likeliest lambda of the grid (of equal ones the least), as ``lam`` and ``transformed``."""
    best = yeo_johnson(df, y, grid).agg(F.max_by("lam", F.struct(F.col("llf"), -F.col("lam"))).alias("lam"))
    return df.crossJoin(F.broadcast(best)).withColumn("transformed", _power(F.col(y), F.col("lam")))


def soft_vote(df: DataFrame, features: list[str], label: str, train: Column) -> DataFrame:
    """Mean probability of a balanced logistic regression and a random forest fitted on the training rows."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("__train", train))
    share = rows.where("__train").agg(F.avg(F.col(label).cast("double")).alias("p"))
    rows = rows.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col(label) == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p")))).drop("p")
    fit = rows.where("__train")
    out = rows.where("NOT __train")
    for name, model in (("lr", LogisticRegression(labelCol=label, weightCol="weight", regParam=0.01)), ("rf", RandomForestClassifier(labelCol=label, numTrees=20, maxDepth=4, seed=1))):
        scored = model.fit(fit).transform(out)
        out = scored.withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    return out.withColumn("p_vote", (F.col("p_lr") + F.col("p_rf")) / 2).drop("features", "weight", "__train")


def state_metrics(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Share, mean dwell and visits of each state of a label sequence."""
    runs = islands(df, F.col(state), keys, order)
    total = F.sum("n").over(Window.partitionBy(*keys))
    return runs.withColumn("__t", total).groupBy(*keys, F.col("flag").alias("state")).agg((F.sum("n") / F.first("__t")).alias("coverage"), F.avg("n").alias("dwell"), F.count(F.lit(1)).alias("visits"))


def cluster_states(df: DataFrame, columns: list[str], k: int, scaled: bool = False, seed: int = 1) -> DataFrame:
    """k-means state of each row's vector, its columns scaled to one spread if asked; rows with a null go."""
    rows = VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True).fit(rows).transform(rows) if scaled else rows.withColumnRenamed("__raw", "__features")
    return KMeans(featuresCol="__features", k=k, seed=seed, maxIter=20).fit(rows).transform(rows).withColumnRenamed("prediction", "state").drop("__features", "__raw")


def connectivity_states(windows: DataFrame, keys: list[str], order: list[str], edge: str, edges: list, value: str, k: int) -> DataFrame:
    """State of each window from the vector of its edges' values (a null is 0), by k-means over the scaled vectors of all windows:
    ``keys, order, state`` and the window's ``place`` in the sequence of its keys. ``edges`` is the fixed list of edges."""
    wide = windows.groupBy(*keys, *order).pivot(edge, edges).agg(F.first(value)).na.fill(0.0, [str(e) for e in edges])
    named = wide.select(*keys, *order, *(F.col(f"`{e}`").alias(f"__e{j}") for j, e in enumerate(edges)))
    states = cluster_states(named, [f"__e{j}" for j in range(len(edges))], k, scaled=True)
    return states.select(*keys, *order, "state", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("place"))


def cv_plus(test: DataFrame, residuals: DataFrame, alpha: float) -> DataFrame:
    """Interval of each test row: its prediction less and plus order statistics of the residuals of its own fold.

    The prediction is the same for all residuals of the fold, so two order statistics a fold are enough.
    """
    w = Window.partitionBy("fold")
    n = F.count(F.lit(1)).over(w)
    placed = residuals.select("fold", "residual", F.row_number().over(w.orderBy("residual")).alias("__k"), n.alias("__n"))
    # the k-th least of prediction - residual belongs to the k-th greatest residual
    low = F.col("__n") + 1 - F.greatest(F.floor(alpha * (F.col("__n") + 1)), F.lit(1))
    high = F.least(F.ceil((1 - alpha) * (F.col("__n") + 1)), F.col("__n"))
    s = placed.groupBy("fold").agg(F.max(F.when(F.col("__k") == low, F.col("residual"))).alias("__low"), F.max(F.when(F.col("__k") == high, F.col("residual"))).alias("__high"))
    return test.join(s, "fold").select("row", (F.col("prediction") - F.col("__low")).alias("low"), (F.col("prediction") + F.col("__high")).alias("high"))


def partial_rank(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Rank correlation given one nuisance term: partial correlation of the average ranks."""
    from .stats import partial_one
    from .windows import average_rank

    ranked = df.select(*keys, *(average_rank(c, keys).alias(c) for c in (x, y, z)))
    return partial_one(ranked, keys, x, y, z)


def windowed_correlation(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Correlation of windowed power with a trial-level target in each cell."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col("power"), F.col(target)).alias("r"))


def state_switching(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Share of steps that change the state, and the entropy (nats) of the states' shares; null share for a single row."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = df.withColumn("__was", F.lag(state).over(w)).withColumn("__k", F.row_number().over(w))
    moved = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("__k") > 1) & ~F.col("__was").eqNullSafe(F.col(state))).alias("__moves"))
    share = df.where(F.col(state).isNotNull()).groupBy(*keys, state).agg(F.count(F.lit(1)).alias("__c"))
    total = share.groupBy(*keys).agg(F.sum("__c").cast("double").alias("__t"), F.sum(F.col("__c") * F.log("__c")).alias("__l"))
    entropy = F.log("__t") - F.col("__l") / F.col("__t")
    both = moved.join(total, keys, "left")
    return both.select(*keys, "n", F.try_divide(F.col("__moves"), F.col("n") - 1).alias("switching"), F.greatest(entropy, F.lit(0.0)).alias("entropy"))


def state_transitions(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Changes from one state to another between neighbouring rows: ``from_state, to_state``, their count and share of all that
    leave the state."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("to_state", F.lead(state).over(w)).where((F.col("to_state") != F.col(state)))
    s = pairs.groupBy(*keys, F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))


def _spaced(distance: int):
    """Places kept when the highest goes first and removes its neighbours nearer than the distance; of equal heights the later."""

    @F.pandas_udf("array<int>")
    def keep(places: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for at, high in zip(places, heights, strict=True):
            kept: list[int] = []
            for _, p in sorted(zip(high, at, strict=True), reverse=True):
                if all(abs(p - k) >= distance for k in kept):
                    kept.append(int(p))
            out.append(sorted(kept))
        return pd.Series(out, dtype=object)

    return keep


def sharpness_ratio(df: DataFrame, keys: list[str], order: str, value: str, offset: int, distance: int = 1, least: int = 2) -> DataFrame:
    """Log of mean peak sharpness over mean trough sharpness: an extremum's distance from the samples ``offset`` before and after,
    the offset at most a quarter of the series. A flat extremum is at its middle; extrema nearer than ``distance`` are thinned,
    highest first. Null for fewer than ten samples or ``least`` extrema of a kind; a null sample counts as the series' median.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    every = Window.partitionBy(*keys)
    x = F.when(~F.isnan(value), F.col(value))
    rows = df.select(*keys, order, F.coalesce(x, F.median(x).over(every)).alias("__x")).withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(every))
    rows = rows.withColumn("__o", F.greatest(F.lit(1), F.least(F.lit(offset), F.floor((F.col("__n") - 1) / 4))).cast("int"))
    change = F.when(F.lag("__x").over(w).eqNullSafe(F.col("__x")), 0).otherwise(1)
    flat = rows.withColumn("__c", change).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = flat.groupBy(*keys, "__run").agg(F.first("__x").alias("__x"), F.floor((F.min("__i") + F.max("__i")) / 2).cast("int").alias("__i"), F.first("__o").alias("__o"))
    v = Window.partitionBy(*keys).orderBy("__run")
    before, after = F.col("__x") - F.lag("__x").over(v), F.col("__x") - F.lead("__x").over(v)
    kind = F.when((before > 0) & (after > 0), 1).when((before < 0) & (after < 0), -1)
    found = flat.withColumn("__kind", kind).where("__kind IS NOT NULL")
    if distance > 1:
        # one row a series and kind: its extrema are fewer than its samples
        packed = found.groupBy(*keys, "__kind").agg(F.sort_array(F.collect_list(F.struct("__i", (F.col("__x") * F.col("__kind")).alias("h")))).alias("e"))
        kept = packed.select(*keys, "__kind", F.explode(_spaced(distance)("e.__i", "e.h")).alias("__i"))
        found = found.join(kept, [*keys, "__kind", "__i"])
    side = lambda s, name: rows.select(*keys, (F.col("__i") + s * F.col("__o")).alias("__i"), F.col("__x").alias(name))
    near = found.join(side(1, "__before"), [*keys, "__i"], "left").join(side(-1, "__after"), [*keys, "__i"], "left")
    sharp = F.abs(F.col("__x") - F.col("__before")) + F.abs(F.col("__x") - F.col("__after"))
    of = lambda k, f, c: f(F.when(F.col("__kind") == k, c))
    s = near.groupBy(*keys).agg(of(1, F.avg, sharp).alias("__p"), of(-1, F.avg, sharp).alias("__t"), of(1, F.count, F.lit(1)).alias("__np"), of(-1, F.count, F.lit(1)).alias("__nt"))
    size = rows.groupBy(*keys).agg(F.max("__n").alias("n"))
    ok = (F.col("n") >= 10) & (F.col("__np") >= least) & (F.col("__nt") >= least) & (F.col("__p") > 0) & (F.col("__t") > 0)
    return size.join(s, keys, "left").select(*keys, "n", F.when(ok, F.log(F.try_divide(F.col("__p"), F.when(ok, F.col("__t"))))).alias("sharpness"))
