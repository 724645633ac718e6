"""Joins, unions and alignment of trial tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_key(column: str) -> Column:
    """The key itself; a null key is an error."""
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"null key {column}")).cast("long"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def trial_table(events: DataFrame, features: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Events with their features as columns; ``names`` is the fixed column list of the pivot."""
    wide = features.groupBy(*keys).pivot("feature", names).agg(F.first("value", ignorenulls=True))
    return events.join(wide, keys, "left")


def outer_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge; a shared column takes the left value, else the right one."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*keys, *shared]]
    only = [F.col(f"a.{c}") for c in left.columns if c not in keys and c not in shared] + [F.col(f"b.{c}") for c in right.columns if c not in keys and c not in shared]
    return a.join(b, on, "full_outer").select(*pick, *only)


# fixed values: the key sets tried in this order when trial tables are merged
KEY_SETS = (("subject", "task", "run_id", "trial"), ("subject", "run_id", "trial"), ("run_id", "trial"), ("trial",), ("epoch",), ("onset", "duration"))


def unique_keys(left: DataFrame, right: DataFrame, key_sets: tuple[tuple[str, ...], ...] = KEY_SETS) -> list[str]:
    """The first key set whose columns both tables have and which no row repeats in either; none is an error."""
    shared = set(left.columns) & set(right.columns)
    for keys in key_sets:
        if shared.issuperset(keys) and all(repeated_keys(t, list(keys)).isEmpty() for t in (left, right)):
            return list(keys)
    raise ValueError("no key set is unique in both tables")


def merge_tables(tables: list[DataFrame], key_sets: tuple[tuple[str, ...], ...] = KEY_SETS) -> DataFrame:
    """Full outer merge of trial tables, each on the first unique key set it shares with those before it; empty tables are passed over."""
    filled = [t for t in tables if not t.isEmpty()]
    if not filled:
        raise ValueError("no rows in any trial table")
    return reduce(lambda a, b: outer_merge(a, b, unique_keys(a, b, key_sets)), filled)


def union_blocks(blocks: list[DataFrame]) -> DataFrame:
    """Union of long feature blocks by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)


def overlapping(blocks: list[DataFrame], name: str = "feature") -> DataFrame:
    """Feature names that more than one block has."""
    tagged = [b.select(name).distinct() for b in blocks]
    return reduce(DataFrame.unionByName, tagged).groupBy(name).agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")


def _once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself; a key that occurs twice is an error. It is counted where the join needs its rows anyway."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    single = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit(f"{', '.join(keys)} repeats")).cast("boolean"))
    return df.where(known).withColumn("__n", n).where(single).drop("__n")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], agree: list[str]) -> DataFrame:
    """Inner merge of two unique-key tables whose ``agree`` columns must be equal; a repeated key or a difference is an error."""
    a, b = _once(left, keys).alias("a"), _once(right, keys).alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    checked = [F.when(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.col(f"a.{c}")).otherwise(F.raise_error(F.lit(f"{c} differs"))).alias(c) for c in agree]
    rest = [F.col(f"a.{c}") for c in left.columns if c not in agree] + [F.col(f"b.{c}") for c in right.columns if c not in keys and c not in agree]
    return a.join(b, on).select(*rest, *checked)


def merge_one_to_one(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner merge of several unique-key tables; every other column that two of them share must agree."""
    return reduce(lambda a, b: one_to_one(a, b, keys, [c for c in a.columns if c in b.columns and c not in keys]), tables)


def concatenate_runs(events: DataFrame, key: str, run: str, time: str) -> DataFrame:
    """Runs laid end to end: each run's times are shifted by the summed lengths of the runs before it."""
    spans = events.groupBy(key, run).agg(F.max(time).alias("span"))
    before = F.sum("span").over(Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(key, run, F.coalesce(before, F.lit(0.0)).alias("offset"))
    return events.join(spans, [key, run]).withColumn("time", F.col(time) + F.col("offset"))


def kept_trials(planned: DataFrame, kept: DataFrame, keys: list[str], group: list[str], order: list[str]) -> DataFrame:
    """Planned trials that were kept, numbered densely from 0."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return planned.join(kept.select(*keys).distinct(), keys, "left_semi").withColumn("dense_id", number)


def by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows paired by their place inside a group; groups of different length are left out."""
    w = Window.partitionBy(*keys)
    number = lambda df, order: df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    return number(left, left_order).join(number(right, right_order), [*keys, "place", "__n"]).drop("__n")


def interval_qc(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Median and 95th percentile of the absolute difference of successive intervals."""
    w = Window.partitionBy(*keys).orderBy("place")
    off = F.abs((F.col(a) - F.lag(a).over(w)) - (F.col(b) - F.lag(b).over(w)))
    return pairs.withColumn("off", off).groupBy(*keys).agg(F.median("off").alias("median_error"), F.percentile("off", 0.95).alias("p95_error"), F.count("off").alias("n"))


def best_offset(events: DataFrame, behaviour: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Start among the first ``most`` events at which the behaviour onsets fit best: least (median, 95th percentile, start)."""
    starts = behaviour.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("place", F.col("place") + F.col("start"))
    both = starts.join(events.select(*keys, "place", F.col("onset").alias("event_onset")), [*keys, "place"])
    w = Window.partitionBy(*keys, "start").orderBy("place")
    off = F.abs((F.col("event_onset") - F.first("event_onset").over(w)) - (F.col("onset") - F.first("onset").over(w)))
    fit = both.withColumn("off", off).groupBy(*keys, "start").agg(F.median("off").alias("median"), F.percentile("off", 0.95).alias("p95"))
    return fit.groupBy(*keys).agg(F.min(F.struct("median", "p95", "start")).alias("best")).select(*keys, "best.*")


def union_flag(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Keys flagged in any of their rows."""
    return df.groupBy(*keys).agg(F.bool_or(flag).alias("bad"))


def subject_sets(sources: list[DataFrame], policy: str) -> DataFrame:
    """Subjects in any source, or in all of them."""
    sets = [s.select("subject").distinct() for s in sources]
    return reduce(DataFrame.union, sets).distinct() if policy == "union" else reduce(DataFrame.intersect, sets)


def in_all_blocks(blocks: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Keys with a finite value in every block; a null key is in none."""
    each = [b.select(*keys, F.col(value).cast("double").alias("__v"), F.lit(n).alias("__block")) for n, b in enumerate(blocks)]
    return in_every_block(reduce(DataFrame.unionByName, each), "__block", list(range(len(blocks))), keys, "__v")


def in_every_block(df: DataFrame, block: str, names: list, keys: list[str], value: str) -> DataFrame:
    """Keys with a finite value in every one of the named blocks of a long table, which is grouped once; a null key is in none."""
    x = F.col(value).cast("double")
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], ~F.isnan(x) & (F.abs(x) < float("inf")))
    has = df.where(known & F.col(block).isin(names)).groupBy(*keys).agg(*(F.bool_or(F.col(block) == n).alias(f"__in{i}") for i, n in enumerate(names)))
    return has.where(" AND ".join(f"__in{i}" for i in range(len(names)))).select(*keys)


def single_trial_events(trials: DataFrame, keys: list[str], trial: str) -> DataFrame:
    """For each target trial a copy of its run's events, labelled target or other."""
    target = trials.select(*keys, F.col(trial).alias("target_trial"))
    return trials.join(target, keys).withColumn("role", F.when(F.col(trial) == F.col("target_trial"), "target").otherwise("other"))


def common_to_all(df: DataFrame, key: str, item: str) -> DataFrame:
    """Items that every value of ``key`` has."""
    total = df.agg(F.countDistinct(key).alias("total"))
    return df.groupBy(item).agg(F.countDistinct(key).alias("n")).join(F.broadcast(total), F.col("n") == F.col("total")).select(item, "n")


def trial_key(label: Column) -> Column:
    """``run|trial-NNN`` from labels such as ``run-1_trial-7``, ``1|trial-007`` or ``1:7``."""
    run = F.regexp_extract(label, r"(\d+)\D", 1).try_cast("int")
    trial = F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")
    return F.format_string("%d|trial-%03d", run, trial)
