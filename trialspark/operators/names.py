"""Feature names as columns, rules over names, roles and value masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
SCOPES = ("ch", "roi", "chpair", "global")


def parse(name: Column) -> Column:
    """Struct of group, segment, band, scope, identifier, stat; null for names that do not parse."""
    t = F.split(name, "_")
    ok = (F.size(t) >= 5) & F.element_at(t, 4).isin(*SCOPES)
    scoped = F.element_at(t, 4) == "global"
    part = lambda k: F.get(t, F.lit(k))
    rest = F.array_join(F.slice(t, F.when(scoped & (F.size(t) == 5), 5).otherwise(6), F.size(t)), "_")
    return F.when(ok, F.struct(part(0).alias("group"), part(1).alias("segment"), part(2).alias("band"), part(3).alias("scope"), F.when(~(scoped & (F.size(t) == 5)), part(4)).alias("identifier"), rest.alias("stat")))


def build(group: Column, segment: Column, band: Column, scope: Column, identifier: Column, stat: Column) -> Column:
    """The name of the parts; an unknown scope is an error."""
    checked = F.when(scope.isin(*SCOPES), scope).otherwise(F.raise_error(F.concat(F.lit("unknown scope "), scope)).cast("string"))
    return F.concat_ws("_", group, segment, band, checked, identifier, stat)


def parsed(names: DataFrame) -> DataFrame:
    return names.withColumn("p", parse(F.col("name"))).where("p IS NOT NULL").select("name", "p.*")


def classify(names: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """The class of the first rule (lowest priority number) whose pattern a name matches; others have none."""
    out = F.lit(None).cast("string")
    for _, pattern, kind in sorted(rules, reverse=True):
        out = F.when(F.col("name").rlike(pattern), kind).otherwise(out)
    return names.withColumn("class", out)


def first_usable(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """The first candidate column that reads as a number, row by row."""
    return df.withColumn(name, F.coalesce(*(F.col(c).try_cast("double") for c in candidates)))


def condition_mask(column: Column, first: str, second: str) -> Column:
    return F.when(column == first, "A").when(column == second, "B")


def event_mask(name: Column, prefixes: list[str], types: list[str]) -> Column:
    """True for a normalised name that begins with a prefix or is one of the types."""
    clean = F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")
    return reduce(lambda a, b: a | b, [*(F.startswith(clean, F.lit(p)) for p in prefixes), clean.isin(*types)])


def phase_scope(scope: Column, value: str, phase: Column, allowed: list[str]) -> Column:
    """The phase filter holds only for rows inside the scope value."""
    return F.when(scope == value, phase.isin(*allowed)).otherwise(True)


def remap(column: Column, kind: Column, first: str, second: str) -> Column:
    """``cond_a_<kind>`` or ``cond_b_<kind>``: values match as numbers where both read as such, else as text."""

    def same(value: str) -> Column:
        number = F.lit(value).try_cast("double")
        return F.coalesce(column.try_cast("double") == number, F.trim(column.cast("string")) == value)

    return F.when(same(first), F.concat(F.lit("cond_a_"), kind)).when(same(second), F.concat(F.lit("cond_b_"), kind)).otherwise(kind)


def select_nuisance(confounds: DataFrame, patterns: list[str], top: tuple[str, int]) -> DataFrame:
    """Confounds whose names match the strategy, plus the first ``n`` components of one prefix; null reads as 0."""
    prefix, n = top
    number = F.regexp_extract("name", prefix + r"(\d+)$", 1).try_cast("int")
    wanted = reduce(lambda a, b: a | b, [F.col("name").rlike(p) for p in patterns])
    return confounds.where(wanted | (number < n)).withColumn("value", F.coalesce("value", F.lit(0.0)))


def binarise(y: Column, threshold: float, inclusive: bool = False) -> Column:
    """1 above a fixed threshold; there is no median split."""
    return F.when(y.isNull(), None).when(y >= threshold if inclusive else y > threshold, 1.0).otherwise(0.0)


def channel_regions(channels: DataFrame, regions: list[tuple[str, str]]) -> DataFrame:
    """Each channel with every region whose pattern it matches."""
    table = channels.sparkSession.createDataFrame(regions, "roi string, pattern string")
    return channels.join(F.broadcast(table), F.expr("channel RLIKE pattern")).select("channel", "roi")


def covariate_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct values, nulls, infinities, and whether it is usable."""
    long = df.select(*columns).unpivot([], columns, "column", "value")
    out = long.groupBy("column").agg(F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.abs("value") == float("inf")).alias("n_inf"))
    return out.withColumn("usable", (F.col("n_distinct") > 1) & (F.col("n_inf") == 0))


def extremes(df: DataFrame, key: str, predictor: str, digits: int, least_levels: int) -> DataFrame:
    """Rows at the rounded minimum and maximum of each group with enough levels."""
    w = Window.partitionBy(key)
    x = df.withColumn("level", F.round(predictor, digits))
    x = x.withColumn("n_levels", F.size(F.collect_set("level").over(w))).withColumn("low", F.min("level").over(w)).withColumn("high", F.max("level").over(w))
    side = F.when(F.col("level") == F.col("low"), "min").when(F.col("level") == F.col("high"), "max")
    return x.where(F.col("n_levels") >= least_levels).withColumn("side", side).where("side IS NOT NULL").drop("low", "high")


def keep_events(events: DataFrame, keys: list[str], pattern: str, trigger: str, onset: str = "onset") -> DataFrame:
    """Events of a pattern from the first trigger of each run on, with onsets counted from it."""
    zero = F.min(F.when(F.col("condition") == trigger, F.col(onset))).over(Window.partitionBy(*keys))
    return events.withColumn("zero", zero).where(F.col("condition").rlike(pattern) & (F.col(onset) >= F.col("zero"))).withColumn("shifted", F.col(onset) - F.col("zero")).drop("zero")


def in_regions(features: DataFrame, allowed: list[str]) -> DataFrame:
    """Parsed features of the allowed regions (trimmed, any case); others, and features without a region, go."""
    wanted = [a.strip().lower() for a in allowed if a.strip()]
    return features.where((F.col("scope") == "roi") & F.lower(F.trim("identifier")).isin(*wanted))
