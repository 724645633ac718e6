"""Ranks, running minima and maxima of groups of any size by two-level scans.

Rows are parted by ranges of (keys, order), so one large group spreads over many tasks and equal rows stay together. Each part is
numbered by itself; counts of the parts, a row for each group and part, give the offsets, and minima or maxima of the parts carry a
scan from part to part. What a part gets from the others heads its rows as one more row, so nothing is joined. No window holds more
than one part, or one group's list of parts, and the size of a part is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

PART_ROWS = 1 << 18  # rows of a part, about, up to FEW parts; equal rows can make it more
FEW = 200  # parts that a shuffle writes straight to their files; for more it holds and sorts a task's rows
MOST_ROWS = 1 << 23  # rows of a part, about, in tables of more than FEW such parts


def parted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written in ranges of (keys, order): ``__part`` is the range, ascending within a group. ``df`` is counted first."""
    rows = df.count()
    n = max(min(FEW, -(-rows // PART_ROWS)), -(-rows // MOST_ROWS))
    ranges = df.repartitionByRange(n, *keys, *order) if n > 1 else df.repartitionByRange(*keys, *order)
    return cut(ranges.withColumn("__part", F.spark_partition_id()))


def _headed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Written ``rows`` and their groups' and parts' ``heads`` (``__row`` is false), each part in a task of its own."""
    last = rows.agg(F.max("__part")).first()[0] or 0
    both = heads.withColumn("__row", F.lit(False)).unionByName(rows.withColumn("__row", F.lit(True)), allowMissingColumns=True)
    return both.repartitionById(last + 1, "__part")


def _offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = Window.partitionBy(*keys).orderBy("__part")
    before = F.coalesce(F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select(*keys, "__part", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__group_size"))


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``__place`` (from 1, in ``order``, nulls first) in their group, the group's ``__size`` and ``__part``."""
    rows = parted(df, keys, order)
    part = Window.partitionBy(*keys, "__part").orderBy("__row", *order)
    out = _headed(rows, _offsets(rows, keys)).withColumn("__size", F.max("__group_size").over(part))
    out = out.withColumn("__place", F.max("__before").over(part) + F.row_number().over(part) - 1)  # the head comes first
    return out.where("__row").drop("__row", "__before", "__group_size")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``name``: the average rank of a value in its group, and ``__size``, the group's values that are not null; null values rank nowhere."""
    df = cut(df)
    rows = parted(df.where(F.col(value).isNotNull()), keys, [value])  # equal values share a part
    part = Window.partitionBy(*keys, "__part").orderBy("__row", value)
    local = (F.rank().over(part) + F.count(F.lit(1)).over(part)) / 2 - 1  # first and last place of equal values, without the head
    out = _headed(rows, _offsets(rows, keys)).withColumn("__size", F.max("__group_size").over(part)).withColumn(name, F.max("__before").over(part) + local)
    none = df.where(F.col(value).isNull()).withColumns({"__size": F.lit(None).cast("long"), name: F.lit(None).cast("double")})
    return out.where("__row").select(none.columns).unionByName(none)


def carried(rows: DataFrame, keys: list[str], value: str, name: str, *, least_after: bool) -> DataFrame:
    """``name`` for written rows of ``numbered``: the least ``value`` from a row to its group's end, or the greatest up to the row."""
    fold = F.min if least_after else F.max  # both pass over null
    parts = rows.groupBy(*keys, "__part").agg(fold(value).alias("__m"))
    way = F.desc if least_after else F.asc  # towards the row: Spark folds a frame that grows once, but one that shrinks anew for each row
    along = Window.partitionBy(*keys).orderBy(way("__part")).rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select(*keys, "__part", fold("__m").over(along).alias(value))
    here = Window.partitionBy(*keys, "__part").orderBy("__row", way("__place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _headed(rows, heads).withColumn(name, fold(value).over(here)).where("__row").drop("__row")
