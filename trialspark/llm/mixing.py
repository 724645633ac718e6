"""Mixing sources to target weights, with DataFrame functions only.

The corpus is reduced to narrow rows (id, source, size in words). Each source is cut into blocks by a hash of the id; its
target is met by whole passes over its blocks and one partial pass over its first blocks in a hashed order; in the one block
where the target falls, documents are taken in a hashed order while they fit, then the one that best fills what is left. Where
that misses a target by more than ``MISS`` of it (a long document stood in the way), rounds over that block and the later ones
start again, longest document first, each round without the documents longer than its gap.

So every source has a number of block tickets, one for each pass over each of its blocks. These exact quotas are parted among the
output shards by a splitting tree: at each node a multivariate hypergeometric draw gives the left half its share of every
source. The tickets of a source are permuted, shards draw disjoint runs of them, and rows are shuffled inside their shard. What a
row's copies are, and how many, is what the tickets of its block give it.

One number per stratum reaches the driver. A stratum is a source, or, beyond ``MAX_STRATA``, a hash group of sources whose tickets
are permuted together, which leaves the draw of every source what it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialise, row_key, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Blocks of a source hold about so many rows, but a source has no more than MAX_BLOCKS blocks, fewer when there are many sources.
BLOCK_ROWS = 1000
MAX_BLOCKS = 4096
ALL_BLOCKS = 1 << 26
#: One row per source is broadcast up to so many sources, else joined by shuffle.
MAX_BROADCAST = 100_000
#: Words of a shard, about, as long as that makes no more than MAX_SHARDS shards.
SHARD_WORDS = 1 << 22
MAX_SHARDS = 1 << 16
#: Strata, and strata times shards, at most.
MAX_STRATA = 65_536
MAX_DRAWS = 1 << 22
SEED = 17
#: A source whose first take misses its target by more than this share of it is filled up in at most so many rounds.
MISS = 0.01
ROUNDS = 12


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Ticket quotas by stratum and shard, ``(strata, shards)``: rows add up to ``quotas``, columns are as equal as can be.

    The quotas add up to less than 10^9, which ``ALL_BLOCKS`` sees to.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)

    def part(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle = (first + last) // 2
        total = int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, total * (middle - first) // (last - first), method="marginals")
        part(left, first, middle)
        part(counts - left, middle, last)

    if len(quotas):
        part(np.asarray(quotas, np.int64), 0, shards)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: rank, size, target and the passes over it. Targets share all words by weight, filled up to the caps."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeat)
    # sources in the order in which the rising water level meets their caps
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    level = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = level.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    out = level.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    out = out.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    return out.withColumn("n_blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.floor(ALL_BLOCKS / F.count(F.lit(1)).over(everything))), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long")).drop("cap", "level", "weight", "n_rows")


def _fill_up(rows: DataFrame, missed: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of those sources of ``missed`` whose target is met better by rounds, with ``more`` decided anew.

    ``rows`` are all from the block where the target falls onwards. In a round the untaken documents no longer than the gap are
    taken by running sums: whole blocks, then one part, the longest first.
    """
    rows = materialise(rows.withColumn("took", F.lit(False)))
    named = rows.columns
    hashed = F.md5(F.concat(F.lit("row:"), F.col("doc_id").cast("string")).cast("binary"))
    tie = [hashed, "doc_id", "size", *(["row_key"] if "row_key" in named else [])]
    block = Window.partitionBy("rank", "place")

    def gaps() -> DataFrame:
        taken = rows.groupBy("rank").agg(F.sum(F.when(F.col("took"), F.col("size")).otherwise(0)).alias("taken"))
        return materialise(missed.join(taken, "rank").select("rank", "target", "off", (F.col("room") - F.col("taken")).alias("gap")), partitions=1)

    gap, order = gaps(), Window.partitionBy("rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(ROUNDS):
        can = rows.join(hint(gap.where(F.col("gap") > MISS * F.col("target")).select("rank", "gap")), "rank", "left")
        can = can.withColumn("can", F.coalesce(~F.col("took") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")), F.lit(False)))
        sums = can.where("can").groupBy("rank", "place", "gap").agg(F.sum("size").alias("__size")).withColumn("__until", F.sum("__size").over(order))
        sums = materialise(sums.where(F.col("__until") - F.col("__size") < F.col("gap")).select("rank", "place", (F.col("gap") - F.col("__until") + F.col("__size")).alias("__room")))
        if sums.isEmpty():
            break
        run = F.sum(F.when(F.col("can"), F.col("size")).otherwise(0)).over(block.orderBy(F.col("size").desc(), *tie).rowsBetween(Window.unboundedPreceding, 0))
        can = can.join(sums, ["rank", "place"], "left").withColumn("took", F.col("took") | F.coalesce(F.col("can") & (run <= F.col("__room")), F.lit(False)))
        rows = materialise(can.select(*named))
        gap = gaps()

    off = F.abs(F.col("size") - F.col("gap"))
    fits = rows.join(hint(gap), "rank").where(~F.col("took") & (off < F.col("gap")))
    best = fits.groupBy("rank").agg(F.min(F.struct(off.alias("off"), "place")).alias("best"))
    known = gap.join(best, "rank", "left").where(F.least("gap", "best.off") < F.col("off")).select("rank", "gap", F.col("best.off").alias("__off"), F.col("best.place").alias("__at"))
    out = rows.join(hint(materialise(known, partitions=1)), "rank")
    hit = F.coalesce(~F.col("took") & (F.col("place") == F.col("__at")) & (off == F.col("__off")), F.lit(False))
    first = F.row_number().over(block.orderBy(hit.desc(), *tie)) == 1
    out = out.withColumn("more", (F.col("took") | (hit & first)).cast("long"))
    return materialise(out.select(*[c for c in named if c != "took"]))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards``: what the mix takes of each row, and the shard of each copy.

    Whole documents are taken, ``copies`` times each (0 to ``max_repeat``), so a source's taken words differ from its target
    mostly by a few words, and by more than ``MISS`` of it only where ``ROUNDS`` rounds find no documents that come nearer. A null
    text has size 0; a null source is a source of its own, the last one. Sources with no words have target 0. Rows that repeat
    an id are taken one by one. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    With ``key``, a string column of ``docs``, each row also has it as ``row_key``. Options are those of ``plan_shards``.
    """
    return plan_shards(docs, **options)[0]


def plan_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, shards: int | None = None, shard_words: int = SHARD_WORDS, max_strata: int = MAX_STRATA, seed: int = SEED, key: Column | None = None) -> tuple[DataFrame, int]:
    """The plan of ``mix_plan`` and the number of shards: ``shards``, or as many as ``shard_words`` gives."""
    spark = docs.sparkSession
    keyed = [] if key is None else ["row_key"]
    sizes = materialise(docs.select(*([] if key is None else [key.alias("row_key")]), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")))
    sources = materialise(source_targets(sizes, weights, max_repeat), partitions=1)
    n_sources, words = sources.select(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    shards = shards or max(1, min(MAX_SHARDS, math.ceil(words / shard_words)))
    hint = F.broadcast if n_sources <= MAX_BROADCAST else (lambda df: df)

    hashed = F.conv(F.substring(F.md5(F.concat(F.lit("row:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = sizes.join(hint(sources.select("source", "rank", "n_blocks")), sizes["source"].eqNullSafe(sources["source"]))
    rows = rows.select("doc_id", "size", *keyed, "rank", F.coalesce(hashed % F.col("n_blocks"), F.lit(0)).alias("block"))

    totals = rows.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("rank").orderBy(F.md5(F.concat_ws(":", F.lit("block"), "rank", "block").cast("binary")))
    blocks = totals.join(hint(sources.select("rank", "rest")), "rank")
    blocks = blocks.withColumn("place", F.row_number().over(order) - 1).withColumn("until", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = (F.col("rest") > 0) & (F.col("until") <= F.col("rest"))
    edge = (F.col("rest") > 0) & (F.col("until") > F.col("rest")) & (F.col("until") - F.col("block_size") < F.col("rest"))
    blocks = materialise(blocks.select("rank", "block", "place", whole.alias("whole"), edge.alias("edge"), (F.col("rest") - F.col("until") + F.col("block_size")).alias("room")))

    placed = rows.join(blocks, ["rank", "block"])
    inside = Window.partitionBy("rank", "block").orderBy(F.md5(F.concat(F.lit("row:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id", "size", *keyed)
    at_edge = placed.where("edge").withColumn("until", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy("rank", "block")
    at_edge = at_edge.withColumn("gap", F.col("room") - F.coalesce(F.max(F.when(F.col("until") <= F.col("room"), F.col("until"))).over(block), F.lit(0)))
    off = F.abs(F.col("size") - F.col("gap"))
    at_edge = at_edge.withColumn("fits", (F.col("until") > F.col("room")) & (off < F.col("gap")))
    last = F.row_number().over(block.orderBy(F.col("fits").desc(), off, "doc_id", "size", *keyed)) == 1
    at_edge = at_edge.withColumn("more", ((F.col("until") <= F.col("room")) | (F.col("fits") & last)).cast("long")).drop("until", "gap", "fits")
    at_edge = materialise(at_edge)
    filled = at_edge.groupBy("rank").agg(F.max("place").alias("from"), F.max("room").alias("room"), F.abs(F.max("room") - F.sum(F.col("size") * F.col("more"))).alias("off"))
    missed = materialise(filled.join(hint(sources.select("rank", "target")), "rank").where(F.col("off") > MISS * F.col("target")), partitions=1)
    others = placed.where(~F.col("edge")).withColumn("more", F.col("whole").cast("long"))
    rated = at_edge.unionByName(others)
    partial = blocks.groupBy("rank").agg(F.count_if(F.col("whole") | F.col("edge")).alias("partial"))
    if not missed.isEmpty():
        later = others.join(hint(missed.select("rank", "from")), "rank").where(F.col("place") > F.col("from")).drop("from")
        again = _fill_up(at_edge.join(hint(missed.select("rank")), "rank", "left_semi").unionByName(later), missed, hint)
        reach = again.groupBy("rank").agg(F.max(F.when(F.col("more") > 0, F.col("place") + 1)).alias("reach"), F.min("place").alias("from"))
        reach = hint(materialise(reach, partitions=1))
        kept = rated.join(reach, "rank", "left").where(F.col("from").isNull() | (F.col("place") < F.col("from")))
        rated = kept.drop("reach", "from").unionByName(again)
        partial = partial.join(reach, "rank", "left").select("rank", F.greatest("partial", "reach").alias("partial"))

    # one ticket for each pass over each block, and one for each block of the partial pass
    strata = min(max_strata, max(1, MAX_DRAWS // shards))
    stratum = F.col("rank") - 1 if n_sources <= strata else F.pmod(F.xxhash64("rank"), F.lit(strata))
    passes = sources.select("rank", "passes").join(partial, "rank")
    copies = F.col("passes") + (F.col("place") < F.col("partial")).cast("long")
    tickets = blocks.select("rank", "block", "place").join(hint(passes), "rank").where(copies > 0)
    tickets = tickets.select(stratum.cast("long").alias("stratum"), "rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    mixed = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(f"ticket{seed}"), "rank", "block", "copy").cast("binary")), "rank", "block", "copy")
    tickets = materialise(tickets.withColumn("at", F.row_number().over(mixed) - 1))
    quotas = tickets.groupBy("stratum").agg(F.count(F.lit(1)).alias("quota")).orderBy("stratum").collect()  # at most `strata` rows
    drawn = split_quotas([q["quota"] for q in quotas], shards, seed)
    firsts = np.cumsum(drawn, 1) - drawn
    runs = [{"stratum": q["stratum"], "runs": [{"shard": k, "at": int(f[k])} for k in np.flatnonzero(d).tolist()]} for q, d, f in zip(quotas, drawn, firsts, strict=True)]
    runs = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(runs)), "array<struct<stratum long, runs array<struct<shard int, at long>>>>"))).select("stratum", F.inline("runs"))
    nothing = [F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("copy")]
    both = tickets.withColumn("shard", F.lit(None).cast("int")).unionByName(runs.select("stratum", *nothing, "at", "shard"))
    order = Window.partitionBy("stratum").orderBy("at", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("shard", F.last("shard", True).over(order)).where("rank IS NOT NULL")
    dealt = dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))

    known = hint(sources.select("rank", "source_size", "target", "passes"))
    out = rated.join(known, "rank").join(dealt, ["rank", "block"], "left")
    shard = F.coalesce(F.slice("dealt.shard", F.lit(1), (F.col("passes") + F.col("more")).cast("int")), F.array().cast("array<int>"))
    out = out.withColumn("shards", shard)
    return out.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), F.size("shards").alias("copies"), "shards", *keyed), shards


def mix(docs: DataFrame, *, id_col: str = "doc_id", shard_col: str = "shard", **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, with its shard, shuffled inside the shard.

    Partition k holds shard k, so a written result has a file for each shard. Rows are known by all their columns, so ids may be
    null or repeated; of rows that repeat all columns one stands for the others and comes as often as all of them together are
    taken. A column of ``docs`` named ``shard_col`` is replaced. An empty table gives an empty result.
    """
    text_col = options.get("text_col", "text")
    key = row_key(docs, *[c for c in docs.columns if c != text_col], text_col)
    plan, shards = plan_shards(docs, id_col=id_col, key=key, **options)
    plan = materialise(plan.select("row_key", "shards"))
    own, copy = (unused(name, [*docs.columns, shard_col]) for name in ("__key", "__copy"))
    rows = docs.withColumn(own, key)
    repeated = materialise(plan.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row_key").alias(own)))
    if not repeated.isEmpty():
        one = rows.join(repeated, own, "left_semi").groupBy(own).agg(F.any_value(F.struct(*[rows[c] for c in docs.columns])).alias("row"))
        rows = rows.join(repeated, own, "left_anti").select(*docs.columns, own).unionByName(one.select("row.*", own))
    drawn = plan.select(F.col("row_key").alias(own), F.posexplode("shards").alias(copy, unused("__shard", docs.columns)))
    held = drawn.columns[-1]
    rows = rows.drop(shard_col).join(drawn, own).withColumnRenamed(held, shard_col)
    local = F.md5(F.concat_ws(":", F.lit("local"), F.col(shard_col), F.col(copy), F.col(id_col).cast("string")).cast("binary"))
    return rows.repartitionById(shards, F.col(shard_col)).sortWithinPartitions(local, own).drop(own, copy)
