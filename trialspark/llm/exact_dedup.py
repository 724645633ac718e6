"""Exact duplicates by a heavy-hitter split, with DataFrame functions only.

1. One pass reduces each row to its id and the SHA-256 of the normalised text (a narrow table in the shared folder).
2. A Misra-Gries summary (``DataFrame.freqItems``, over the digests as strings: it tells byte arrays apart by identity) names at
   most ``1 / support`` candidates; it holds every digest with more than ``support`` of the rows.
3. The candidates are counted exactly and those above ``support`` (the verified winners, at most ``1 / support`` rows) are
   broadcast, so their copies are resolved map-side.
4. All other digests are grouped by an ordinary shuffle; none of them holds more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, materialise

#: Share of the rows above which a digest counts as heavy; bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def _stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


def candidates(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """At most ``1 / support`` digests, among them each one that more than ``support`` of the rows of ``digests`` have."""
    named = digests.select(F.hex("digest").alias("name"))
    return named.freqItems(["name"], support).select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest"))


def heavy_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``digest, group_size, keep_id`` of exactly those digests that more than ``support`` of the rows have."""
    counted = digests.join(F.broadcast(candidates(digests, support)), "digest", "left_semi").groupBy("digest").agg(*_stats())
    total = digests.agg(F.count(F.lit(1)).alias("n_rows"))
    return materialise(counted.crossJoin(F.broadcast(total)).where(F.col("group_size") > support * F.col("n_rows")).drop("n_rows"), partitions=1)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Group rows of equal text: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty. The largest id of a group stays.
    Null ids sort below all others; a group with only null ids keeps its rows' ``keep_id`` null and ``kept`` true.
    Repeated rows with the same id and text are copies of one another and all carry ``kept`` if the id wins.
    An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest")))
    heavy = heavy_digests(digests, support)
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*_stats()), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text.

    The row with the largest id of a group stays; of several such rows, or where a group has null ids only, the one with the
    lowest hash over all columns. Rows that share an id, or have none, are judged each by its own text. Copies of heavy digests
    go map-side; of the others each task keeps the best row of a text, and only these rows move, once. An empty table
    gives an empty result.
    """
    digests = materialise(docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest")))
    heavy = heavy_digests(digests, support).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__heavy"))
    place = F.xxhash64(*[docs[f.name].cast("string") if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema])
    rows = docs.select(_digest(docs[text_col]).alias("__digest"), docs[id_col].alias("__id"), place.alias("__place"), F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    rows = rows.join(F.broadcast(heavy), "__digest", "left").where(F.col("__heavy").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
    # max_by passes over null orderings, hence the flag; -place - 1 reverses the order of the hash without overflow
    best = F.struct(F.col("__id").isNotNull(), "__id", F.bitwise_not("__place"))
    return rows.groupBy("__digest").agg(F.max_by("__row", best).alias("__row")).select("__row.*")
