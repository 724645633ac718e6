"""Hard negatives of anchor vectors by exact integer scores, multiplied in a residue number system.

1. Components become whole numbers; the table is written once, so that every row keeps its number.
2. Anchors are dealt to groups and rows to parts, both of bounded size, and each (group, part) is one task's block: two matrices.
   A block is multiplied modulo a few small primes. Residues are centred and primes are small enough that every float32 product of
   a block of columns is exact; mixed-radix digits (Chinese remainders) give back the signed score. The number of primes follows
   from the largest norm, so no score can wrap around.
3. First pass: each block keeps the best rows of its anchors' own labels, a window the best of all parts. Second pass: each block
   keeps, for every positive, the best rows of other labels inside its band; a window ranks those of all parts.
Scores never leave their block; what does is bounded by anchors x parts x the numbers asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Components of a part's matrix, at most about; a group of anchors has half of them.
PART_CELLS = 1 << 23
#: Scores worked on at once.
TILE_CELLS = 1 << 22
#: Columns multiplied in one float32 product, at most.
INNER = 1024
#: Quantised components must be below this.
MOST_COMPONENT = 1 << 31

_FLOAT_EXACT = 1 << 24
_LEAST = np.iinfo(np.int64).min


def moduli(bound: int, dims: int) -> list[int]:
    """Primes whose product exceeds four times ``bound``, small enough for exact float32 products of ``dims`` (at most INNER) columns."""
    top = min(4096, 2 * isqrt(_FLOAT_EXACT // max(1, min(dims, INNER))) + 1)
    primes, product = [], 1
    for p in range(top, 2, -1):
        if product > 4 * bound:
            break
        if all(p % q for q in range(2, isqrt(p) + 1)):
            primes.append(p)
            product *= p
    if product <= 4 * bound:
        raise ValueError(f"scores of up to {bound} are out of range")
    return primes


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` less the nearest multiple of ``p``: whole float32 numbers of at most 2^24 stay exact."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, centred, in float32."""
    return [((matrix + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact signed products ``left right'`` in int64 from the residues of both."""
    digits: list[np.ndarray] = []
    for k, (p, a, b) in enumerate(zip(primes, left, right, strict=True)):
        t = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, a.shape[1], INNER):
            t = _reduced(t + _reduced(a[:, at : at + INNER] @ b[:, at : at + INNER].T, p), p)
        for q, c in zip(primes[:k], digits, strict=False):
            inverse = (pow(q, -1, p) + p // 2) % p - p // 2
            t = _reduced(_reduced(t - c, p) * np.float32(inverse), p)
        digits.append(t)
    out = digits[-1].astype(np.int64)
    for p, c in zip(primes[-2::-1], digits[-2::-1], strict=True):
        out = out * p + c.astype(np.int64)
    return out


def ordered(scores: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]:
    """Each row of ``scores`` as ascending keys, those marked ``out`` at the smallest key; the first key of a score; a key's column.

    Keys order by score, then from the last column to the first. Scores too large for that are numbered first.
    """
    wide, names = scores.shape[1], None
    if scores.size and max(int(scores.max()), -int(scores.min())) >= 2**61 // wide:
        names, scores = np.unique(scores, return_inverse=True)
        scores = scores.reshape(out.shape)
    keys = scores * wide + np.arange(wide - 1, -1, -1)
    keys[out] = _LEAST
    keys.sort(axis=1)
    first = lambda s: (s if names is None else np.searchsorted(names, s)) * wide
    return keys, first, lambda k: wide - 1 - k % wide


class _Block:
    """One side of a block: rows in the order of their ids (null last), vectors filled up with zeros to ``dims``."""

    def __init__(self, rows: pa.Table, dims: int, primes: list[int]):
        self.rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")]).combine_chunks()
        vectors = self.rows["vector"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(sizes), dims), np.int64)
        matrix[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy()
        self.residues = residues(matrix, primes)
        self.row, self.label = (self.rows[c].to_numpy() for c in ("row", "label"))

    def __len__(self) -> int:
        return len(self.row)

    def some(self, at: np.ndarray | slice) -> list[np.ndarray]:
        return [r[at] for r in self.residues]


def _tiles(anchors: int, rows: int) -> list[slice]:
    step = max(1, TILE_CELLS // max(1, rows))
    return [slice(a, a + step) for a in range(0, anchors, step)]


def _made(anchors: _Block, rows: _Block, at: list[int], columns: list[int], values: dict[str, list[int]]) -> pa.Table:
    """``anchor_row, anchor_id``, the values and the ``vec_id`` of the rows that stand in ``columns``."""
    taken, found = anchors.rows.take(pa.array(at, pa.int64())), rows.rows.take(pa.array(columns, pa.int64()))
    made = {"anchor_row": taken["row"], "anchor_id": taken["vec_id"]} | {k: pa.array(v, pa.int64()) for k, v in values.items()}
    return pa.table(made | {"vec_id": found["vec_id"]})


def _whole(left: pa.Table, right: pa.Table, *values: str) -> pa.Table | None:
    """None, or no rows if one side of a block is empty (Spark gives that side its keys only)."""
    if len(left) and len(right):
        return None
    kind = (left if len(left) else right).schema.field("vec_id").type
    return pa.schema([("anchor_row", pa.int64()), ("anchor_id", kind), *((v, pa.int64()) for v in values), ("vec_id", kind)]).empty_table()


def _positives(dims: int, primes: list[int], most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if (none := _whole(left, right, "score")) is not None:
            return none
        anchors, rows = _Block(left, dims, primes), _Block(right, dims, primes)
        at, columns, scores = [], [], []
        for label in np.intersect1d(anchors.label, rows.label):
            mine, same = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
            for tile in _tiles(len(mine), len(same)):
                got = products(anchors.some(mine[tile]), rows.some(same), primes)
                keys, _, column = ordered(got, anchors.row[mine[tile]][:, None] == rows.row[same])
                best = keys[:, -most:]
                which, _ = np.nonzero(best > _LEAST)
                found = column(best[best > _LEAST])
                at += mine[tile][which].tolist()
                columns += same[found].tolist()
                scores += got[which, found].tolist()
        return _made(anchors, rows, at, columns, {"score": scores})

    return work


def _negatives(dims: int, primes: list[int], most: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if (none := _whole(left, right, "place", "score")) is not None:
            return none
        anchors, rows = _Block(left, dims, primes), _Block(right, dims, primes)
        positives = anchors.rows["positives"].to_pylist()
        at, columns, place, scores = [], [], [], []
        for tile in _tiles(len(anchors), len(rows)):
            got = products(anchors.some(tile), rows.residues, primes)
            keys, first, column = ordered(got, anchors.label[tile][:, None] == rows.label)
            for k, own in enumerate(keys):
                for n, p in enumerate(positives[tile.start + k]):
                    # whole scores s with low * p <= 100 * s <= high * p
                    least, above = first(np.array([-(-low * p["score"] // 100), high * p["score"] // 100 + 1]))
                    end = int(np.searchsorted(own, above))
                    best = own[max(0, end - most) : end]
                    found = column(best[best >= max(least, _LEAST + 1)])
                    at += [tile.start + k] * len(found)
                    place += [n] * len(found)
                    columns += found.tolist()
                    scores += got[k, found].tolist()
        return _made(anchors, rows, at, columns, {"place": place, "score": scores})

    return work


def _best(candidates: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label, a null vector or a null or non-finite component take no part. A component x becomes
    floor(``scale`` x). Anchors are the rows where ``anchor`` (a condition on ``rows``) holds. Positives are an anchor's first
    ``n_positives`` other rows of its label by score, negatives of each the first ``n_negatives`` rows of other labels with
    ``low`` * positive <= 100 * score <= ``high`` * positive. Higher scores come first, ties by smaller id, null ids last.
    Repeated rows are rows of their own: one is another's positive, and each repeated anchor gives its own rows. Shorter vectors
    count as filled up with zeros, empty ones score 0. An empty table, or no anchors, gives an empty result. Components
    beyond 2^31 after scaling, or norms whose products need more than 62 bits, raise ValueError. Other columns are ignored.
    """
    finite = F.forall(rows[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(rows[vector_col], lambda x: F.floor(x.cast("double") * scale))
    own = rows.select(
        F.monotonically_increasing_id().alias("row"), rows[id_col].alias("vec_id"), rows[label_col].cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled.alias("vector"),
        (rows[label_col].isNotNull() & rows[vector_col].isNotNull() & F.coalesce(finite, F.lit(False))).alias("part"),
    )
    own = materialise(own.where("part").drop("part"))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = F.greatest(F.abs(F.coalesce(F.array_max("vector"), F.lit(0))), F.abs(F.coalesce(F.array_min("vector"), F.lit(0))))
    n, n_anchors, dims, norm, component = own.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector")), F.max(squares), F.max(largest)).first()
    if (component or 0) >= MOST_COMPONENT:
        raise ValueError(f"a component of {component} after scaling is too large")
    dims, bound = max(1, dims or 0), int((norm or 0.0) * (1 + 1e-9)) + 1
    if bound >= 1 << 60:
        raise ValueError(f"scores of up to {bound} are out of range")
    primes = moduli(bound, dims)

    own = own.withColumn("vector", F.col("vector").cast("array<int>"))
    part_rows = max(1, PART_CELLS // dims)
    groups = max(1, -(-2 * n_anchors // part_rows))
    parts = max(-(-n // part_rows), int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = lambda count, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count)).cast("int")
    dealt = own.withColumn("part", place(parts, 1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("anchor").groupBy("group", "part")
    # columns of their own: cogroup mixes up sides that share them
    some = own.where("anchor").withColumn("group", place(groups, 2)).select(*[F.col(c).alias(c) for c in ("row", "vec_id", "label", "vector", "group")])
    blocks = lambda left: left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("group", "part").cogroup(dealt)
    kind = own.schema["vec_id"].dataType.simpleString()

    near = blocks(some).applyInArrow(_positives(dims, primes, n_positives), f"anchor_row long, anchor_id {kind}, score long, vec_id {kind}")
    listed = _best(near, ["anchor_row"], n_positives).where("score >= 0")  # no score lies in the band of a negative one
    listed = listed.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda p: F.struct(p["score"].alias("score"), p["vec_id"].alias("vec_id"))).alias("positives"))
    some = materialise(some.join(listed, "row"))

    far = blocks(some).applyInArrow(_negatives(dims, primes, n_negatives, low, high), f"anchor_row long, anchor_id {kind}, place long, score long, vec_id {kind}")
    ranked = _best(far, ["anchor_row", "place"], n_negatives).join(some.select(F.col("row").alias("anchor_row"), "positives"), "anchor_row")
    positive = F.get("positives", F.col("place").cast("int"))
    return ranked.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))

