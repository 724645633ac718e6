"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

A word here is a run of letters, digits or signs. One pass counts all words; the most frequent ones (``MAX_WORDS`` at most) have
a vector of their own, the rarer ones share ``RARE`` vectors by hash. Every word has a sparse random index vector, drawn from its
hash. A second pass over all documents adds to each word's context vector the index vectors of its neighbours, in whole numbers;
the tables of the tasks have a fixed size and are summed in two levels. A document is the mean of its words' centred,
frequency-weighted context vectors. The network is fitted on a bounded sample of labelled rows, its temperature on a part of the
sample that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, crc32_text, fields, hash_place, labelled_sample, map_texts, materialise
from ._words import LOWER, SPACE, U, Words, grouped, mix

#: Words with a vector of their own, the most frequent ones; bounds what goes to the driver and to the tasks.
MAX_WORDS = 16_384
#: Vectors that the other words share by hash.
RARE = 1_024
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 1 << 20
BINS_PER_DOUBLING = 8
DIMS = 64
NONZERO = 4
REACH = 2
#: A table is summed in so many blocks, first over so many tasks, then over all.
BLOCKS = 32
TASKS_AT_ONCE = 64
HIDDEN = 32
BATCH = 2_048
#: At most so many labelled rows are used to fit the network, the same rows in every run (lowest hash of the id).
MAX_TRAIN_ROWS = 20_000

_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the text it is in. Letters fold to lower case; runs of capitals are words of their own."""
    w = Words(texts)
    kind = _KIND[w.data]
    change = np.flatnonzero(np.diff(kind, prepend=255))
    start = change[kind[change] > 0]
    end = np.append(change[1:], len(kind))[kind[change] > 0]
    upper = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    shout = (end - start >= 2) & (upper[end] - upper[start] == end - start)
    w.data = LOWER[w.data]
    return mix(w.hashes(start, end) + shout.astype(U)), np.searchsorted(w.doc_end, start, side="right")


class Vocabulary:
    """Vector numbers of word hashes: the frequent words first, in ascending order, then the shared ones."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.size = len(frequent) + RARE

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        shared = (hashes % U(RARE)).astype(np.int64) + len(self.frequent)
        if not len(self.frequent):
            return shared
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, at, shared)

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and signs of the index vectors, ``(size, NONZERO)`` each."""
        seeds = np.concatenate([self.frequent, np.arange(RARE, dtype=U)])
        drawn = mix(seeds[:, None] * U(2 * NONZERO + 1) + np.arange(1, NONZERO + 1, dtype=U) * U(0x51ED27))
        return (drawn % U(DIMS)).astype(np.int64), np.where(drawn >> U(40) & U(1), 1.0, -1.0)


def vocabulary(docs: DataFrame, max_words: int = MAX_WORDS) -> Vocabulary:
    """The most frequent words of all texts, at most ``max_words``: those above a count, cut where a bin of counts would not fit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, U), np.zeros(0, np.int64)

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            known, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return known, np.bincount(at, np.concatenate([p[1] for p in parts]), len(known)).astype(np.int64)

        def batch_of(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in grouped(texts):
                words, counts = merged([(words, counts), np.unique(tokens(texts[part])[0], return_counts=True)])
                if len(words) > HELD_WORDS:
                    yield batch_of(words, counts)
                    words, counts = words[:0], counts[:0]
        yield batch_of(words, counts)

    found = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = materialise(found.withColumn("bin", F.floor(BINS_PER_DOUBLING * F.log2("n")).cast("int")))
    least, taken = None, 0
    for row in found.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # at most 8 x 63 rows
        taken += row["count"]
        if taken > max_words:
            break
        least = row["bin"]
    rows = [] if least is None else found.where(F.col("bin") >= least).select("word").collect()
    return Vocabulary(np.array([r[0] for r in rows], np.int64).view(U))


def context_table(docs: DataFrame, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word counts and summed context vectors over all texts: fixed size, one row for each vector."""
    width = -(-words.size // BLOCKS)
    kind = "part int, block int, sums binary"

    def batch_of(parts: list[int], blocks: list[int], sums: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], names=["part", "block", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = words.index_vectors()
        total, counts = np.zeros(words.size * DIMS), np.zeros(words.size, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in grouped(texts):
                hashes, doc = tokens(texts[part])
                number = words.numbers(hashes)
                counts += np.bincount(number, minlength=words.size)
                for far in range(1, REACH + 1):
                    near = np.flatnonzero(doc[far:] == doc[:-far])
                    a, b = number[near], number[near + far]
                    for of, by in ((a, b), (b, a)):
                        total += np.bincount((of[:, None] * DIMS + dims[by]).ravel(), signs[by].ravel(), words.size * DIMS)
        if counts.any():
            table = np.concatenate([counts[:, None], total.reshape(words.size, DIMS)], 1).astype(np.int64)
            small = np.int32 if np.abs(table).max() < 2**31 else np.int64
            part = TaskContext.get().partitionId() // TASKS_AT_ONCE
            yield batch_of([part] * BLOCKS, range(BLOCKS), [table[i * width : (i + 1) * width].astype(small).tobytes() for i in range(BLOCKS)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, block, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "sums")), strict=True):
                rows = min(width, words.size - block * width)
                values = np.frombuffer(sums, np.int32 if len(sums) == 4 * rows * (DIMS + 1) else np.int64)
                found[part, block] = found.get((part, block), 0) + values.astype(np.int64)
        if found:
            yield batch_of([p for p, _ in found], [b for _, b in found], [v.tobytes() for v in found.values()])

    first = docs.mapInArrow(partial, kind).repartition("part", "block").mapInArrow(summed, kind)
    last = first.withColumn("part", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(summed, kind)
    table = np.zeros((words.size, DIMS + 1))
    for row in last.collect():
        block = row["block"] * width
        table[block : block + width] = np.frombuffer(row["sums"], np.int64).reshape(-1, DIMS + 1)
    return table[:, 0], table[:, 1:]


def word_vectors(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Unit context vectors without their common part, weighted down for frequent tokens."""
    share = counts / max(1.0, counts.sum())
    mean = sums / np.maximum(counts, 1)[:, None]
    mean = mean - share @ mean
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return (mean / np.maximum(length, 1e-9) * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pool(texts: list[bytes | None], words: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text; zeros without words."""
    hashes, doc = tokens(texts)
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    if len(hashes):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.add.reduceat(vectors[words.numbers(hashes)], first, axis=0, dtype=np.float32) / np.diff(first, append=len(doc))[:, None]
    return out


class Network:
    """Inputs, one hidden layer (rectified), one logit over a temperature; plain numpy, Adam on batches of BATCH rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, steps: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        part = rng.permutation(len(x))
        tune, fit = part[: len(x) // 5], part[len(x) // 5 :]
        z = (x - self.center) / self.scale
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        self.temperature = 1.0
        for t in range(1, steps + 1):
            rows = rng.choice(fit, min(len(fit), BATCH), replace=False)
            h = np.maximum(z[rows] @ self.p[0] + self.p[1], 0)
            q = 1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30)))
            e = (q - y[rows]) / len(rows)
            back = np.outer(e, self.p[2]) * (h > 0)
            grads = [z[rows].T @ back + decay * self.p[0], back.sum(0), h.T @ e + decay * self.p[2], np.array([e.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        logit = self.logit(x[tune])
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, -np.where(y[tune] > 0.5, 1, -1) * logit / t)) for t in grid] if len(tune) else [0.0]
        self.temperature = float(grid[int(np.argmin(loss))]) if len(tune) else 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.center) / self.scale @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_fold: int = 1, max_train_rows: int = MAX_TRAIN_ROWS, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    ``held_out``: crc32 of the id as text leaves ``held_fold`` modulo ``folds``; no label of such a row is used. Null and empty
    texts get the score of a text without words. Without labels of both kinds every score is 0.5. Null ids are not held out;
    rows may repeat an id. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    words = vocabulary(narrow.select("text"), max_words)
    vectors = word_vectors(*context_table(narrow.select("text"), words))

    def pooled(texts: list[bytes | None]) -> dict[str, object]:
        x = pool(texts, words, vectors)
        return {"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * DIMS, pa.int32()), pa.array(x.ravel()))}

    table = materialise(map_texts(narrow, ["doc_id"], {"x": "array<float>"}, pooled))
    fold = crc32_text(F.col("doc_id")) % folds
    known = labelled_sample(table, labels, label_col, max_train_rows, fold != held_fold)
    rows = table.join(F.broadcast(known), "doc_id").orderBy(hash_place("doc_id"), "doc_id", "x").limit(max_train_rows).select("x", "y").toPandas()
    y = rows["y"].to_numpy(float)
    model = Network(np.stack(rows["x"].to_list()).astype(float), y) if len(y) and y.min() < y.max() else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, DIMS).astype(float)
            yield arrow_batch(batch, ["doc_id"], None, {"score": "double"}, {"score": model.probability(x) if model else np.full(len(x), 0.5)})

    scored = table.mapInArrow(score, fields(table, ["doc_id"], {"score": "double"}))
    return scored.select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
