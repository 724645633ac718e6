"""Toxicity by a subsequence string kernel: a support vector machine on Nystroem landmarks, collapsed to a table of weights.

A unit is a word reduced to its letters (signs inside it dropped, a few digits read as letters, letters spelled out with spaces
joined) between two marks. Its features are the subsequences of four letters within a span of five, and those with one letter
inserted after each, weighted down by their gaps, so an inserted or missing letter changes few of them. The kernel of two
units is the product of their features over their lengths.

Labels mark documents, so labelled sentences are made first, in a bounded sample of labelled documents: all sentences of other
documents are clean, a sentence of a toxic document is insulting if it holds a unit that is found nearly only in toxic documents
(other sentences of such documents stay without a label). A sentence is as bad as its worst unit, its witness. The machine is
fitted on the sentences by their witnesses, each weighed by its sentences: first the marking units against a spread of clean ones,
then, with that fit, the worst unit of each labelled sentence. Landmarks are chosen by pivoted Cholesky; the machine is linear in
the landmark features and hence in the subsequences, so scoring a text is a sum of table entries, unit by unit. A document
scores as its worst sentence, calibrated on the same sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, crc32_text, fields, labelled_sample, map_texts, materialise
from ._words import Words, grouped


@dataclass(frozen=True)
class ToxicParams:
    """Bounds of the fit; scoring covers all texts whatever they are.

    At most ``max_train_rows`` labelled documents (lowest hash of the id) are cut into sentences. Of their units at most
    ``max_insults`` that mark or witness insulting sentences and ``max_clean`` of clean ones (half of them spread by hash, a quarter the
    most frequent, a quarter the worst) are fitted, on ``landmarks`` chosen among the first ``pool`` of either kind. A marking unit
    stands in at least ``min_toxic_docs`` toxic documents, which are ``min_toxic_share`` of the documents that have it.
    """

    max_train_rows: int = 20_000
    max_insults: int = 2_000
    max_clean: int = 20_000
    landmarks: int = 320
    pool: int = 800
    min_toxic_docs: int = 5
    min_toxic_share: float = 0.9


GAP = 0.6
#: Distances of the later letters from the first, and the weight of each such subsequence.
STEPS = [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4), (2, 4, 6)]
WEIGHTS = [GAP ** (last - 3) for *_, last in STEPS]
LETTERS = 32
BEGIN, END = 28, 29
#: A sentence ends at a line's end or at white space after a full stop, an exclamation or a question mark.
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|[\n\r]+")

_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[0xC2:0xF5] = 27  # one code for a letter beyond ASCII, its further bytes are dropped
for _digit, _letter in zip(b"013457@", b"oieasta", strict=True):
    _CODE[_digit] = _letter - 96


@dataclass
class Units:
    code: np.ndarray  # letters of all units
    unit: np.ndarray  # unit of each letter
    begin: np.ndarray  # first letter of each unit
    size: np.ndarray  # letters of each unit
    doc: np.ndarray  # text of each unit


def units(texts: list[bytes | None]) -> Units:
    w = Words(texts)
    code = _CODE[w.data]
    word = np.cumsum(np.diff(w.space.astype(np.int8), prepend=1) == -1) - 1
    keep = np.flatnonzero((code > 0) & ~w.space)
    code, word = code[keep], word[keep]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(first, append=len(word))
    doc = w.doc[word[first]] if len(first) else np.zeros(0, np.int64)
    alone = size == 1
    joined = np.zeros(len(first), bool)
    joined[1:] = alone[1:] & alone[:-1] & (doc[1:] == doc[:-1]) & (np.diff(word[first]) == 1)
    begin = first[~joined]
    unit = np.repeat(np.cumsum(~joined) - 1, size)
    marks, stop = np.arange(len(begin)), np.append(begin[1:], len(code))
    code = np.insert(code, np.concatenate([stop, begin]), np.repeat([END, BEGIN], len(begin)))
    unit = np.insert(unit, np.concatenate([stop, begin]), np.concatenate([marks, marks]))
    begin = begin + 2 * marks
    return Units(code, unit, begin, np.diff(begin, append=len(code)), doc[~joined])


def subsequences(u: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of steps: first letters, subsequence numbers, weight."""
    n = len(u.code)
    for (i, j, k), weight in zip(STEPS, WEIGHTS, strict=True):
        at = np.flatnonzero(u.unit[: n - k] == u.unit[k:]) if n > k else np.zeros(0, np.int64)
        yield at, ((u.code[at] * LETTERS + u.code[at + i]) * LETTERS + u.code[at + j]) * LETTERS + u.code[at + k], weight


def _norm(size: np.ndarray) -> np.ndarray:
    """Length of a unit's feature vector, repeated subsequences aside."""
    total = np.zeros(len(size))
    for (*_, k), weight in zip(STEPS, WEIGHTS, strict=True):
        total += np.maximum(size - k, 0) * weight * weight
    return np.sqrt(np.maximum(total, 1.0))


def sparse_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, subsequence number and normalised weight of every feature of some units."""
    u = units([w.encode() for w in words])
    norm = _norm(u.size)
    parts = [(u.unit[at], number, weight / norm[u.unit[at]]) for at, number, weight in subsequences(u)]
    row, number, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return u.doc[row], number, weight


def dense(words: list[str], numbers: np.ndarray) -> np.ndarray:
    """Features of units in the columns of the sorted ``numbers``; other features are left out."""
    row, number, weight = sparse_features(words)
    column = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
    hit = numbers[column] == number
    flat = np.bincount(row[hit] * len(numbers) + column[hit], weight[hit], len(words) * len(numbers))
    return flat.reshape(len(words), -1).astype(np.float32)


def landmarks(words: list[str], count: int) -> list[str]:
    """Pivoted Cholesky: each pivot is the unit worst covered by those before."""
    wide = dense(words, np.unique(sparse_features(words)[1]))
    kernel = (wide @ wide.T).astype(float)
    rest, rows, chosen = np.diag(kernel).copy(), np.zeros((count, len(kernel))), []
    for i in range(min(count, len(kernel))):
        at = int(np.argmax(rest))
        if rest[at] < 1e-6:
            break
        rows[i] = (kernel[at] - rows[:i].T @ rows[:i, at]) / np.sqrt(rest[at])
        rest = rest - rows[i] ** 2
        chosen.append(words[at])
    return chosen


def fit_weights(found_in: dict[str, int], positive: list[str], negative: list[str], *, count: int, pool: int, reg: float = 1e-6) -> tuple[np.ndarray, float]:
    """A weight for every subsequence and a bias: squared hinge loss over Nystroem features, by Newton steps.

    ``found_in`` has the number of labelled sentences of each unit; a unit weighs as the root of it.
    Half of the landmarks are chosen among the positive units, half among the negative ones (the first ``pool`` of each; the
    very first negatives, the hardest, are all landmarks).
    """
    first = negative[: count // 5]
    chosen = landmarks(positive[:pool], count // 2) + first + landmarks(negative[len(first) : pool], count // 2 - len(first))
    numbers = np.unique(sparse_features(chosen)[1])
    z = dense(chosen, numbers)
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-4)) @ vector.T
    x = np.concatenate([dense(words[i : i + 1000], numbers) @ z.T for words in (positive, negative) for i in range(0, len(words), 1000)]) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    share = np.sqrt([float(found_in.get(w, 1)) for w in positive + negative])
    share = share * np.where(y > 0, 0.2 / share[y > 0].sum(), 0.8 / share[y < 0].sum())
    ridge = np.append(np.full(x.shape[1] - 1, reg), 0.0)
    v = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ v) < 1
        inside = x[active] * share[active, None]
        new = np.linalg.solve(inside.T @ x[active] + np.diag(ridge + 1e-9), inside.T @ y[active])
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    weights = np.zeros(LETTERS**4, np.float32)
    weights[numbers] = z.T @ (root @ v[:-1])
    return weights, float(v[-1])


def worst_units(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each text's worst unit; the bias alone when it has none."""
    u = units(texts)
    out = np.full(len(texts), -5.0)
    if len(u.begin):
        each = np.zeros(len(u.code), np.float32)
        for at, number, weight in subsequences(u):
            each[at] += weight * weights[number]
        value = np.add.reduceat(each, u.begin) / _norm(u.size) + bias
        first = np.flatnonzero(np.diff(u.doc, prepend=-1))
        out[u.doc[first]] = np.maximum.reduceat(value, first)
    return out


def sentences(text: bytes | None) -> list[bytes]:
    return [s for s in _SENTENCE.split(text or b"") if s]


def _sentence_units(train: DataFrame) -> DataFrame:
    """``doc_id, y, words``: the distinct units of more than two letters of each sentence, with the label of its document."""
    made = {"words": "array<string>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in grouped(texts):
                cut = [(k, s) for k, text in enumerate(texts[part], part.start) for s in sentences(text)]
                u = units([s for _, s in cut])
                letters = (u.code + 96).astype(np.uint8).tobytes().decode("ascii").replace("{", "é")
                words: list[dict[str, None]] = [{} for _ in cut]
                for d, a, n in zip(u.doc.tolist(), u.begin.tolist(), u.size.tolist(), strict=True):
                    if n > 4:
                        words[d][letters[a + 1 : a + n - 1]] = None
                yield arrow_batch(batch, ["doc_id", "y"], [k for k, _ in cut], made, {"words": [list(w) for w in words]})

    return train.mapInArrow(run, fields(train, ["doc_id", "y"], made))


def _witnesses(labelled: DataFrame, marks: frozenset[str], weights: np.ndarray, bias: float) -> DataFrame:
    """``word, value, insulting, clean``: the worst units of the labelled sentences and how many sentences of each kind they stand for."""
    made = {"word": "string", "value": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, picked, values = [], [], []
            ys, lists = batch.column("y").to_pylist(), batch.column("words").to_pylist()
            known = list({w for words in lists for w in words})
            value = dict(zip(known, worst_units([w.encode() for w in known], weights, bias).tolist(), strict=True))
            for k, (y, words) in enumerate(zip(ys, lists, strict=True)):
                if words and (not y or not marks.isdisjoint(words)):
                    rows.append(k)
                    picked.append(max(words, key=lambda w: (value[w], w)))
                    values.append(value[picked[-1]])
            yield arrow_batch(batch, ["y"], rows, made, {"word": picked, "value": values})

    found = labelled.mapInArrow(run, fields(labelled, ["y"], made))
    return found.groupBy("word").agg(F.max("value").alias("value"), F.count_if(F.col("y") == 1).alias("insulting"), F.count_if(F.col("y") == 0).alias("clean"))


def fit_sentences(train: DataFrame, p: ToxicParams) -> tuple[np.ndarray, float] | None:
    """Weights and bias fitted on the sentences of ``train(doc_id, text, y)``; None without sentences of both kinds."""
    labelled = materialise(_sentence_units(train))
    per_doc = labelled.select("doc_id", "y", F.explode("words").alias("word")).groupBy("word", "doc_id").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("n"))
    counted = per_doc.groupBy("word").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("insulting"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    counted = materialise(counted)
    found_in: dict[str, int] = {}

    def listed(words: DataFrame, count: str) -> list[str]:
        rows = words.select("word", F.greatest(count, F.lit(1)).alias("n")).collect()
        found_in.update((r["word"], r["n"]) for r in rows)
        return [r["word"] for r in rows]

    marking = (F.col("toxic") >= p.min_toxic_docs) & (F.col("toxic") >= p.min_toxic_share * F.col("docs"))
    marks = listed(counted.where(marking).orderBy(F.desc("toxic"), "word").limit(p.max_insults), "insulting")
    plain = counted.where("toxic <= 0.3 * docs")
    common = plain.orderBy(F.desc("docs"), "word").limit(p.max_clean // 4)
    spread = plain.orderBy(F.xxhash64("word"), "word").limit(p.max_clean // 2)
    negative = listed(common.unionByName(spread).distinct().orderBy(F.xxhash64("word"), "word"), "clean")
    if not marks or not negative:
        return None
    bounds = {"count": p.landmarks, "pool": p.pool}
    worst = materialise(_witnesses(labelled, frozenset(marks), *fit_weights(found_in, marks, negative, **bounds)))
    insults = worst.where(F.col("insulting") >= p.min_toxic_share * (F.col("insulting") + F.col("clean")))
    positive = listed(insults.orderBy(F.desc("insulting"), "word").limit(p.max_insults), "insulting")
    # the worst units of clean sentences stand in front of the other negatives
    clean = worst.where("clean > insulting").join(plain.select("word"), "word", "left_semi")
    hard = listed(clean.orderBy(F.desc("value"), "word").limit(p.max_clean // 4), "clean")
    return fit_weights(found_in, list(dict.fromkeys(positive + marks)), [w for w in dict.fromkeys(hard + negative)], **bounds)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, params: ToxicParams = ToxicParams()) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    ``held_out``: crc32 of the id as text leaves ``held_fold`` modulo ``folds``; no label of such a row is used. Null and empty
    texts have the lowest score. Without insulting sentences in the sample every score is 0. Null ids are not held out; rows
    may repeat an id. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    fold = crc32_text(F.col("doc_id")) % folds
    # the sample has at most max_train_rows ids, which bounds the broadcast
    sample = labelled_sample(narrow, labels, label_col, params.max_train_rows, fold != held_fold)
    train = materialise(narrow.join(F.broadcast(sample), "doc_id"))
    fitted = fit_sentences(train, params)
    weights, bias = fitted or (np.zeros(LETTERS**4, np.float32), -1.0)
    slope, shift = _calibrate(train, weights, bias, params.max_train_rows) if fitted else (1.0, -30.0)

    def score(texts: list[bytes | None]) -> dict[str, object]:
        return {"score": 1 / (1 + np.exp(-np.clip(slope * worst_units(texts, weights, bias) + shift, -30, 30)))}

    scored = map_texts(narrow, ["doc_id"], {"score": "double"}, score)
    return scored.select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _calibrate(train: DataFrame, weights: np.ndarray, bias: float, max_rows: int) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the worst units of the sample."""

    values = map_texts(train, ["y"], {"value": "double"}, lambda texts: {"value": worst_units(texts, weights, bias)})
    rows = values.limit(max_rows).toPandas()
    x, y = np.clip(rows["value"].to_numpy(), -5, 5), rows["y"].to_numpy(float)
    a, b = 2.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + 1e-2 * a, (p - y).sum()])
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        size = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - size * step[0], b - size * step[1]
    return float(a), float(b)
