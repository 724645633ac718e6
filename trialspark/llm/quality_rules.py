"""Quality rules: exact base rules plus gradient-boosted trees over document statistics.

One pass over the texts makes a narrow table of statistics; the trees are fitted on a bounded sample of labelled rows and
score that table in Arrow batches. Ids stay in Arrow throughout, so nulls and large ids are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from ._common import arrow_batch, fields, hash_place, labelled_sample, map_texts, materialise, row_key, unused
from ._words import U, Words, mix, repeated

#: At most so many labelled rows are used to fit the trees, the same rows in every run (lowest hash of the id).
MAX_TRAIN_ROWS = 20_000
#: A document is rejected when the trees give less than this probability of good quality.
MIN_PROBABILITY = 0.5
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_bytes", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_high", "n_distinct_words"]
#: Features of the trees and their constraints: -1 means that a larger value never raises the verdict.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "exclaim_share": -1, "digit_share": 0, "high_share": 0, "line_words": 0, "distinct_share": 0}

_SYMBOL, _UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts per text, over whole texts; a null or empty text has zeros."""
    w = Words(texts)
    n, docs = len(texts), np.arange(len(texts))
    salt = mix(docs.astype(U) + U(1))
    hashes = w.word_hashes()

    ends = np.flatnonzero(w.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    filled = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[filled], ends[filled]
    line_doc = np.searchsorted(w.doc_end, starts, side="right")
    _, again = repeated(w.hashes(starts, ends) ^ salt[line_doc])

    at, keys = w.windows(hashes, WINDOW)
    twice, _ = repeated(keys ^ salt[w.doc[at]])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    _, seen = repeated(hashes ^ salt[w.doc])

    per_doc = lambda at_docs: np.bincount(at_docs, minlength=n)
    return {
        "n_words": w.n_words,
        "word_chars": w.sum_by_doc(((w.data & 0xC0) != 0x80) & ~w.space),
        "n_symbols": w.sum_by_doc(_SYMBOL[w.data]),
        "n_dup_lines": per_doc(line_doc[again]),
        "n_repeat_words": per_doc(w.doc[covered]),
        "n_bytes": w.doc_end - w.doc_at - 1,
        "n_lines": per_doc(line_doc),
        "n_upper": w.sum_by_doc(_UPPER[w.data]),
        "n_digits": w.sum_by_doc(_DIGIT[w.data]),
        "n_exclaim": w.sum_by_doc(w.data == 33),
        "n_high": w.sum_by_doc(w.data >= 128),
        "n_distinct_words": w.n_words - per_doc(w.doc[seen]),
    }


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """``doc_id`` and the counts of ``statistics`` (long), one row per row of ``docs``; with ``key``, a string, also ``row_key``."""
    keyed = [] if key is None else [key.alias("row_key")]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *keyed)
    return map_texts(narrow, ["doc_id", *["row_key"] * len(keyed)], dict.fromkeys(BASE + EXTRA, "long"), statistics)


def features(s: Mapping[str, np.ndarray]) -> np.ndarray:
    words, size = np.maximum(s["n_words"], 1), np.maximum(s["n_bytes"], 1)
    lines = np.maximum(s["n_lines"], 1)
    made = [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / size, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / size, s["n_exclaim"] / size, s["n_digits"] / size, s["n_high"] / size, words / lines, s["n_distinct_words"] / words]
    return np.stack([np.asarray(v, float) for v in made], 1)


def fit_rules(stats: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAIN_ROWS) -> boosting.Forest | None:
    """Trees fitted on at most ``max_rows`` labelled rows of those that ``stats`` holds; None when there are no labels of both kinds."""
    known = labelled_sample(stats, labels, "quality", max_rows)
    rows = stats.join(F.broadcast(known), "doc_id").orderBy(hash_place("doc_id"), "doc_id", *BASE, *EXTRA).limit(max_rows).toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    monotone = {i: v for i, v in enumerate(FEATURES.values()) if v}
    return boosting.fit(features(rows), y, monotone=monotone)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, max_train_rows: int = MAX_TRAIN_ROWS, key: Column | None = None) -> DataFrame:
    """Verdict per row: ``doc_id``, the five base counts, ``base_failed``, ``kept``, ``probability``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. ``kept`` is false
    for these, else the trees' verdict; without labels of both kinds only the base rules decide (probability null).
    Null and empty texts have zero counts and fail. Null and repeated ids give a row each. An empty table gives an empty
    result. With ``key``, a string column of ``docs``, each row also has it as ``row_key``.
    """
    passed = ["doc_id", *BASE, *([] if key is None else ["row_key"])]
    made = {"base_failed": "boolean", "kept": "boolean", "probability": "double"}
    stats = materialise(document_statistics(docs, id_col=id_col, text_col=text_col, key=key))
    forest = fit_rules(stats, labels, max_rows=max_train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {c: batch.column(c).to_numpy() for c in BASE + EXTRA}
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            p = forest.probability(features(s)) if forest else None
            good = p >= min_probability if forest else True
            yield arrow_batch(batch, passed, None, made, {"base_failed": failed, "kept": ~failed & good, "probability": [None] * batch.num_rows if p is None else p})

    return stats.mapInArrow(score, fields(stats, passed, made))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own verdict is ``kept``, as often as they occur.

    The verdict depends on the text only. Rows are joined to it by id and text digest together, so rows that have no id, or
    share one, are judged each by its own text.
    """
    key = row_key(docs, id_col, text_col)
    kept = quality_rules(docs, labels, id_col=id_col, text_col=text_col, key=key).where("kept")
    own = unused("__key", docs.columns)
    return docs.join(kept.select(F.col("row_key").alias(own)), key == F.col(own), "left_semi")
