"""Token counts of whole texts for a byte-level BPE vocabulary, huge documents by overlap resynchronisation.

Documents up to ``chunk_chars`` are counted in one piece. A longer one is cut into overlapping chunks that are encoded by
different tasks with offsets; neighbours are spliced at a token boundary that both encodings have and that is proven stable,
that is, a boundary whatever stands around it. Where the overlap at a cut holds none, it is widened fourfold and the document
goes through another round; an overlap that would reach half a chunk makes the two chunks one. So every document ends spliced,
at worst as one piece.

Why a place is stable: the pre-tokenizer cuts text into runs of white space (S), letters (L), numbers (N) and others (O), a
single leading space and the contractions ('s, 't, ...) excepted. Where the class changes from L, N or O, no match can span
the change unless an apostrophe stands before it, and matching from there on looks only to the right. Places inside the
string of an added token are no places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_batch, fields, materialise
from ._memo import Memo, bpe_library

#: Longer texts are cut into chunks of so many characters.
CHUNK_CHARS = 65_536
#: First half-width of the overlap at a cut; quadrupled while it holds no common stable boundary.
OVERLAP_CHARS = 256
#: Context limit of the model that ``over_limit`` reports.
LIMIT_TOKENS = 1024

_UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: White space other than the six bytes: a cut after one is not safe, such texts are encoded in one piece.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: A stable place stands between the two parts: a change of class after a letter, number or other (no apostrophe).
_PLACE = regex.compile(r"(?:(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}]))(?=.)", regex.DOTALL)
_MARGIN = 64  # characters at a slice's edge whose surroundings may be cut off; longer than any added token


@lru_cache(maxsize=4)
def _specials(path: str) -> regex.Pattern | None:
    found = [t.content for t in bpe_library(path).get_added_tokens_decoder().values()]
    return regex.compile("|".join(map(regex.escape, found))) if found else None


def stable_places(text: str, path: str, lo: int, hi: int) -> list[int]:
    """Stable places ``p`` with ``lo <= p < hi`` in ``text`` (``p`` begins a token in every encoding that covers it)."""
    inside = set()
    if pattern := _specials(path):
        for m in pattern.finditer(text, max(0, lo - _MARGIN), min(len(text), hi + _MARGIN)):
            inside.update(range(m.start() + 1, m.end()))
    return [p for m in _PLACE.finditer(text, lo, hi) if lo <= (p := m.start()) < hi and p not in inside]


def cut_points(length: int, chunk_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Cuts of a long text, evenly spaced, and the half-width of the overlap at each."""
    chunks = -(-length // chunk_chars)
    return [(k * length // chunks, min(overlap, chunk_chars // 4)) for k in range(1, chunks)]


def widened(cuts: list[tuple[int, int]], failed: list[int], chunk_chars: int) -> list[tuple[int, int]]:
    """The cuts for another round: failed ones four times as wide, those left out that would then reach half a chunk."""
    wider = [(at, half * 4 if k in failed else half) for k, (at, half) in enumerate(cuts)]
    return [(at, half) for k, (at, half) in enumerate(wider) if k not in failed or half < chunk_chars // 2]


@lru_cache(maxsize=4)
def _counter(path: str) -> Memo:
    library = bpe_library(path)
    return Memo(lambda units: [len(e) for e in library.encode_batch_fast(units, add_special_tokens=False)])


def count_tokens(text: str, path: str) -> int:
    """Tokens of one text as the library gives them."""
    if _ODD_SPACE.search(text):
        return len(bpe_library(path).encode(text, add_special_tokens=False))
    return sum(_counter(path).lookup(_UNIT.findall(text)))


def chunk_boundaries(text: str, path: str, zones: list[tuple[int, int]]) -> tuple[int, list[list[int]], list[list[int]]]:
    """Encode a slice with offsets: its token count, and for each zone the stable token starts and the tokens before them."""
    starts = [a for a, _ in bpe_library(path).encode(text, add_special_tokens=False).offsets]
    known, places, before = set(starts), [], []
    for lo, hi in zones:
        found = [p for p in stable_places(text, path, lo, hi) if p in known] if hi > lo else []
        places.append(found)
        before.append([bisect_left(starts, p) for p in found])
    return len(starts), places, before


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit_tokens: int = LIMIT_TOKENS, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per row of ``docs``; null text counts as empty.

    ``path`` is a tokenizers JSON file of the byte-level BPE kind that every worker can read. Rows may repeat or have null
    ids; each is counted by itself. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    passed = ["doc_id", "n_bytes", "row", "text"]
    made = {"n_bytes": "long", "row": "string", "n_tokens": "long", "text": "string"}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            long = [len(t) > chunk_chars for t in texts]
            values = {
                "n_bytes": [len(t.encode()) for t in texts],
                "row": [f"{part}-{n + k}" for k in range(len(texts))],
                "n_tokens": [None if g else count_tokens(t, path) for t, g in zip(texts, long, strict=True)],
                "text": [t if g else None for t, g in zip(texts, long, strict=True)],
            }
            n += len(texts)
            yield arrow_batch(batch, ["doc_id"], None, made, values)

    counted = materialise(narrow.mapInArrow(first, fields(narrow, ["doc_id"], made)))
    done = [counted.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens")]
    plan = {"ats": "array<long>", "halves": "array<long>"}

    def plan_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [cut_points(len(t), chunk_chars, overlap) for t in batch.column("text").to_pylist()]
            yield arrow_batch(batch, passed, None, plan, {"ats": [[a for a, _ in c] for c in cuts], "halves": [[h for _, h in c] for c in cuts]})

    def plan_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [widened(list(zip(a, h, strict=True)), f, chunk_chars) for a, h, f in zip(*(batch.column(c).to_pylist() for c in ("ats", "halves", "failed")), strict=True)]
            yield arrow_batch(batch, passed, None, plan, {"ats": [[a for a, _ in c] for c in cuts], "halves": [[h for _, h in c] for c in cuts]})

    giants = counted.where("n_tokens IS NULL").select(*passed)
    giants = materialise(giants.mapInArrow(plan_first, fields(giants, passed, plan)))
    while not giants.isEmpty():
        spliced = materialise(_splice(giants, path))
        done.append(giants.join(spliced.where("n_tokens IS NOT NULL"), "row").select("doc_id", "n_bytes", "n_tokens"))
        again = giants.join(spliced.where("n_tokens IS NULL").drop("n_tokens"), "row")
        giants = materialise(again.mapInArrow(plan_again, fields(giants, passed, plan)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("over_limit", F.col("n_tokens") > limit_tokens)


def _splice(giants: DataFrame, path: str) -> DataFrame:
    """``row, n_tokens, failed`` of each text cut as planned: its tokens, or null and the cuts that found no common boundary."""
    sliced = {"chunk": "int", "chunks": "int", "slice": "string", "offset": "long", "left": "array<long>", "right": "array<long>"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, ats, halves = (batch.column(c)[k].as_py() for c in ("text", "ats", "halves"))
                edges, values = [(0, 0), *zip(ats, halves, strict=True), (len(text), 0)], {c: [] for c in sliced}
                for n, ((a, left), (b, right)) in enumerate(zip(edges, edges[1:], strict=False)):
                    # a margin on both sides of the overlaps, so that a place's surroundings are whole
                    lo, hi = max(0, a - left - _MARGIN), min(len(text), b + right + _MARGIN)
                    zones = [max(a - left, 0) - lo, a + left - lo] if n else None, [b - right - lo, min(b + right, len(text)) - lo] if b < len(text) else None
                    for c, v in zip(sliced, (n, len(edges) - 1, text[lo:hi], lo, *zones), strict=True):
                        values[c].append(v)
                yield arrow_batch(batch, ["row"], [k] * len(values["chunk"]), sliced, values)

    found = {"total": "long", "left_at": "array<long>", "left_before": "array<long>", "right_at": "array<long>", "right_before": "array<long>"}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: [] for c in found}
            for r in batch.select(["slice", "offset", "left", "right"]).to_pylist():
                total, places, before = chunk_boundaries(r["slice"], path, [tuple(r[c] or (0, 0)) for c in ("left", "right")])
                at = [[p + r["offset"] for p in side] for side in places]
                for c, v in zip(found, (total, at[0], before[0], at[1], before[1]), strict=True):
                    values[c].append(v)
            yield arrow_batch(batch, ["row", "chunk", "chunks"], None, found, values)

    slices = giants.select("row", "text", "ats", "halves")
    slices = slices.mapInArrow(cut, fields(slices, ["row"], sliced))
    chunks = slices.repartition("row", "chunk").mapInArrow(encode, fields(slices, ["row", "chunk", "chunks"], found))
    order = Window.partitionBy("row").orderBy("chunk")
    joined = chunks.withColumn("cut", F.array_min(F.array_intersect("right_at", F.lead("left_at").over(order))))
    joined = joined.withColumn("cut_before", F.lag("cut").over(order))
    last = F.col("chunk") == F.col("chunks") - 1
    ends = F.when(last, F.col("total")).otherwise(F.try_element_at(F.map_from_arrays("right_at", "right_before"), F.col("cut")))
    begins = F.when(F.col("chunk") == 0, 0).otherwise(F.try_element_at(F.map_from_arrays("left_at", "left_before"), F.col("cut_before")))
    failed = F.sort_array(F.collect_list(F.when(~last & F.col("cut").isNull(), F.col("chunk")))).alias("failed")
    out = joined.withColumn("__tokens", ends - begins).groupBy("row").agg(F.sum("__tokens").alias("n_tokens"), failed)
    return out.withColumn("n_tokens", F.when(F.size("failed") == 0, F.col("n_tokens")))
