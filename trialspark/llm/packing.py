"""Best-fit packing of tokenised documents into sequences of fixed length, in bulk-synchronous rounds.

A document's ids are cut into pieces; full pieces are sequences of their own, so at most one piece a document is left to pack.
One round:

1. Open as many empty sequences as the pieces that fit no open one need at least (by their total, and by how many of them can
   share a sequence), or as the total of all pieces needs beyond the room there is. So no sequence is opened that is not needed.
2. Range-sort pieces and rooms by size, pieces first at equal size. In this order a room takes the largest free piece below it,
   which is best fit in decreasing order with one piece a room: pieces and rooms match like brackets. Each range is swept by
   itself; what is left over in a range is numbered from its end, and a sweep over the ranges' counts says which numbers match
   across ranges.
3. Subtract what was placed from the rooms, write both tables, repeat with the pieces that are left.

A room that could hold several of the largest piece counts as several rooms of equal size, never more than there are pieces for,
so small pieces don't need a round each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_batch, fields, materialise
from ._memo import Memo, bpe_library
from ._words import SPACE, grouped
from .token_files import _gathered

#: Tokens of a sequence.
CAPACITY = 1024
#: Id appended to each document.
END_ID = 2
#: Pieces and rooms in a range, about.
RANGE_ROWS = 1 << 17
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 24
#: Longer units are encoded each time they occur.
MEMO_BYTES = 64
#: Distinct units are encoded in strings of about so many bytes.
JOINT_BYTES = 1 << 16
#: White space other than the six bytes: a cut at a space is not safe there, such texts are encoded in one piece.
ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

#: Class of a byte: 1 white space, 2 letter, 3 digit, 4 another ASCII sign, 0 a part of any other character or a control character.
WHITE, APOSTROPHE = 1, ord("'")
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 4
KIND[48:58] = 3
KIND[65:91] = KIND[97:123] = 2
KIND[SPACE] = WHITE


class ByteIds:
    """Ids of whole texts for a byte-level BPE file, each followed by the end id.

    A text is cut before white space that follows something else and where its ASCII letters, digits and signs change, but not
    after an apostrophe. A cut there is a boundary of the pre-tokenizer whatever stands around it, so each distinct unit is
    encoded once. Texts with other white space or the string of an added token are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        self.library, self.end_id = bpe_library(path), end_id
        self.memo = Memo(self._whole)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a letter a byte
        self.whole = "|".join([ODD_SPACE, *added])

    def _whole(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end (unsigned 32 bits), and the number of ids of each text (null counts as empty)."""
        texts = pa.concat_arrays([pc.fill_null(texts, "")])
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        at -= at[0]
        kind = KIND[letters]
        begins = np.zeros(len(letters) + 1, bool)
        before, after = kind[:-1], kind[1:]
        begins[1:-1] = (before != after) & (before > 0) & (after > 0) & (before != WHITE) & (letters[:-1] != APOSTROPHE) | (after == WHITE) & (before != WHITE)
        for k in np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)):
            begins[at[k] : at[k + 1]] = False
        begins[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begins[:-1])
        edges = pa.py_buffer(np.append(starts, len(letters)).astype(np.int32).tobytes())
        units = pa.StringArray.from_buffers(len(starts), edges, pa.py_buffer(letters.tobytes())).dictionary_encode()
        flat, sizes = self._unit_ids(units.dictionary)
        each = np.insert(units.indices.to_numpy().astype(np.int64), np.searchsorted(starts, at[1:]), len(sizes))
        flat, sizes = _gathered(np.append(flat, np.uint32(self.end_id)), np.append(sizes, 1), each[:, None])
        ends = np.searchsorted(starts, at[1:]) + np.arange(1, len(at))
        return flat, np.diff(np.append(0, np.cumsum(sizes))[ends], prepend=0)

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units.

        Units from white space to something else may follow each other without changing: they are encoded in long strings and told
        apart by the bytes that each id stands for. The few others are encoded one by one, short ones remembered.
        """
        ends = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64))
        letters = np.frombuffer(b"".join(units.cast(pa.binary()).to_pylist()), np.uint8) if len(units) else np.zeros(0, np.uint8)
        starts = np.append(0, ends)[:-1]
        joint = (KIND[letters[starts]] == WHITE) & (KIND[letters[ends - 1]] != WHITE)
        flat, sizes = self._joint_ids(units.filter(pa.array(joint)))
        others = units.filter(pa.array(~joint))
        short = pc.less_equal(pc.binary_length(others), MEMO_BYTES).to_numpy(zero_copy_only=False)
        lists = np.empty(len(others), object)
        for some, encode in ((short, self.memo.lookup), (~short, self._whole)):
            if some.any():
                lists[some] = np.fromiter(encode(others.filter(pa.array(some)).to_pylist()), object, int(some.sum()))
        more = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(more.sum()))])
        order = np.argsort(np.concatenate([np.flatnonzero(joint), np.flatnonzero(~joint)]), kind="stable")
        return _gathered(flat, np.concatenate([sizes, more]), order[:, None])

    def _joint_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = b"".join(units.cast(pa.binary()).to_pylist())
        ends = np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64))
        cuts = np.unique(np.append(0, ends[np.searchsorted(ends, np.arange(JOINT_BYTES, len(whole) + JOINT_BYTES, JOINT_BYTES)).clip(max=len(ends) - 1)])) if len(ends) else np.zeros(1, np.int64)
        texts = [whole[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]])
        at = np.cumsum(self.width[ids])
        last = np.searchsorted(at, ends)
        if len(ends) and (len(at) <= last[-1] or (at[last] != ends).any()):
            raise ValueError("the tokenizer file joins words across white space")
        return ids, np.diff(last, prepend=-1)


@lru_cache(maxsize=2)
def byte_ids(path: str, end_id: int) -> ByteIds:
    return ByteIds(path, end_id)


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of every whole text and ``end_id``, cut into pieces.

    Pieces have ``capacity`` ids, the first one of a document what the others leave. ``start`` counts its document's ids before
    it, ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers. Null text counts as empty.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = byte_ids(path, end_id)
        for batch in batches:
            bytes_each = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for group in grouped(bytes_each, GROUP_BYTES, size=int):
                some = batch.slice(group.start, group.stop - group.start)
                ids, sizes = tool.encode(some.column("text"))
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
                first = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield arrow_batch(some, ["doc_id"], row, made, {"piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return narrow.mapInArrow(cut, fields(narrow, ["doc_id"], made))


def brackets(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the matching pairs of a row of brackets: 0 opens, 1 closes."""
    level = np.cumsum(np.where(kind == 0, 1, -1)) + (kind == 1)
    order = np.argsort(level, kind="stable")  # at one level, brackets open and close in turn
    kinds, levels = kind[order], level[order]
    pair = (kinds[:-1] == 0) & (kinds[1:] == 1) & (levels[:-1] == levels[1:])
    return order[:-1][pair], order[1:][pair]


def matched_ranges(left: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Which leftovers match across ranges, from ``(range, pieces, rooms)`` left over in each.

    For kind 0 (pieces) and 1 (rooms) a list of ``(range, first number, count, first match)``. Rooms of a range take the pieces
    that are free below it, the nearest ranges' first. There are at most twice as many entries as ranges.
    """
    free: list[list[int]] = []
    found: dict[int, list[tuple[int, int, int, int]]] = {0: [], 1: []}
    match = 0
    for part, pieces, rooms in sorted(left):
        number = 0
        while number < rooms and free:
            below, first, count = free[-1]
            n = min(rooms - number, count)
            found[0].append((below, first, n, match))
            found[1].append((part, number, n, match))
            match, number = match + n, number + n
            free[-1] = [below, first + n, count - n]
            if count == n:
                free.pop()
        if pieces:
            free.append([part, 0, pieces])
    return found


_SWEPT = {"kind": "int", "key": "long", "size": "long", "part": "int", "number": "long", "mate": "long"}


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: pieces with their rooms, then what is left over, pieces numbered from the end and rooms from the start."""
    if not (read := list(batches)):
        return
    rows = pa.Table.from_batches(read)
    kind, key, size = (rows[c].to_numpy() for c in ("kind", "key", "size"))
    part = TaskContext.get().partitionId()
    opens, closes = brackets(kind)
    free = np.ones(len(kind), bool)
    free[opens] = free[closes] = False
    pieces, rooms = np.flatnonzero(free & (kind == 0))[::-1], np.flatnonzero(free & (kind == 1))
    at = np.concatenate([opens, pieces, rooms])
    number = np.concatenate([np.full(len(opens), -1), np.arange(len(pieces)), np.arange(len(rooms))])
    mate = pa.array(np.concatenate([key[closes], np.zeros(len(at) - len(opens), np.int64)]), mask=number >= 0)
    yield pa.RecordBatch.from_arrays([pa.array(kind[at]), pa.array(key[at]), pa.array(size[at]), pa.array(np.full(len(at), part, np.int32)), pa.array(number), mate], names=list(_SWEPT))


def _match(swept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a swept table: ``key, size, mate`` of the placed pieces, and ``key, size`` of the others."""
    placed, left = swept.where("mate IS NOT NULL").select("key", "size", "mate"), swept.where("mate IS NULL")
    counts = left.groupBy("part").agg(F.count_if(F.col("kind") == 0).alias("pieces"), F.count_if(F.col("kind") == 1).alias("rooms")).collect()
    found = matched_ranges([tuple(r) for r in counts])
    if not found[0]:
        return placed, left.where("kind = 0").select("key", "size")
    spans = {k: np.array(sorted(v), np.int64).T for k, v in found.items()}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, own = (batch.column(c).to_numpy() for c in ("kind", "part", "number"))
            match, whole = np.zeros(len(kind), np.int64), np.zeros(len(kind), bool)
            for k, (parts, first, count, base) in spans.items():
                place = (part.astype(np.int64) << 40) + own
                at = np.maximum(np.searchsorted((parts << 40) + first, place, side="right") - 1, 0)
                beyond = own - first[at]
                fits = (kind == k) & (parts[at] == part) & (beyond >= 0) & (beyond < count[at])
                match[fits], whole[fits] = (base[at] + beyond)[fits], True
            yield arrow_batch(batch, ["kind", "key", "size"], None, {"match": "long"}, {"match": pa.array(match, mask=~whole)})

    left = materialise(left.mapInArrow(number, fields(left, ["kind", "key", "size"], {"match": "long"})))
    pieces, rooms = left.where("kind = 0"), left.where("kind = 1 AND match IS NOT NULL").select("match", F.col("key").alias("mate"))
    more = materialise(pieces.where("match IS NOT NULL").join(rooms, "match").select("key", "size", "mate"))
    return placed.unionByName(more), pieces.where("match IS NULL").select("key", "size")


def _least_sequences(sizes: str, capacity: int) -> list[Column]:
    """Lower bounds of the sequences that pieces need: by total, and by how many over a k-th of a sequence can share one."""
    return [F.ceil(F.sum(sizes) / capacity), *[F.ceil(F.count_if(F.col(sizes) * (k + 1) > capacity) / k) for k in range(1, 9)]]


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``key, sequence_id`` for ``key long, size long`` (1 to ``capacity``, distinct keys): sizes in a sequence add up to at most ``capacity``.

    Sequences are numbered from 0. Reruns on the same rows agree. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces, rooms = materialise(pieces.select("key", "size")), spark.createDataFrame([], "key long, size long")
    opened, done = 0, []
    while True:
        n, total, least, most = pieces.agg(F.count(F.lit(1)), F.sum("size"), F.min("size"), F.max("size")).first()
        if not n:
            break
        rooms = rooms.where(F.col("size") >= least)
        n_rooms, room, widest = rooms.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        more = max(0, -(-(total - room) // capacity))
        if most > widest:
            more = max(more, *pieces.where(F.col("size") > widest).agg(*_least_sequences("size", capacity)).first())
        empty = spark.range(opened, opened + more).select(F.col("id").alias("key"), F.lit(capacity).cast("long").alias("size"))
        rooms, opened, n_rooms = rooms.unionByName(empty), opened + more, n_rooms + more
        # as many equal parts of a room as hold the largest piece
        share = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / most), F.lit(-(-n // n_rooms))))
        offered = rooms.withColumn("n", share).select(F.lit(1).alias("kind"), "key", F.floor(F.col("size") / F.col("n")).alias("size"), F.explode(F.sequence(F.lit(1), "n")).alias("k"))
        both = pieces.select(F.lit(0).alias("kind"), "key", "size").unionByName(offered.drop("k"))
        ranges = max(1, -(-(n + max(n, n_rooms)) // range_rows))
        both = both.repartitionByRange(ranges, "size", "kind", "key").sortWithinPartitions("size", "kind", "key")
        swept = materialise(both.mapInArrow(_sweep, ", ".join(f"{c} {t}" for c, t in _SWEPT.items())))
        placed, pieces = _match(swept)
        done.append(placed.select("key", F.col("mate").alias("sequence_id")))
        used = placed.groupBy(F.col("mate").alias("key")).agg(F.sum("size").alias("used"))
        rooms = rooms.join(used, "key", "left").select("key", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).where("size > 0")
        rooms = materialise(rooms)
    out = spark.createDataFrame([], "key long, sequence_id long")
    for some in done:
        out = out.unionByName(some)
    return out


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece of every document.

    ``path`` is a tokenizers JSON file of the byte-level BPE kind that every worker can read. Every row of ``docs`` is a document
    of its own, with repeated or null ids too; null or empty text has the end id only. Full pieces have sequences of their own,
    with negative numbers. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    pieces = token_pieces(docs, path, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity)
    pieces = materialise(pieces.withColumn("key", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    packed = short.join(best_fit(short.select("key", F.col("length").alias("size")), capacity), "key")
    before = Window.partitionBy("sequence_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # at most ``capacity`` pieces
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return packed.unionByName(full).drop("key")
