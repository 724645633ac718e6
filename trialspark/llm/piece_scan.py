"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The encoding of a text is the one path through the lattice of its pieces in which every two neighbours are what the model
makes of their joint text: a path's weight is the sum over its neighbours, 0 if they fit and minus infinity if not, and the
encoding is the path of greatest weight. (Greedy merging of the whole text and of two neighbours take the same steps until a
merge would cross the border between them, so a path is the encoding exactly if all its pairs fit.)

A giant text is cut at any characters. A state at a cut is the piece that holds the character before it. Each chunk gives a
matrix from the states at its first cut to the states at its last one. Matrices combine by max-plus products, which are
associative: they are multiplied in a tree of ``FAN_IN`` children a node, level by level, each node in its own task; on the way
down every node hands each child the best weights up to it and from it on. At a chunk these name the states at its cuts, and it
then backtraces its own pieces. Where the vocabulary proves that no piece can span a place (a word begin), all states meet in one, so the
matrix of a chunk with such places is of rank one and its inner part is encoded by the library, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, fields, materialise
from ._memo import Memo, piece_library
from ._words import grouped

SPACE = "▁"
#: Longer texts are cut into chunks of so many characters.
CHUNK_CHARS = 65_536
#: Results leave a Python worker for about so many characters of text at a time.
OUTPUT_CHARS = 1 << 20
#: Children of a node in the tree of products.
FAN_IN = 32
NEVER = -np.inf
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BEGIN = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Pieces:
    """The vocabulary of one model file: scores, byte pieces, merging of short strings, the memo of whole units."""

    def __init__(self, path: str):
        sp = self.library = piece_library(path)
        size = sp.get_piece_size()
        self.id = {}
        self.bytes = [b""] * size
        byte_id = [0] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id[piece] = i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.byte_id = byte_id
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        #: True when no piece has a word begin after its first other character: then every word begin is a piece border.
        self.words_apart = not any(_BEGIN.search(p) for p in self.id)
        self.fit: dict[tuple[str, str], bool] = {}
        self.memo = Memo(self._encode_units)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"

    def merge(self, text: str) -> list[str]:
        """Greedy merging: the pair with the best score first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (at < 0 or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) > 500_000:
                self.fit.clear()
            known = self.fit[key] = self.merge(left + right) == [left, right]
        return known

    def ids(self, parts: list[str]) -> bytes:
        found: list[int] = []
        for part in parts:
            if (i := self.id.get(part)) is not None:
                found.append(i)
            else:
                found.extend(self.byte_id[b] for b in part.encode())
        return np.array(found, self.kind).tobytes()

    def _encode_units(self, units: list[str]) -> list[bytes]:
        plain = [u[0] == SPACE and len(u) > 1 for u in units]
        found = iter(self.library.encode([u[1:] for u, p in zip(units, plain, strict=True) if p], num_threads=1))
        return [np.array(next(found), self.kind).tobytes() if p else self.ids(self.merge(u)) if len(u) < 64 else self._bare(u) for u, p in zip(units, plain, strict=True)]

    def _bare(self, unit: str) -> bytes:
        # the library puts a word begin in front: a unit without one is walked through the lattice instead
        return self.ids(self.walk(unit, 0, 0, None, len(unit), None))

    def encode(self, normal: str) -> bytes:
        """Ids of a normalised text that begins and ends at piece borders."""
        if not normal:
            return b""
        if self.words_apart:
            return b"".join(self.memo.lookup(_UNIT.findall(normal)))
        return self.ids(self.walk(normal, 0, 0, None, len(normal), None))

    def at(self, text: str, start: int) -> list[int]:
        """Ends of the pieces that begin at ``start`` (a single character always counts)."""
        return [e for e in range(start + 1, min(len(text), start + self.longest) + 1) if e == start + 1 or text[start:e] in self.id]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """All pieces (start, end) that hold the character before ``cut``."""
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in self.at(text, s) if e >= cut]

    def reach(self, text: str, entries: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], np.ndarray]:
        """Max-plus rows: for each piece that holds the character before ``stop``, its best weight from each entry piece."""
        rows: dict[tuple[int, int], np.ndarray] = {}
        by_end: dict[int, list[tuple[int, int]]] = {}
        for i, entry in enumerate(entries):
            rows[entry] = np.full(len(entries), NEVER)
            rows[entry][i] = 0
            by_end.setdefault(entry[1], []).append(entry)
        done: dict[tuple[int, int], np.ndarray] = {}
        for at in sorted(range(min(e for _, e in entries), stop + 1)) if entries else ():
            ending = by_end.pop(at, [])
            for piece in ending:
                if at >= stop:
                    done[piece] = rows[piece]
            if at >= stop or not ending:
                for piece in ending:
                    rows.pop(piece)
                continue
            for end in self.at(text, at):
                after, row = (at, end), None
                for piece in ending:
                    if self.fits(text[piece[0] : piece[1]], text[at:end]):
                        row = rows[piece] if row is None else np.maximum(row, rows[piece])
                if row is not None:
                    if end >= stop:
                        done[after] = row
                    else:
                        rows[after] = row
                        by_end.setdefault(end, []).append(after)
            for piece in ending:
                rows.pop(piece)
        for pieces in by_end.values():  # entry pieces that reach over the stop themselves
            for piece in pieces:
                done[piece] = rows[piece]
        return done

    def walk(self, text: str, start: int, at: int, entry: tuple[int, int] | None, stop: int, leave: tuple[int, int] | None) -> list[str]:
        """The fitting pieces from ``entry`` (or a border at ``start``) to ``leave`` (or a border at ``stop``), entry excluded."""
        first = entry[1] if entry else start
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        by_end: dict[int, list[tuple[int, int] | None]] = {first: [entry]}
        limit = leave[1] if leave else stop
        for at in range(first, limit):
            for end in self.at(text, at) if at in by_end else ():
                for piece in by_end[at]:
                    if end <= limit and (piece is None or self.fits(text[piece[0] : piece[1]], text[at:end])):
                        back[(at, end)] = piece
                        by_end.setdefault(end, []).append((at, end))
                        break
        last = leave if leave else next((p for p in by_end.get(stop, []) if p), None)
        out: list[str] = []
        while last is not None and last != entry:
            out.append(text[last[0] : last[1]])
            last = back[last]
        return out[::-1]

    def inner(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last proven piece border in ``[lo, hi)``."""
        if not self.words_apart:
            return None
        first = _BEGIN.search(text, lo, hi)
        if not first:
            return None
        last = max(text.rfind(SPACE, first.start(), hi), first.start())
        while last > first.start() and text[last - 1] == SPACE:
            last = text.rfind(SPACE, first.start(), last)
        return first.start(), last

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices in the max-plus semiring."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunk_matrix(v: Pieces, text: str, lo: int, hi: int, first: bool, last: bool) -> np.ndarray:
    """Transfer matrix of ``text[lo:hi)``; the first chunk has one entry state, the last one exit state."""
    exits = [(hi, hi)] if last else v.states(text, hi)

    def ending(rows: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
        if last:
            ends = [r for (_, e), r in rows.items() if e == hi]
            return np.max(ends, axis=0).reshape(n, 1) if ends else np.full((n, 1), NEVER)
        return np.stack([rows.get(x, np.full(n, NEVER)) for x in exits], 1)

    border = v.inner(text, lo + 1, hi)
    if border is None:
        entries = [(lo, lo)] if first else v.states(text, lo)
        return ending(_reach_from(v, text, entries, first, hi), len(entries))
    p, q = border
    entries = [(lo, lo)] if first else v.states(text, lo)
    head = _reach_from(v, text, entries, first, p)
    into = [r for (_, e), r in head.items() if e == p]
    column = (np.max(into, axis=0) if into else np.full(len(entries), NEVER)).reshape(-1, 1)
    return max_plus(column, ending(_reach_from(v, text, [(q, q)], True, hi), 1))


def _reach_from(v: Pieces, text: str, entries: list[tuple[int, int]], border: bool, stop: int) -> dict[tuple[int, int], np.ndarray]:
    if not border:
        return v.reach(text, entries, stop)
    start = entries[0][0]
    first = [(start, e) for e in v.at(text, start)]
    rows = v.reach(text, first, stop)
    return {piece: row.max(keepdims=True) for piece, row in rows.items()}


def chunk_pieces(v: Pieces, text: str, lo: int, hi: int, entry: tuple[int, int] | None, leave: tuple[int, int] | None) -> bytes:
    """Backtrace of one chunk between its chosen states: the ids of the pieces after ``entry`` up to ``leave``."""
    border = v.inner(text, lo + 1, hi)
    if border is None:
        return v.ids(v.walk(text, lo, lo, entry, hi, leave))
    p, q = border
    return v.ids(v.walk(text, lo, lo, entry, p, None)) + v.encode(text[p:q]) + v.ids(v.walk(text, q, q, None, hi, leave))


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of some matrices in order."""
    out = matrices[0]
    for m in matrices[1:]:
        out = max_plus(out, m)
    return out


def handed_down(matrices: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each child the best weights from the text's begin to its entry states, and from its exit states to the end."""
    befores, afters = [before], [after]
    for m in matrices[:-1]:
        befores.append(max_plus(befores[-1][None, :], m)[0])
    for m in matrices[:0:-1]:
        afters.append(max_plus(m, afters[-1][:, None])[:, 0])
    return list(zip(befores, afters[::-1], strict=True))


def states_at(matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """Indices of a chunk's entry and exit state on the best path."""
    return int(np.argmax(before + max_plus(matrix, after[:, None])[:, 0])), int(np.argmax(max_plus(before[None, :], matrix)[0] + after))


_NODE = "row string, node long, states int, matrix array<double>"


def _matrix(states: int, matrix) -> np.ndarray:
    return np.asarray(matrix, float).reshape(states, -1)


def _up(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    m = product([_matrix(n, x) for n, x in zip(group["states"], group["matrix"], strict=True)])
    return pd.DataFrame({"row": [group["row"].iloc[0]], "node": [group["node"].iloc[0] // FAN_IN], "states": [m.shape[0]], "matrix": [m.ravel()]})


def _down(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    before, after = (np.asarray(group[c].iloc[0], float) for c in ("before", "after"))
    handed = handed_down([_matrix(n, x) for n, x in zip(group["states"], group["matrix"], strict=True)], before, after)
    return pd.DataFrame({"row": group["row"], "node": group["node"], "before": [b for b, _ in handed], "after": [a for _, a in handed]})


def tree_scan(nodes: DataFrame) -> DataFrame:
    """``row, node, before, after`` of each chunk matrix ``row, node, states, matrix``; nodes of a row are numbered from 0."""
    levels = [materialise(nodes)]
    (most,) = levels[0].agg(F.max("node")).first()
    while most:
        most //= FAN_IN
        grouped_nodes = levels[-1].groupBy("row", F.floor(F.col("node") / FAN_IN))
        levels.append(materialise(grouped_nodes.applyInPandas(_up, _NODE)))
    ones = F.array(F.lit(0.0))  # a whole text has one entry and one exit state
    handed = levels[-1].select("row", F.col("node").alias("parent"), ones.alias("before"), ones.alias("after"))
    for level in levels[-2::-1]:
        children = level.withColumn("parent", F.floor(F.col("node") / FAN_IN)).join(handed, ["row", "parent"])
        handed = children.groupBy("row", "parent").applyInPandas(_down, "row string, node long, before array<double>, after array<double>")
        handed = materialise(handed.withColumnRenamed("node", "parent"))
    return handed.withColumnRenamed("parent", "node")


def encode_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_chars, n_tokens, ids, round_trip``: ids of the whole text, and whether decoding them gives it back.

    ``path`` is a SentencePiece model of the BPE kind with identity normalisation that every worker can read. Null text
    counts as empty (no ids, round trip true). U+2581 in a text reads back as a space, which counts as a round trip. Rows
    may repeat or have null ids. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = {"n_chars": "long", "n_tokens": "long", "ids": "array<int>", "round_trip": "boolean"}

    def finished(batch: pa.RecordBatch, rows: list[int] | None, coded: list[bytes], texts: list[str], v: Pieces) -> pa.RecordBatch:
        ids = [np.frombuffer(c, v.kind) for c in coded]
        values = {
            "n_chars": list(map(len, texts)),
            "n_tokens": list(map(len, ids)),
            "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
            "round_trip": [v.decode(i.tolist()) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)],
        }
        return arrow_batch(batch, ["doc_id"], rows, made, values)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in grouped(texts, OUTPUT_CHARS):
                yield finished(batch, list(range(part.start, part.stop)), [v.encode(normalise(t)) for t in texts[part]], texts[part], v)

    sliced = {"row": "string", "node": "long", "chunks": "int", "slice": "string", "lo": "long", "hi": "long"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        part, n, margin = TaskContext.get().partitionId(), 0, 2 * v.longest
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                normal, n = normalise(text), n + 1
                chunks, values = -(-len(normal) // chunk_chars), {c: [] for c in sliced}
                edges = [k * len(normal) // chunks for k in range(chunks + 1)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    lo = max(0, a - margin)
                    for c, x in zip(sliced, (f"{part}-{n}", k, chunks, normal[lo : b + margin], a - lo, b - lo), strict=True):
                        values[c].append(x)
                yield arrow_batch(batch, ["doc_id"], [i] * chunks, sliced, values)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            found = [chunk_matrix(v, r["slice"], r["lo"], r["hi"], r["node"] == 0, r["node"] == r["chunks"] - 1) for r in batch.to_pylist()]
            yield arrow_batch(batch, ["row", "node"], None, {"states": "int", "matrix": "array<double>"}, {"states": [len(m) for m in found], "matrix": [m.ravel() for m in found]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            coded, own = [], []
            for r in batch.select([c for c in batch.schema.names if c != "doc_id"]).to_pylist():
                text, lo, hi = r["slice"], r["lo"], r["hi"]
                into, out = states_at(_matrix(r["states"], r["matrix"]), np.array(r["before"]), np.array(r["after"]))
                entry = v.states(text, lo)[into] if r["node"] > 0 else None
                leave = v.states(text, hi)[out] if r["node"] < r["chunks"] - 1 else None
                coded.append(chunk_pieces(v, text, lo, hi, entry, leave))
                own.append(text[lo:hi])
            yield arrow_batch(batch, ["doc_id", "row", "node"], None, {"coded": "binary", "own": "string"}, {"coded": coded, "own": own})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            texts = ["".join(p["own"] for p in ps)[1:].replace(SPACE, " ") for ps in parts]
            if parts:
                yield finished(batch, None, [b"".join(p["coded"] for p in ps) for ps in parts], texts, v)

    giant = F.length("text") > chunk_chars
    chunks = materialise(narrow.where(giant).mapInArrow(cut, fields(narrow, ["doc_id"], sliced)))
    result = fields(narrow, ["doc_id"], made)
    out = narrow.where(~F.coalesce(giant, F.lit(False))).mapInArrow(short, result)
    if chunks.isEmpty():
        return out
    spread = chunks.repartition("row", "node")
    nodes = materialise(spread.mapInArrow(transfer, fields(chunks, ["row", "node"], {"states": "int", "matrix": "array<double>"})))
    known = chunks.join(nodes, ["row", "node"]).join(tree_scan(nodes), ["row", "node"])
    traced = known.mapInArrow(trace, fields(chunks, ["doc_id", "row", "node"], {"coded": "binary", "own": "string"}))
    parts = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("node", "coded", "own"))).alias("parts")).select("doc_id", "parts")
    return out.unionByName(parts.mapInArrow(whole, result))
