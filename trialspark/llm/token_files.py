"""Token ids of a corpus in binary shards, each a wavelet matrix, and reading them back or asking them.

Rows are parted by ranges of the id (Spark's range partitioning) and sorted inside a part; the same task encodes them and writes
shards of bounded size, so texts move once and ids are never shuffled. A shard is one row of one file (block, ids of its
documents), written by Spark's own writer, so a lost task leaves no half file. A written shard answers which token stands at a
place, how often an id occurs and where, from a few chunks of its bit planes.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_batch, fields, shared_dir
from ._memo import bpe_library
from ._words import grouped
from .wavelet import WaveletMatrix, build

#: Id appended to each document.
END_ID = 1
#: A shard is closed before it has more tokens than this; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: Bytes of text in a part, about, as long as that makes no more than MAX_PARTS parts.
PART_BYTES = 1 << 25
MAX_PARTS = 100_000
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 1 << 25

#: The normaliser and pre-tokenizer under which words can be encoded one by one and plain ones by the model alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A plain word: Latin-1 letters are one pre-token and their own NFC form, signs after them are the next one.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<sign>[.,;:!?*%$&#|]*)$"


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself if printable, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class TextIds:
    """Ids of whole texts as the library gives them, each text followed by the end id.

    Where the file's normaliser and pre-tokenizer drop white space and never join across it, a group of texts is encoded by its
    distinct words; with any other file the library encodes every text whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        self.library = bpe_library(path)
        shape = json.loads(self.library.to_str())
        fixed = shape["post_processor"] is None and shape["truncation"] is None and shape["padding"] is None
        self.by_words = fixed and shape["normalizer"] == WORD_NORMALIZER and shape["pre_tokenizer"] == WORD_SPLITTER
        self.letters = _byte_letters()
        size = max(self.library.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bits = max(1, (size - 1).bit_length())
        self.end_id = end_id

    def _core(self, word: str) -> list[int]:
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.library.model.tokenize(mapped)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.kind, int(sizes.sum())), sizes

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: plain ones by their lower-case letters and the signs after them, each looked up once."""
        found = pc.extract_regex(words, PLAIN)
        core, sign = (pc.struct_field(found, k) for k in ("core", "sign"))
        core, sign, rest = pc.utf8_lower(core).dictionary_encode(), sign.dictionary_encode(), words.filter(found.is_null())
        lists = [*map(self._core, core.dictionary.to_pylist()), *self._whole([*sign.dictionary.to_pylist(), *rest.to_pylist()])]
        flat, sizes = self._flat(lists)
        plain, signs = len(core.dictionary), len(sign.dictionary)
        first = core.indices.fill_null(-1).to_numpy().astype(np.int64)
        first[first < 0] = plain + signs + np.arange(len(rest))
        # the place after the last list stands for no signs
        second = sign.indices.cast(pa.int64()).fill_null(len(sizes) - plain).to_numpy() + plain
        return _gathered(flat, np.append(sizes, 0), np.column_stack([first, second]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end, and the number of ids of each text (null counts as empty)."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return self._flat([[*ids, self.end_id] for ids in self._whole(texts.to_pylist())])
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        flat, sizes = self._word_ids(coded.dictionary)
        each = np.insert(coded.indices.to_numpy(), ends, len(sizes))  # after each text's words the end id
        ids, sizes = _gathered(np.append(flat, self.kind.type(self.end_id)), np.append(sizes, 1), each[:, None])
        return ids, np.diff(np.cumsum(sizes)[ends + np.arange(len(ends))], prepend=0)


def _gathered(flat: np.ndarray, sizes: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``lists`` the named lists of ``flat`` one after the other, laid end to end; and the rows' sizes."""
    each = lists.ravel()
    taken = sizes[each]
    until = np.cumsum(taken)
    starts = np.cumsum(sizes) - sizes
    out = flat[np.repeat(starts[each] - until + taken, taken) + np.arange(until[-1] if len(until) else 0)]
    return out, taken.reshape(lists.shape).sum(1)


@lru_cache(maxsize=2)
def text_ids(path: str, end_id: int = END_ID) -> TextIds:
    return TextIds(path, end_id)


def write_token_shards(docs: DataFrame, path: str, out: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, part_bytes: int = PART_BYTES) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, to ``out`` in ascending id order.

    ``path`` is a tokenizers JSON file that every worker can read. Null text counts as empty (only the end id). Ids may be of any
    type with an order; null ids come first, rows that repeat an id follow each other, ordered by their texts' hashes. Other
    columns of ``docs`` are ignored. An empty table writes no shard.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    (size,) = narrow.select(F.sum(F.octet_length("text") + 64)).first()
    parts = max(1, min(MAX_PARTS, -(-(size or 0) // part_bytes)))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, bucket, part, held, size = text_ids(path, end_id), TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            names = pa.concat_arrays([n for n, _, _ in held])
            lengths = np.concatenate([s for _, s, _ in held])
            block = build(np.concatenate([i for _, _, i in held]), lengths, tool.bits)
            listed = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([int(lengths.sum())]), listed, pa.array([block])], names=["bucket", "part", "tokens", "doc_ids", "block"])

        for batch in batches:
            texts = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
            for rows in grouped(texts, GROUP_BYTES, size=int):
                some = batch.slice(rows.start, rows.stop - rows.start)
                ids, sizes = tool.encode(some.column("text"))
                ends, first = np.cumsum(sizes), 0
                while first < len(sizes):
                    before = int(ends[first] - sizes[first])
                    last = int(np.searchsorted(ends, before + shard_tokens - size, side="right"))
                    if last == first and held:
                        yield close()
                        part, held, size = part + 1, [], 0
                        continue
                    last = max(last, first + 1)
                    held.append((some.column("doc_id").slice(first, last - first), sizes[first:last], ids[before : ends[last - 1]]))
                    size += int(ends[last - 1]) - before
                    first = last
        if held:
            yield close()

    # the row number parts even rows that are alike in id and text; rows keep it when a task runs again on the same split
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = narrow.select("doc_id", "text", place[1].alias("hash"), place[2].alias("row"))
    ordered = ordered.repartitionByRange(parts, place[0], "hash", "row").sortWithinPartitions(place[0], "hash", "row").select("doc_id", "text")
    coded = ordered.mapInArrow(shards, f"bucket int, part int, tokens long, doc_ids array<{kind}>, block binary")
    coded.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(out)


def shard_starts(spark: SparkSession, out: str) -> DataFrame:
    """``bucket, part, tokens, shard_start``: tokens before each shard, by two levels of running sums (buckets, then parts)."""
    sizes = spark.read.parquet(out).select("bucket", "part", "tokens")
    totals = sizes.groupBy("bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    before = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(before, "bucket").select("bucket", "part", "tokens", (F.col("bucket_start") + F.col("inside")).alias("shard_start"))


def read_token_shards(spark: SparkSession, out: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of each document, from the shards' bit planes."""
    blocks = spark.read.parquet(out).select("bucket", "part", "doc_ids", "block")
    made = {"offset": "long", "n_tokens": "long", "ids_crc32": "long"} | ({"ids": "array<int>"} if with_ids else {})
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column("block")[k].as_py())
                ids = matrix.tokens().astype("<u4")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                raw = memoryview(ids.tobytes())
                values = {"offset": starts, "n_tokens": matrix.lengths, "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]}
                if with_ids:
                    values["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                names = batch.column("doc_ids").slice(k, 1).flatten()
                passed = pa.RecordBatch.from_arrays([names, *(pa.array(np.full(len(names), batch.column(c)[k].as_py()), pa.int32()) for c in ("bucket", "part"))], names=["doc_id", "bucket", "part"])
                yield arrow_batch(passed, passed.schema.names, None, made, values)

    shape = f"doc_id {kind}, bucket int, part int, " + fields(blocks, [], made)
    found = blocks.mapInArrow(read, shape).join(shard_starts(spark, out).drop("tokens"), ["bucket", "part"])
    return found.withColumn("start", F.col("shard_start") + F.col("offset")).select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def open_shard(spark: SparkSession, out: str, bucket: int, part: int) -> WaveletMatrix:
    """One written shard, opened; its bit planes stay packed until a question needs a chunk of them."""
    return WaveletMatrix(bytes(spark.read.parquet(out).where((F.col("bucket") == bucket) & (F.col("part") == part)).select("block").first()[0]))


def token_at(spark: SparkSession, out: str, position: int) -> int:
    """The id at a position of the whole corpus: one shard is found by its start and asked."""
    shard = shard_starts(spark, out).where(F.lit(position).between(F.col("shard_start"), F.col("shard_start") + F.col("tokens") - 1)).first()
    if shard is None:
        raise IndexError(position)
    return open_shard(spark, out, shard["bucket"], shard["part"]).access(position - shard["shard_start"])


def find_tokens(spark: SparkSession, out: str, symbols: Sequence[int], *, first: int | None = None) -> DataFrame:
    """``symbol, position`` of the occurrences of some ids in the whole corpus, each shard asked in its own task by select.

    With ``first``, only so many occurrences of each id in each shard. A short list of ids; ids that never occur give no row.
    """
    wanted = list(dict.fromkeys(map(int, symbols)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch.column("block")[k].as_py())
                counts = [matrix.count(s) if first is None else min(first, matrix.count(s)) for s in wanted]
                places = [matrix.select(s, i) for s, n in zip(wanted, counts, strict=True) for i in range(n)]
                bucket, part = (list(repeat(batch.column(c)[k].as_py(), len(places))) for c in ("bucket", "part"))
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), pa.array(np.repeat(wanted, counts), pa.int32()), pa.array(places, pa.int64())], names=["bucket", "part", "symbol", "offset"])

    found = spark.read.parquet(out).select("bucket", "part", "block").mapInArrow(find, "bucket int, part int, symbol int, offset long")
    return found.join(shard_starts(spark, out), ["bucket", "part"]).select("symbol", (F.col("shard_start") + F.col("offset")).alias("position"))


def count_tokens(spark: SparkSession, out: str, symbols: Sequence[int]) -> DataFrame:
    """``symbol, occurrences`` in the whole corpus of each of a short list of ids, by rank in every shard."""
    wanted = list(dict.fromkeys(map(int, symbols)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                matrix = WaveletMatrix(block.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int32()), pa.array([matrix.count(s) for s in wanted], pa.int64())], names=["symbol", "occurrences"])

    return spark.read.parquet(out).select("block").mapInArrow(count, "symbol int, occurrences long").groupBy("symbol").agg(F.sum("occurrences").alias("occurrences"))


def token_file_digest(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    out = shared_dir(spark)
    write_token_shards(docs, path, out, **options)
    return read_token_shards(spark, out)
