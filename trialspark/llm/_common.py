"""Small helpers shared by the text operators: table readers, shared-folder tables, id handling."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import grouped

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return _LOCAL[0]


def materialise(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame, *columns: str) -> Column:
    """One string for the values of ``columns`` in a row of ``docs``, never null: equal when all values are, nulls included.

    The last column counts by its SHA-256 (it may be long), where null is not the same as empty.
    """
    *short, text = [docs[c].cast("string") for c in columns]
    return F.concat_ws(":", F.sha2(text.cast("binary"), 256), F.to_json(F.array(*short), {"ignoreNullFields": "false"}))


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, with as many underscores in front as make it differ from all of ``taken`` (Spark takes no notice of case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def crc32_text(column: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def hash_place(key: str) -> Column:
    """A fixed pseudo-random place in [0, 2^62) for an id."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))


def thinned(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows in the lowest part of the hash range, about a tenth more than ``most``, so that a following ordered limit of
    ``most`` gathers that many rows in all and not that many from every task."""
    n = rows.count()
    return rows.where(hash_place(key) < int(2**62 * 1.1 * most / n)) if n > 1.1 * most else rows


def labelled_sample(ids: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """``doc_id, y``: at most ``most`` labelled ids, the same in every run (lowest hash of the id).

    Only ids of ``ids`` count, so labels of other documents never crowd out the ones at hand. An id labelled twice has its
    largest label; null ids and null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known if where is None else known.where(where)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = materialise(known.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
    return thinned(known, "doc_id", most).orderBy(hash_place("doc_id"), "doc_id").limit(most)


#: Arrow types of the columns that workers make, by their Spark names.
_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def fields(rows: DataFrame, columns: Sequence[str], made: dict[str, str]) -> str:
    """Schema text: ``columns`` as they are in ``rows``, then the made ones."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"`{c}` {k}" for c, k in made.items())])


def arrow_batch(batch: pa.RecordBatch, columns: Sequence[str], rows: Sequence[int] | None, made: dict[str, str], values: dict[str, object]) -> pa.RecordBatch:
    """A batch of the passed columns (of the given rows) and the made ones. Passed values stay in Arrow, so ids stay exact."""
    passed = batch.select(list(columns))
    passed = passed if rows is None else passed.take(pa.array(rows, pa.int64()))
    arrays = [values[c] if isinstance(values[c], pa.Array) else pa.array(values[c], _ARROW[k], from_pandas=False) for c, k in made.items()]
    return pa.RecordBatch.from_arrays([*passed.columns, *arrays], names=[*columns, *made])


def map_texts(rows: DataFrame, columns: Sequence[str], made: dict[str, str], work: Callable[[list[bytes | None]], dict[str, object]], text: str = "text") -> DataFrame:
    """``columns`` of every row, untouched, and the ``made`` columns that ``work`` gives for its text, in groups of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for part in grouped(texts):
                yield arrow_batch(batch.slice(part.start, part.stop - part.start), columns, None, made, work(texts[part]))

    return rows.mapInArrow(run, fields(rows, columns, made))
