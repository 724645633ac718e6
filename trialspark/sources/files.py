"""Reading and writing tables, catalogues, contracts and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A tab-separated file with a header; ``n/a`` is null. The names come from the schema, so a byte-order mark is harmless."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="n/a", encoding="UTF-8", enforceSchema=True)


def write_tsv(df: DataFrame, path: str) -> None:
    """One directory of tab-separated files, each with a header; null is ``n/a``."""
    df.write.csv(path, sep="\t", header=True, nullValue="n/a", emptyValue="")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, nullValue="n/a", emptyValue="")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Snappy Parquet, optionally partitioned by columns that later reads filter on."""
    df.write.option("compression", "snappy").partitionBy(*(partitions or [])).parquet(path)


def catalogue(features: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and distinct columns of every feature table."""
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("feature").alias("columns"))


def save_features(features: DataFrame, path: str) -> None:
    """Long features, one folder per family, files in order of subject: readers skip the row groups of other subjects by their bounds.

    Folders and files do not grow with the number of subjects, as a folder for each subject would.
    """
    write_parquet(features.sortWithinPartitions("family", "subject"), path, ["family"])


def identical_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns that are equal (nulls included) in every row, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    counts = df.agg(*(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    long = counts.unpivot([], counts.columns, "pair", "n_different")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("first"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("second"), "n_different", (F.col("n_different") == 0).alias("identical"))


def dropped(planned: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(kept.select(*keys), keys, "left_anti")


def contract(df: DataFrame, key: str, trial: str) -> DataFrame:
    """Per key: rows, distinct trials and an order-free fingerprint of all columns."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(trial).alias("trials"), F.bit_xor(F.xxhash64(*df.columns)).alias("fingerprint"))


def compare_contracts(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose contract differs from the stored one, or which only one side has."""
    both = now.alias("n").join(stored.alias("s"), key, "full_outer")
    same = F.col("n.rows").eqNullSafe(F.col("s.rows")) & F.col("n.trials").eqNullSafe(F.col("s.trials")) & F.col("n.fingerprint").eqNullSafe(F.col("s.fingerprint"))
    return both.select(key, F.col("n.rows").alias("rows_now"), F.col("s.rows").alias("rows_stored"), same.alias("same"))


def validate(df: DataFrame, key: str, required: list[str], any_of: list[str]) -> DataFrame:
    """Share of non-null values per key and required column, and of rows with any of the alternatives."""
    share = [(F.count(c) / F.count(F.lit(1))).alias(c) for c in required]
    return df.groupBy(key).agg(*share, (F.count(F.coalesce(*any_of)) / F.count(F.lit(1))).alias("any_of"))


def outputs_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    return reduce(DataFrame.unionByName, [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()])


def coverage(features: DataFrame, everyone: DataFrame) -> DataFrame:
    """Subjects per feature and their share of all subjects."""
    total = everyone.agg(F.countDistinct("subject").alias("total"))
    return features.groupBy("feature").agg(F.countDistinct("subject").alias("subjects")).crossJoin(F.broadcast(total)).select("feature", "subjects", (100 * F.col("subjects") / F.col("total")).alias("percent"))


def selection_report(requested: DataFrame, used: DataFrame, reasons: DataFrame) -> DataFrame:
    """Requested subjects: included or not, and the reason."""
    flagged = requested.join(used.select("subject").distinct().withColumn("included", F.lit(True)), "subject", "left")
    return flagged.join(reasons, "subject", "left").select("subject", F.coalesce("included", F.lit(False)).alias("included"), F.when(F.col("included").isNull(), F.coalesce("reason", F.lit("no data"))).alias("reason"))


def complete_participants(participants: DataFrame, subjects: DataFrame) -> DataFrame:
    """The participants table with a row for every missing subject."""
    return participants.unionByName(subjects.select("subject").distinct().join(participants, "subject", "left_anti"), allowMissingColumns=True)
