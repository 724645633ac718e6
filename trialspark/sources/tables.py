"""Readers and the standard tables made from the given ones: trials, samples, spectra, analytic signals, features, frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines; minus zero becomes zero."""
    return F.round(column, digits) + F.lit(0.0)


def finite(column: Column) -> Column:
    """NaN and infinities become null, because aggregates skip null only."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """The standard tables over one folder, each a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def trials(self) -> DataFrame:
        """``subject, run, trial_id, onset, condition, predictor, outcome`` from the event stream."""
        w = Window.partitionBy("user_id")
        first = F.min("ts").over(w)
        return self.raw("events").select(
            F.col("user_id").alias("subject"),
            (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("int").alias("run"),
            F.row_number().over(w.orderBy("ts", "event_id")).cast("long").alias("trial_id"),
            (F.timestamp_diff("MICROSECOND", first, F.col("ts")) / 1e6).alias("onset"),
            F.col("event_type").alias("condition"),
            F.get_json_object("props", "$.k").cast("double").alias("predictor"),
            F.col("value").alias("outcome"),
        )

    @cached_property
    def dims(self) -> DataFrame:
        e = self.raw("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
        return e.select(F.col("vec_id").alias("trial_id"), (F.col("vec_id") % 25).cast("int").alias("subject"), (F.floor(F.col("vec_id") / 25) % 4).cast("int").alias("run"), F.col("label").alias("condition"), "dim", F.col("x").cast("double").alias("x"))

    @cached_property
    def samples(self) -> DataFrame:
        """8 channels x 8 samples a trial, t from -0.25 s."""
        return self.dims.select("trial_id", "subject", "run", "condition", (F.col("dim") % 8).alias("channel"), F.floor(F.col("dim") / 8).cast("int").alias("sample_idx"), ((F.floor(F.col("dim") / 8) - 2) / 8.0).alias("t"), "x")

    @cached_property
    def psd(self) -> DataFrame:
        """A positive spectrum of 64 bins at 1 ... 64 Hz a trial."""
        return self.dims.select("trial_id", "subject", "run", "condition", (F.col("dim") + 1).cast("double").alias("freq"), (F.col("x") * F.col("x")).alias("power"))

    @cached_property
    def tfr(self) -> DataFrame:
        """Power at 8 frequencies x 8 times a trial."""
        return self.dims.select("trial_id", "subject", "run", "condition", (F.col("dim") % 8 + 1).cast("double").alias("freq"), ((F.floor(F.col("dim") / 8) - 2) / 8.0).alias("t"), (F.col("x") * F.col("x")).alias("power"))

    @cached_property
    def analytic(self) -> DataFrame:
        """Complex samples, 4 channels x 8 times a trial: even positions are real parts, odd ones imaginary."""
        pair = F.floor(F.col("dim") / 2)
        part = lambda k: F.max(F.when(F.col("dim") % 2 == k, F.col("x")))
        return self.dims.withColumn("pair", pair).groupBy("trial_id", "subject", "run", "condition", (F.col("pair") % 4).cast("int").alias("channel"), F.floor(F.col("pair") / 4).cast("int").alias("t")).agg(part(0).alias("re"), part(1).alias("im"))

    @cached_property
    def wide(self) -> DataFrame:
        """Wide trial table: four measures, subject, run, condition."""
        w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
        return self.raw("lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("run"), F.row_number().over(w).cast("long").alias("trial_id"), F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))

    @cached_property
    def features(self) -> DataFrame:
        """The wide table as long features."""
        return self.wide.unpivot(["subject", "run", "trial_id", "condition"], ["quantity", "price", "discount", "tax"], "feature", "value")

    @cached_property
    def names(self) -> DataFrame:
        """Feature names ``group_segment_band_scope_identifier_stat`` made from the line items' codes."""
        pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c % len(v) + 1).cast("int"))
        k, o = F.col("l_linenumber"), F.col("l_suppkey")
        return self.raw("lineitem").select(F.concat_ws("_", pick(k, "power", "conn", "erds"), pick(o, "active", "baseline"), pick(k + o, "alpha", "beta", "theta"), pick(o, "ch", "roi", "global"), F.concat(F.lit("e"), k.cast("string")), pick(k, "mean", "logratio")).alias("name")).distinct()

    @cached_property
    def frames(self) -> DataFrame:
        """Region time series: frame within subject and run, four regions."""
        w = Window.partitionBy("subject", "run").orderBy("trial_id")
        return self.wide.withColumn("frame", F.row_number().over(w)).unpivot(["subject", "run", "frame"], ["quantity", "price", "discount", "tax"], "roi", "value")

    @cached_property
    def voxels(self) -> DataFrame:
        return self.dims.select("trial_id", "subject", "run", "condition", F.col("dim").alias("voxel"), F.col("x").alias("value"))


SQL_TABLES = {
    "trials": """trials AS (SELECT user_id AS subject, ((day(ts) - 1) // 10 + 1)::INT AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial_id,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS onset, event_type AS condition, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS predictor, value AS outcome FROM events)""",
    "dims": """dims AS (SELECT vec_id AS trial_id, (vec_id % 25)::INT AS subject, ((vec_id // 25) % 4)::INT AS run, label AS condition, d AS dim, embedding[d + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS d))""",
    "samples": "samples AS (SELECT trial_id, subject, run, condition, dim % 8 AS channel, dim // 8 AS sample_idx, (dim // 8 - 2) / 8.0::DOUBLE AS t, x FROM dims)",
    "psd": "psd AS (SELECT trial_id, subject, run, condition, (dim + 1)::DOUBLE AS freq, x * x AS power FROM dims)",
    "tfr": "tfr AS (SELECT trial_id, subject, run, condition, (dim % 8 + 1)::DOUBLE AS freq, (dim // 8 - 2) / 8.0::DOUBLE AS t, x * x AS power FROM dims)",
    "analytic": "analytic AS (SELECT trial_id, subject, run, condition, ((dim // 2) % 4)::INT AS channel, (dim // 8)::INT AS t, max(CASE WHEN dim % 2 = 0 THEN x END) AS re, max(CASE WHEN dim % 2 = 1 THEN x END) AS im FROM dims GROUP BY ALL)",
    "wide": """wide AS (SELECT l_suppkey AS subject, l_linenumber AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS trial_id,
        l_returnflag AS condition, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)""",
    "features": """features AS (SELECT subject, run, trial_id, condition, f.feature, CASE f.feature WHEN 'quantity' THEN quantity WHEN 'price' THEN price WHEN 'discount' THEN discount ELSE tax END AS value
        FROM wide, (VALUES ('quantity'), ('price'), ('discount'), ('tax')) f(feature))""",
    "names": """names AS (SELECT DISTINCT concat_ws('_', ['power', 'conn', 'erds'][l_linenumber % 3 + 1], ['active', 'baseline'][l_suppkey % 2 + 1], ['alpha', 'beta', 'theta'][(l_linenumber + l_suppkey) % 3 + 1],
        ['ch', 'roi', 'global'][l_suppkey % 3 + 1], 'e' || l_linenumber, ['mean', 'logratio'][l_linenumber % 2 + 1]) AS name FROM lineitem)""",
    "frames": """frames AS (SELECT subject, run, frame, f.roi, CASE f.roi WHEN 'quantity' THEN quantity WHEN 'price' THEN price WHEN 'discount' THEN discount ELSE tax END AS value
        FROM (SELECT *, row_number() OVER (PARTITION BY subject, run ORDER BY trial_id) AS frame FROM wide), (VALUES ('quantity'), ('price'), ('discount'), ('tax')) f(roi))""",
    "voxels": "voxels AS (SELECT trial_id, subject, run, condition, dim AS voxel, x AS value FROM dims)",
}
_NEEDS = {"samples": ["dims"], "psd": ["dims"], "tfr": ["dims"], "analytic": ["dims"], "voxels": ["dims"], "features": ["wide"], "frames": ["wide"]}


def sql(tables: str, body: str) -> str:
    """DuckDB SQL with the named standard tables in front; ``body`` may go on with further tables after a comma."""
    wanted: list[str] = []
    for name in tables.split():
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    head = ",\n    ".join(SQL_TABLES[n] for n in wanted)
    rest = body.strip()
    if rest.startswith(","):
        return f"WITH {head}\n    {rest}"
    return (f"WITH {head}\n    " if head else "") + rest


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"
