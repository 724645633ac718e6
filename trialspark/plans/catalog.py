"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Inputs

SECTIONS = ("stats", "signal", "spectra", "traces", "models", "extended", "clusters", "curves", "states", "validation", "nets", "groups", "names", "align", "windows")


def _entries() -> dict:
    return {name: entry for section in SECTIONS for name, entry in import_module(f"{__package__}.{section}").QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: make(Inputs(spark, sf_dir))) for name, (make, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _entries().items() if text}
