"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, by rows and by bytes, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text):
    """The words of a text column (null: none), in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def process_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, which Spark reuses for many tasks.

    Task code arrives by value, so its own globals last for one task only.
    """
    holder = sys.modules.setdefault("_task_store", types.ModuleType("_task_store"))
    return holder.__dict__.setdefault(name, {})
