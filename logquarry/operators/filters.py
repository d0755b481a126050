"""Filters over log tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import contains_ignoring_case


def level_is(level: str) -> Column:
    return F.upper("level") == level.upper()


def is_severe() -> Column:
    return F.col("level").rlike("(?i)(ERROR|CRITICAL)")


def filter_logs(
    df: DataFrame,
    levels: list[str] | None = None,
    services: list[str] | None = None,
    instances: list[str] | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Conjunction of the given filters; days are inclusive.

    All are plain predicates on stored columns, so they reach the scan; a table laid out by
    date (``save_logs(by_date=True)``) is also cut by that column's partitions.
    """
    if levels is not None:
        df = df.where(F.col("level").isin(list(levels)))
    if services is not None:
        df = df.where(F.col("service_type").isin(list(services)))
    if instances is not None:
        df = df.where(F.col("instance_id").isNotNull() & F.col("instance_id").isin(list(instances)))
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(str(start)).cast("timestamp_ntz"))
        if "date" in df.columns:
            df = df.where(F.col("date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        next_day = F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz")
        df = df.where(F.col("timestamp") < next_day)
        if "date" in df.columns:
            df = df.where(F.col("date") <= F.lit(str(end)).cast("date"))
    if text:
        df = df.where(contains_ignoring_case(F.col("message"), text))
    return df


def keyword_counts(df: DataFrame, keywords: list[str], order: str = "log_id") -> DataFrame:
    """Rows whose message contains each keyword, and the first such message.

    One pass: every keyword is a pair of aggregates, unpivoted afterwards.
    """
    aggregates = []
    for i, word in enumerate(keywords):
        hit = contains_ignoring_case(F.col("message"), word)
        aggregates += [
            F.count_if(hit).alias(f"n{i}"),
            F.min_by("message", F.when(hit, F.col(order))).alias(f"s{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("matches"), F.col(f"s{i}").alias("sample"))
        for i, w in enumerate(keywords)
    ])
    return df.agg(*aggregates).select(F.inline(rows)).where("matches > 0")


def search_by_meta(df: DataFrame, order: str = "log_id", **equals) -> DataFrame:
    """Rows whose metadata equal the given values, newest first."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.col("timestamp").desc_nulls_last(), order)
