"""Deviation of rows from whole-table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions.temporal import flag


def moments(df: DataFrame, column: str) -> Column:
    """Mean and sample standard deviation of a whole column, as a one-row subquery."""
    value = F.col(column).cast("double")
    return df.select(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ).scalar()


def zscore(value: Column, stats: Column) -> Column:
    return F.abs(F.try_divide(value - stats["mean"], stats["sd"]))


def above(value: Column, stats: Column, deviations: float) -> Column:
    return flag(value > stats["mean"] + F.lit(float(deviations)) * stats["sd"])


def message_length_anomaly(df: DataFrame, stats_from: DataFrame | None = None) -> DataFrame:
    stats = moments(df if stats_from is None else stats_from, "message_length")
    value = F.col("message_length")
    return df.withColumns({
        "message_length_zscore": zscore(value, stats),
        "is_long_message": above(value, stats, 2),
    })


def time_gap_anomaly(df: DataFrame, stats_from: DataFrame | None = None) -> DataFrame:
    stats = moments(df if stats_from is None else stats_from, "time_since_prev")
    value = F.col("time_since_prev")
    return df.withColumns({
        "time_diff_zscore": zscore(value, stats),
        "is_time_gap": above(value, stats, 3),
    })


def minute_moments(df: DataFrame) -> Column:
    """Mean and deviation of rows-per-minute taken over rows, from the table of minutes.

    With n rows in a minute: sum(n) rows, sum(n*n) their total, sum(n*n*n) their squares.
    """
    n = F.col("n").cast("double")
    minutes = (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(F.date_trunc("minute", "timestamp").alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sums = minutes.agg(F.sum(n).alias("a"), F.sum(n * n).alias("b"), F.sum(n * n * n).alias("c"))
    mean = F.try_divide(F.col("b"), F.col("a"))
    spread = F.greatest(F.col("c") - F.col("b") * mean, F.lit(0.0))
    return sums.select(
        F.struct(
            mean.alias("mean"),
            F.sqrt(F.try_divide(spread, F.col("a") - 1)).alias("sd"),
        )
    ).scalar()


def minute_frequency(indexed: DataFrame, stats_from: DataFrame) -> DataFrame:
    """Rows per minute and whether that is unusually many.

    ``indexed`` carries ``_minute_rows`` from the global order, so no further join is needed.
    """
    stats = minute_moments(stats_from)
    known = F.col("timestamp").isNotNull()
    per_minute = F.when(known, F.col("_minute_rows"))
    return indexed.withColumns({
        "minute_bucket": F.date_trunc("minute", "timestamp").cast("timestamp_ntz"),
        "logs_per_minute": per_minute,
        "is_high_frequency": above(per_minute, stats, 2),
    })


def scale(df: DataFrame, columns: list[str], kind: str = "standard") -> DataFrame:
    """Standard (population deviation) or min-max scaling; constant columns become 0."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler: {kind}")
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        if kind == "standard":
            low, width = F.avg(value), F.stddev_pop(value)
        else:
            low, width = F.min(value), F.max(value) - F.min(value)
        parts.append(F.struct(low.alias("low"), width.alias("width")).alias(name))
    stats = df.select(F.struct(*parts)).scalar()
    return df.withColumns({
        name: F.when(stats[name]["width"] == 0, F.col(name) * 0.0).otherwise(
            (F.col(name).cast("double") - stats[name]["low"]) / stats[name]["width"]
        )
        for name in columns
    })


def model_matrix(features: DataFrame, key: str = "log_id", columns: list[str] | None = None, kind: str = "standard") -> DataFrame:
    """The key with the columns a model is fed (``dims.MODEL_COLUMNS``), as scaled doubles; missing values count as 0.

    ``features`` are read twice, so they should be a table.
    """
    names = dims.MODEL_COLUMNS if columns is None else columns
    filled = features.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return scale(filled, names, kind)
