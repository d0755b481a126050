"""Statistics per instance and per request, and their join back to the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.temporal import seconds_between
from logquarry.operators.ordering import BLOCK_ROWS, with_global_index
from logquarry.operators.sequence import is_error
from logquarry.operators.skew import spread_join

BLOCKS_PER_SPAN = 1_000


def instance_stats(df: DataFrame) -> DataFrame:
    """Per instance: errors, rows, first and last time, life span in seconds, error rate."""
    stats = df.where(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(
        F.sum(is_error()).alias("instance_error_count"),
        F.count("message").alias("instance_log_count"),
        F.min("timestamp").alias("instance_first_seen"),
        F.max("timestamp").alias("instance_last_seen"),
    )
    return with_instance_rates(stats)


def with_instance_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "instance_lifespan": F.coalesce(
            seconds_between(F.col("instance_last_seen"), F.col("instance_first_seen")), F.lit(0.0)
        ),
        "instance_error_rate": F.coalesce(
            F.try_divide(F.col("instance_error_count"), F.col("instance_log_count")), F.lit(0.0)
        ),
    })


def request_stats(df: DataFrame, *more: Column) -> DataFrame:
    """Per request: errors, rows, error rate, and further aggregates."""
    stats = df.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.sum(is_error()).alias("request_error_count"),
        F.count("message").alias("request_log_count"),
        *more,
    )
    return stats.withColumn(
        "request_error_rate",
        F.coalesce(
            F.try_divide(F.col("request_error_count"), F.col("request_log_count")), F.lit(0.0)
        ),
    )


def add_request_stats(
    df: DataFrame, stats_from: DataFrame | None = None, materialize: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Left join of the request statistics; rows without a request get 0 / 1 / 0 and stay out of the join.

    A request that holds much of the table is cut into pieces (``spread_join``). With ``materialize``
    the statistics are a table of their own, which the join and the list of such requests read.
    """
    rows = df if stats_from is None else stats_from
    stats = request_stats(rows, F.count(F.lit(1)).alias("_rows"))
    if materialize is not None:
        stats = materialize(stats)
    salt = next((F.col(c) for c in ("log_sequence_id", "log_id") if c in df.columns), F.struct(*df.columns))
    joined = spread_join(df.where(F.col("request_id").isNotNull()), stats, "request_id", "_rows", salt).drop(
        "_rows").unionByName(df.where(F.col("request_id").isNull()), allowMissingColumns=True)
    return joined.withColumns({
        "request_error_count": F.coalesce("request_error_count", F.lit(0)).cast("double"),
        "request_log_count": F.coalesce("request_log_count", F.lit(1)).cast("double"),
        "request_error_rate": F.coalesce("request_error_rate", F.lit(0.0)),
    })


def number_in_block(blocked: DataFrame, index: str = "log_sequence_id") -> DataFrame:
    """Adds ``_in_block``: the row's place among the rows of its instance in its block."""
    inside = Window.partitionBy("_block", "instance_id").orderBy(index)
    return blocked.withColumn("_in_block", F.row_number().over(inside))


def add_instance_features(
    blocked: DataFrame, stats_from: DataFrame | None = None, blocks_per_span: int = BLOCKS_PER_SPAN
) -> DataFrame:
    """Statistics of the row's instance and the row's position in it.

    ``blocked`` has ``_block`` and ``_in_block``; ``stats_from`` (the same rows by default) has
    ``_block``. Rows are counted per instance and block, and running sums over those counts
    give each block its first position, so an instance that holds much of the table is spread
    over all its blocks. Joining on both keys also spreads the rows without an instance. The
    sums run in two levels, over spans of blocks and over the blocks of a span, so the blocks of one
    instance are not one task's work either.
    """
    rows = blocked if stats_from is None else stats_from
    per_block = rows.where(F.col("instance_id").isNotNull()).groupBy("instance_id", "_block").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(is_error()).alias("_errors"),
        F.count("message").alias("_messages"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
    ).withColumn("_span", F.call_function("div", F.col("_block"), F.lit(blocks_per_span)))
    per_span = per_block.groupBy("instance_id", "_span").agg(
        F.sum("_rows").alias("_rows"), F.sum("_errors").alias("_errors"), F.sum("_messages").alias("_messages"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    whole = Window.partitionBy("instance_id")
    upto = Window.unboundedPreceding, -1
    spans = per_span.select(
        "instance_id",
        "_span",
        F.coalesce(F.sum("_rows").over(whole.orderBy("_span").rowsBetween(*upto)), F.lit(0)).alias("_span_before"),
        F.sum("_errors").over(whole).alias("instance_error_count"),
        F.sum("_messages").over(whole).alias("instance_log_count"),
        F.min("_first").over(whole).alias("instance_first_seen"),
        F.max("_last").over(whole).alias("instance_last_seen"),
    )
    inside = Window.partitionBy("instance_id", "_span").orderBy("_block").rowsBetween(*upto)
    blocks = per_block.select(
        "instance_id", "_span", "_block", F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_block_before"))
    stats = with_instance_rates(
        blocks.join(spans, ["instance_id", "_span"])
        .withColumn("_instance_before", F.col("_span_before") + F.col("_block_before"))
        .drop("_span", "_span_before", "_block_before")
    )
    position = F.when(F.col("instance_id").isNotNull(), F.col("_instance_before") + F.col("_in_block"))
    return (
        blocked.join(stats, ["instance_id", "_block"], "left")
        .withColumn("instance_log_position", position)
        .withColumn("is_new_instance", F.coalesce(F.col("instance_log_position") == 1, F.lit(False)))
        .drop("_instance_before", "_in_block", "_block")
    )


def instance_positions(df: DataFrame, tiebreak=("log_id",), block_rows: int = BLOCK_ROWS,
                       blocks_per_span: int = BLOCKS_PER_SPAN) -> DataFrame:
    indexed = with_global_index(df, tiebreak=tiebreak)
    blocked = indexed.withColumn("_block", F.call_function("div", F.col("log_sequence_id"), F.lit(block_rows)))
    return add_instance_features(number_in_block(blocked), blocked, blocks_per_span)
