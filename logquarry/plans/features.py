"""All features of a log table in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import temporal, text
from logquarry.operators import anomaly, keyed, sequence
from logquarry.operators.ordering import MINUTE_FACTS, over_blocks, with_global_index

FRAMES = [
    sequence.time_since_prev,
    sequence.level_transitions,
    sequence.service_transitions,
    sequence.rolling_rates,
    sequence.error_burst,
    sequence.context_errors,
    sequence.context_services,
    sequence.context_instances,
]


def temporal_features(df: DataFrame) -> DataFrame:
    return df.withColumns(temporal.parts(F.col("timestamp")))


def text_features(df: DataFrame) -> DataFrame:
    return df.withColumns(text.counts(F.col("message"))).withColumns(text.flags(F.col("message")))


def with_length(df: DataFrame) -> DataFrame:
    return df.withColumn("message_length", text.counts(F.col("message"))["message_length"])


def frames(w) -> dict:
    """All columns that look at neighbouring rows."""
    out = {}
    for build in FRAMES:
        out.update(build(w))
    return out


def engineer_all(
    df: DataFrame,
    tiebreak: tuple[str, ...] = ("log_id",),
    materialize: Callable[[DataFrame], DataFrame] | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """The 77 features.

    Rows are shuffled once by order and once by block, with the one text feature that frames need;
    the others are added at the end. The tables per (instance, block) and per request are
    pre-aggregated and joined back. Whole-table means and deviations are scalar subqueries.
    ``materialize`` may write the framed rows to a table and return its reader; the statistics then
    read that table instead of repeating the frames. With ``only``, frames that are neither asked for nor built
    upon are left out of it and of the result.
    """
    rows = with_length(df)
    indexed = sequence.add_bucket_positions(
        with_global_index(rows, tiebreak=tiebreak, keep_groups=True)
    )
    blocked = over_blocks(indexed, frames, keep_block=True)
    if only is not None:
        blocked = blocked.drop(*set(blocked.columns).difference(indexed.columns, ["_block", "time_since_prev"], only))
    framed = keyed.number_in_block(blocked)
    if materialize is None:
        return complete(framed, rows)
    return complete(materialize(framed), materialize=materialize)


def complete(framed: DataFrame, stats_from: DataFrame | None = None,
             materialize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The features beyond row frames. Statistics read ``stats_from``, by default the framed rows, which are then a table."""
    rows = framed if stats_from is None else stats_from
    with_instances = keyed.add_instance_features(framed)
    with_requests = keyed.add_request_stats(with_instances, stats_from=rows, materialize=materialize)
    out = anomaly.message_length_anomaly(with_requests, stats_from=rows)
    out = anomaly.time_gap_anomaly(out, stats_from=framed)
    out = anomaly.minute_frequency(out, stats_from=rows)
    return text_features(temporal_features(out.drop(*MINUTE_FACTS)))
