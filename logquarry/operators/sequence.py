"""Features of neighbouring rows in the global order, as functions of an ordered window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.temporal import flag, seconds_between
from logquarry.operators.ordering import MINUTE_FACTS, over_blocks, with_global_index

ERROR = "ERROR"
TRAILING = (5, 10, 20)
CENTRED = (3, 5, 10)


def is_error() -> Column:
    return flag(F.col("level") == ERROR)


def trailing(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


def centred(w, n: int):
    """``n`` rows around the current one; even sizes reach one row further back."""
    return w.rowsBetween(-(n // 2), (n - 1) // 2)


def changed(a: Column, b: Column) -> Column:
    """1 unless both are known and equal."""
    return F.coalesce((a != b).cast("int"), F.lit(1))


def same(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("int"), F.lit(0))


def time_since_prev(w) -> dict[str, Column]:
    ts = F.col("timestamp")
    return {"time_since_prev": F.coalesce(seconds_between(ts, F.lag(ts).over(w)), F.lit(0.0))}


def level_transitions(w) -> dict[str, Column]:
    level = F.col("level")
    prev = F.lag(level).over(w)
    return {
        "prev_level": prev,
        "next_level": F.lead(level).over(w),
        "level_changed": changed(level, prev),
        "escalated_to_error": flag((prev == "INFO") & (level == ERROR)),
    }


def service_transitions(w) -> dict[str, Column]:
    service, instance = F.col("service_type"), F.col("instance_id")
    prev_service, prev_instance = F.lag(service).over(w), F.lag(instance).over(w)
    return {
        "prev_service": prev_service,
        "service_changed": changed(service, prev_service),
        "prev_instance": prev_instance,
        "same_instance": same(instance, prev_instance),
    }


def rolling_rates(w) -> dict[str, Column]:
    out = {}
    for n in TRAILING:
        frame = trailing(w, n)
        out[f"error_rate_last_{n}"] = F.avg(is_error().cast("double")).over(frame)
        out[f"message_length_avg_last_{n}"] = F.avg(F.col("message_length").cast("double")).over(frame)
    return out


def error_burst(w) -> dict[str, Column]:
    errors = F.sum(is_error()).over(trailing(w, 10))
    return {
        "is_error": is_error(),
        "error_burst": errors.cast("double"),
        "is_error_burst": (errors >= 5).cast("int"),
    }


def context_errors(w) -> dict[str, Column]:
    return {
        f"errors_in_context_{n}": F.sum(is_error()).over(centred(w, n)).cast("double")
        for n in CENTRED
    }


def context_services(w) -> dict[str, Column]:
    """Distinct services around the row, nulls ignored."""
    return {
        f"services_in_context_{n}": F.size(F.collect_set("service_type").over(centred(w, n))).cast("double")
        for n in CENTRED
    }


def context_instances(w) -> dict[str, Column]:
    """Distinct instances around the row, null counting as one more."""
    filled = F.coalesce(F.col("instance_id"), F.lit("__missing__"))
    return {
        f"instances_in_context_{n}": F.size(F.collect_set(filled).over(centred(w, n))).cast("double")
        for n in CENTRED
    }


def sequence_features(df: DataFrame, frames, tiebreak=("log_id",), **options) -> DataFrame:
    """Index the rows, then add the columns of one frame builder or of several."""
    builders = frames if isinstance(frames, (list, tuple)) else [frames]

    def build(w: Window) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for builder in builders:
            out.update(builder(w))
        return out

    return over_blocks(with_global_index(df, tiebreak=tiebreak), build, **options)


def bucket_positions(df: DataFrame, tiebreak=("log_id",)) -> DataFrame:
    """Position of each row within its calendar minute and hour, from 1; null without a time.

    Both follow from the global number and the first number of the minute or hour.
    """
    indexed = with_global_index(df, tiebreak=tiebreak, keep_groups=True)
    return add_bucket_positions(indexed).drop(*MINUTE_FACTS)


def add_bucket_positions(indexed: DataFrame) -> DataFrame:
    known = F.col("timestamp").isNotNull()
    number = F.col("log_sequence_id")
    return indexed.withColumns({
        "logs_in_last_minute": F.when(known, number - F.col("_minute_start") + 1),
        "logs_in_last_hour": F.when(known, number - F.col("_hour_start") + 1),
    })
