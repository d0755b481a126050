"""Queries of the global order: sequence, position and context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.catalog.registry import query
from logquarry.catalog.views import logs, with_logs
from logquarry.functions import text
from logquarry.operators import sequence
from logquarry.operators.keyed import instance_positions
from logquarry.operators.ordering import sort_logs, with_global_index

W = "OVER (ORDER BY timestamp, log_id)"


def rows(n_before: int, n_after: int = 0) -> str:
    return f"OVER (ORDER BY timestamp, log_id ROWS BETWEEN {n_before} PRECEDING AND {n_after} FOLLOWING)"


def _over_logs(columns: str) -> str:
    return with_logs(f" SELECT log_id, {columns} FROM logs")


def _features(spark, sf, frames, *names):
    df = sequence.sequence_features(logs(spark, sf), frames)
    return df.select("log_id", *names)


@query("time_since_prev", _over_logs(
    f"round(coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) {W}, 0) / 1e6, 6) AS time_since_prev"))
def time_since_prev(spark, sf):
    return _features(spark, sf, sequence.time_since_prev, F.round("time_since_prev", 6).alias("time_since_prev"))


@query("bucket_position", with_logs("""
  SELECT log_id,
    row_number() OVER (PARTITION BY date_trunc('minute', timestamp) ORDER BY timestamp, log_id) AS logs_in_last_minute,
    row_number() OVER (PARTITION BY date_trunc('hour', timestamp) ORDER BY timestamp, log_id) AS logs_in_last_hour
  FROM logs"""))
def bucket_position(spark, sf):
    return sequence.bucket_positions(logs(spark, sf)).select(
        "log_id", "logs_in_last_minute", "logs_in_last_hour")


@query("log_sequence_id", _over_logs(f"row_number() {W} - 1 AS log_sequence_id"))
def log_sequence_id(spark, sf):
    return with_global_index(logs(spark, sf)).select("log_id", "log_sequence_id")


@query("level_transitions", _over_logs(f"""
  lag(level) {W} AS prev_level, lead(level) {W} AS next_level,
  coalesce(CAST(level <> lag(level) {W} AS INT), 1) AS level_changed,
  coalesce(CAST(lag(level) {W} = 'INFO' AND level = 'ERROR' AS INT), 0) AS escalated_to_error"""))
def level_transitions(spark, sf):
    return _features(spark, sf, sequence.level_transitions,
                     "prev_level", "next_level", "level_changed", "escalated_to_error")


@query("service_transitions", _over_logs(f"""
  lag(service_type) {W} AS prev_service,
  coalesce(CAST(service_type <> lag(service_type) {W} AS INT), 1) AS service_changed,
  lag(instance_id) {W} AS prev_instance,
  coalesce(CAST(instance_id = lag(instance_id) {W} AS INT), 0) AS same_instance"""))
def service_transitions(spark, sf):
    return _features(spark, sf, sequence.service_transitions,
                     "prev_service", "service_changed", "prev_instance", "same_instance")


@query("rolling_rates", _over_logs(", ".join(
    f"round(avg(CAST(level = 'ERROR' AS INT)) {rows(n - 1)}, 6) AS error_rate_last_{n}, "
    f"round(avg(length(message)) {rows(n - 1)}, 6) AS message_length_avg_last_{n}"
    for n in sequence.TRAILING)))
def rolling_rates(spark, sf):
    df = logs(spark, sf).withColumn("message_length", text.counts(F.col("message"))["message_length"])
    names = [f"{p}_{n}" for n in sequence.TRAILING for p in ("error_rate_last", "message_length_avg_last")]
    return sequence.sequence_features(df, sequence.rolling_rates).select(
        "log_id", *[F.round(c, 6).alias(c) for c in names])


@query("instance_position", with_logs("""
  SELECT log_id, instance_id,
    CASE WHEN instance_id IS NULL THEN NULL ELSE
      row_number() OVER (PARTITION BY instance_id ORDER BY timestamp, log_id) END AS instance_log_position,
    coalesce(instance_id IS NOT NULL AND
      row_number() OVER (PARTITION BY instance_id ORDER BY timestamp, log_id) = 1, false) AS is_new_instance
  FROM logs"""))
def instance_position(spark, sf):
    return instance_positions(logs(spark, sf)).select(
        "log_id", "instance_id", "instance_log_position", "is_new_instance")


@query("error_burst", _over_logs(f"""
  CAST(level = 'ERROR' AS INT) AS is_error,
  CAST(sum(CAST(level = 'ERROR' AS INT)) {rows(9)} AS DOUBLE) AS error_burst,
  CAST(sum(CAST(level = 'ERROR' AS INT)) {rows(9)} >= 5 AS INT) AS is_error_burst"""))
def error_burst(spark, sf):
    return _features(spark, sf, sequence.error_burst, "is_error", "error_burst", "is_error_burst")


@query("context_errors", _over_logs(", ".join(
    f"CAST(sum(CAST(level = 'ERROR' AS INT)) {rows(b, a)} AS DOUBLE) AS errors_in_context_{n}"
    for n, b, a in [(3, 1, 1), (5, 2, 2), (10, 5, 4)])))
def context_errors(spark, sf):
    return _features(spark, sf, sequence.context_errors, *[f"errors_in_context_{n}" for n in (3, 5, 10)])


@query("context_services", _over_logs(", ".join(
    f"CAST(count(DISTINCT service_type) {rows(b, a)} AS DOUBLE) AS services_in_context_{n}"
    for n, b, a in [(3, 1, 1), (5, 2, 2), (10, 5, 4)])))
def context_services(spark, sf):
    return _features(spark, sf, sequence.context_services, *[f"services_in_context_{n}" for n in (3, 5, 10)])


@query("context_instances", _over_logs(", ".join(
    f"CAST(count(DISTINCT coalesce(instance_id, '__missing__')) {rows(b, a)} AS DOUBLE) AS instances_in_context_{n}"
    for n, b, a in [(3, 1, 1), (5, 2, 2), (10, 5, 4)])))
def context_instances(spark, sf):
    return _features(spark, sf, sequence.context_instances, *[f"instances_in_context_{n}" for n in (3, 5, 10)])


@query("sort_logs", with_logs(
    " SELECT log_id, timestamp, level, message FROM logs ORDER BY timestamp NULLS LAST, log_id"))
def sorted_logs(spark, sf):
    return sort_logs(logs(spark, sf), "log_id").select("log_id", "timestamp", "level", "message")
