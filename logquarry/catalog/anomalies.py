"""Queries of anomaly features, scaling and the full feature plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry import dims
from logquarry.catalog.projections import SQL_DOW, SQL_HOUR, sql_flag
from logquarry.catalog.registry import query
from logquarry.catalog.views import logs, with_logs
from logquarry.catalog.windows import W, rows
from logquarry.functions import text
from logquarry.operators import anomaly, sequence
from logquarry.operators.ordering import with_global_index
from logquarry.plans.features import engineer_all
from logquarry.session import stage

SQL_GAP = f"coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) {W}, 0) / 1e6"


@query("zscore_length", with_logs("""
  SELECT log_id, round(abs((length(message) - m) / s), 6) AS message_length_zscore,
    CAST(length(message) > m + 2 * s AS INT) AS is_long_message
  FROM logs, (SELECT avg(length(message)) AS m, stddev_samp(length(message)) AS s FROM logs)"""))
def zscore_length(spark, sf):
    df = logs(spark, sf).withColumn("message_length", text.counts(F.col("message"))["message_length"])
    return anomaly.message_length_anomaly(df).select(
        "log_id", F.round("message_length_zscore", 6).alias("message_length_zscore"), "is_long_message")


@query("time_gap", with_logs("""
  SELECT log_id, round(abs((g - m) / s), 6) AS time_diff_zscore, CAST(g > m + 3 * s AS INT) AS is_time_gap
  FROM gaps, (SELECT avg(g) AS m, stddev_samp(g) AS s FROM gaps)""",
    ("gaps", f"SELECT log_id, {SQL_GAP} AS g FROM logs")))
def time_gap(spark, sf):
    return anomaly.time_gap_anomaly(sequence.sequence_features(logs(spark, sf), sequence.time_since_prev)).select(
        "log_id", F.round("time_diff_zscore", 6).alias("time_diff_zscore"), "is_time_gap")


@query("high_frequency", with_logs("""
  SELECT log_id, minute_bucket, logs_per_minute, CAST(logs_per_minute > m + 2 * s AS INT) AS is_high_frequency
  FROM per, (SELECT avg(logs_per_minute) AS m, stddev_samp(logs_per_minute) AS s FROM per)""",
    ("per", "SELECT log_id, date_trunc('minute', timestamp) AS minute_bucket, "
            "count(*) OVER (PARTITION BY date_trunc('minute', timestamp)) AS logs_per_minute FROM logs")))
def high_frequency(spark, sf):
    df = logs(spark, sf)
    return anomaly.minute_frequency(with_global_index(df, keep_groups=True), df).select(
        "log_id", "minute_bucket", "logs_per_minute", "is_high_frequency")


SCALED = ["message_length", "word_count", "number_count", "uppercase_count", "hour", "day_of_week"]
SQL_SCALED = ("SELECT log_id, CAST(length(message) AS DOUBLE) AS message_length, "
              "CAST(len(regexp_extract_all(message, '[^ ]+')) AS DOUBLE) AS word_count, "
              "CAST(len(regexp_extract_all(message, '[0-9]')) AS DOUBLE) AS number_count, "
              "CAST(len(regexp_extract_all(message, '[A-Z]')) AS DOUBLE) AS uppercase_count, "
              f"CAST({SQL_HOUR} AS DOUBLE) AS hour, CAST({SQL_DOW} AS DOUBLE) AS day_of_week FROM logs")


def _scaled(spark, sf, kind):
    counts = text.counts(F.col("message"))
    df = logs(spark, sf).select(
        "log_id", *[counts[c].alias(c) for c in SCALED[:4]],
        F.hour("timestamp").alias("hour"), F.weekday("timestamp").alias("day_of_week"))
    return anomaly.scale(df, SCALED, kind).select("log_id", *[F.round(c, 6).alias(c) for c in SCALED])


@query("scale_standard", with_logs(
    " SELECT log_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED)
    + " FROM x", ("x", SQL_SCALED)))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", with_logs(
    " SELECT log_id, " + ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in SCALED)
    + " FROM x", ("x", SQL_SCALED)))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


# --- all features ----------------------------------------------------------------------

RANK_IN = "row_number() OVER (PARTITION BY {0} ORDER BY timestamp, log_id)"
ERR = "CAST(level = 'ERROR' AS INT)"
INSTANCE = "OVER (PARTITION BY instance_id)"
REQUEST = "OVER (PARTITION BY request_id)"


def _if_instance(expr: str) -> str:
    return f"CASE WHEN instance_id IS NOT NULL THEN {expr} END"


def _if_request(expr: str, default: str) -> str:
    return f"CASE WHEN request_id IS NOT NULL THEN {expr} ELSE {default} END"


def all_features() -> dict[str, str]:
    """SQL of each engineered column over the log table, plus gap and per-minute counts."""
    f = {
        "hour": SQL_HOUR, "day_of_week": SQL_DOW, "day_of_month": "CAST(day(timestamp) AS INT)",
        "month": "CAST(month(timestamp) AS INT)", "minute": "CAST(minute(timestamp) AS INT)",
        "second": "CAST(second(timestamp) AS INT)", "is_weekend": sql_flag(f"{SQL_DOW} >= 5"),
        "is_business_hours": sql_flag(f"{SQL_HOUR} BETWEEN 9 AND 17"),
        "is_night": sql_flag(f"{SQL_HOUR} >= 22 OR {SQL_HOUR} <= 6"),
        "time_since_prev": f"round({SQL_GAP}, 6)",
        "logs_in_last_minute": RANK_IN.format("date_trunc('minute', timestamp)"),
        "logs_in_last_hour": RANK_IN.format("date_trunc('hour', timestamp)"),
        "message_length": "CAST(length(message) AS INT)", "char_count": "CAST(length(message) AS INT)",
        "word_count": "CAST(len(regexp_extract_all(message, '[^ ]+')) AS INT)",
        "number_count": "CAST(len(regexp_extract_all(message, '[0-9]')) AS INT)",
        "uppercase_count": "CAST(len(regexp_extract_all(message, '[A-Z]')) AS INT)",
        "special_char_count": "CAST(len(regexp_extract_all(message, '[^a-zA-Z0-9 ]')) AS INT)",
        "has_url": sql_flag("regexp_matches(message, '(?i)https?://')"),
        "has_ip": sql_flag(r"regexp_matches(message, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')"),
    }
    for word in dims.ERROR_WORDS:
        f[f"has_{word}"] = sql_flag(f"contains(lower(message), '{word}')")
    for word in dims.RESOURCE_WORDS:
        f[f"mentions_{word}"] = sql_flag(f"contains(lower(message), '{word}')")
    f |= {
        "log_sequence_id": f"row_number() {W} - 1",
        "prev_level": f"lag(level) {W}", "next_level": f"lead(level) {W}",
        "level_changed": f"coalesce(CAST(level <> lag(level) {W} AS INT), 1)",
        "escalated_to_error": sql_flag(f"lag(level) {W} = 'INFO' AND level = 'ERROR'"),
        "prev_service": f"lag(service_type) {W}",
        "service_changed": f"coalesce(CAST(service_type <> lag(service_type) {W} AS INT), 1)",
        "prev_instance": f"lag(instance_id) {W}",
        "same_instance": f"coalesce(CAST(instance_id = lag(instance_id) {W} AS INT), 0)",
    }
    for n in sequence.TRAILING:
        f[f"error_rate_last_{n}"] = f"round(avg({ERR}) {rows(n - 1)}, 6)"
        f[f"message_length_avg_last_{n}"] = f"round(avg(length(message)) {rows(n - 1)}, 6)"
    f |= {
        "instance_error_count": _if_instance(f"CAST(sum({ERR}) {INSTANCE} AS BIGINT)"),
        "instance_log_count": _if_instance(f"count(message) {INSTANCE}"),
        "instance_first_seen": _if_instance(f"min(timestamp) {INSTANCE}"),
        "instance_last_seen": _if_instance(f"max(timestamp) {INSTANCE}"),
        "instance_lifespan": _if_instance(
            f"round((epoch_us(max(timestamp) {INSTANCE}) - epoch_us(min(timestamp) {INSTANCE})) / 1e6, 6)"),
        "instance_error_rate": _if_instance(f"round(sum({ERR}) {INSTANCE} / count(message) {INSTANCE}, 6)"),
        "is_new_instance": f"instance_id IS NOT NULL AND {RANK_IN.format('instance_id')} = 1",
        "instance_log_position": _if_instance(RANK_IN.format("instance_id")),
        "minute_bucket": "date_trunc('minute', timestamp)",
        "logs_per_minute": "count(*) OVER (PARTITION BY date_trunc('minute', timestamp))",
        "is_error": ERR, "error_burst": f"CAST(sum({ERR}) {rows(9)} AS DOUBLE)",
        "is_error_burst": f"CAST(sum({ERR}) {rows(9)} >= 5 AS INT)",
    }
    for n, b, a in [(3, 1, 1), (5, 2, 2), (10, 5, 4)]:
        f[f"errors_in_context_{n}"] = f"CAST(sum({ERR}) {rows(b, a)} AS DOUBLE)"
        f[f"services_in_context_{n}"] = f"CAST(count(DISTINCT service_type) {rows(b, a)} AS DOUBLE)"
        f[f"instances_in_context_{n}"] = (
            f"CAST(count(DISTINCT coalesce(instance_id, '__missing__')) {rows(b, a)} AS DOUBLE)")
    f |= {
        "request_error_count": _if_request(f"CAST(sum({ERR}) {REQUEST} AS DOUBLE)", "0.0"),
        "request_log_count": _if_request(f"CAST(count(message) {REQUEST} AS DOUBLE)", "1.0"),
        "request_error_rate": _if_request(f"round(sum({ERR}) {REQUEST} / count(message) {REQUEST}, 6)", "0.0"),
    }
    return f


ROUNDED = ["time_since_prev", "instance_lifespan", "instance_error_rate", "request_error_rate",
           "message_length_zscore", "time_diff_zscore",
           *[f"error_rate_last_{n}" for n in sequence.TRAILING],
           *[f"message_length_avg_last_{n}" for n in sequence.TRAILING]]

SQL_ALL = with_logs(
    """ SELECT f.*, round(abs((message_length - lm) / ls), 6) AS message_length_zscore,
      CAST(message_length > lm + 2 * ls AS INT) AS is_long_message,
      round(abs((gap - gm) / gs), 6) AS time_diff_zscore, CAST(gap > gm + 3 * gs AS INT) AS is_time_gap,
      CAST(logs_per_minute > nm + 2 * ns AS INT) AS is_high_frequency
    FROM (SELECT * EXCLUDE (gap), gap FROM f) f, (SELECT avg(message_length) AS lm, stddev_samp(message_length) AS ls,
      avg(gap) AS gm, stddev_samp(gap) AS gs, avg(logs_per_minute) AS nm, stddev_samp(logs_per_minute) AS ns FROM f)""",
    ("f", "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in all_features().items())
          + f", {SQL_GAP} AS gap FROM logs"))
SQL_ALL = f"SELECT * EXCLUDE (gap) FROM ({SQL_ALL})"


@query("engineer_all", SQL_ALL)
def engineered(spark, sf):
    out = engineer_all(logs(spark, sf), materialize=stage)
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED})


def _sql_scaled(name: str) -> str:
    x = f"coalesce(CAST({name} AS DOUBLE), 0)"
    return (f"CASE WHEN stddev_pop({x}) OVER () = 0 THEN 0 ELSE round(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER (), 4) END AS {name}")


@query("model_matrix", "SELECT log_id, " + ", ".join(map(_sql_scaled, dims.MODEL_COLUMNS)) + f" FROM ({SQL_ALL})")
def model_matrix(spark, sf):
    """The 26 columns of the model, scaled, for every line."""
    features = engineer_all(logs(spark, sf), materialize=stage, only=dims.MODEL_COLUMNS).select("log_id", *dims.MODEL_COLUMNS)
    return anomaly.model_matrix(stage(features)).select("log_id", *[F.round(c, 4).alias(c) for c in dims.MODEL_COLUMNS])
