"""Queries that run a stream over the written log files to its end and read its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.catalog.registry import query
from logquarry.catalog.sources import written_files
from logquarry.catalog.views import SQL_RAW, raw_lines, with_logs
from logquarry.functions.temporal import micros
from logquarry.session import scratch_path, stage
from logquarry.sources.files import parse_lines
from logquarry.streaming import jobs


def drained(spark, stream, name):
    out = scratch_path(spark, name)
    running = jobs.to_table(stream, f"{out}/rows", f"{out}/checkpoint", available_now=True)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("str_parse", with_logs(
    " SELECT timestamp, level, message, service_type, instance_id, request_id FROM logs"))
def str_parse(spark, sf):
    parsed = jobs.read_stream(spark, written_files(spark, sf))
    return drained(spark, parsed, "str-parse").select(
        "timestamp", "level", "message", "service_type", "instance_id", "request_id")


@query("str_dedup", with_logs("""
  SELECT timestamp, level, concat(message, tail) AS message, service_type, instance_id
  FROM logs, (VALUES (''), (concat(repeat('.', 120), 'x')), (concat(repeat('.', 120), 'y'))) AS v(tail)"""))
def str_dedup(spark, sf):
    """Every line arrives twice, and in two longer forms that differ in the last character only."""
    lines = jobs.read_stream(spark, written_files(spark, sf))
    tails = ["", "", "." * 120 + "x", "." * 120 + "y"]
    more = lines.withColumn("_tail", F.explode(F.array(*[F.lit(t) for t in tails]))).withColumns(
        {c: F.concat(c, "_tail") for c in ("message", "raw_log")}).drop("_tail")
    return drained(spark, jobs.dedup(more), "str-dedup").select(
        "timestamp", "level", "message", "service_type", "instance_id")


@query("str_level_counts", with_logs("""
  SELECT date_trunc('hour', timestamp) AS window_start, level, count(*) AS n FROM logs
  WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTES FROM logs)
  GROUP BY 1, 2"""))
def str_level_counts(spark, sf):
    """Closed windows only: the watermark has passed their end."""
    stream = jobs.level_counts(jobs.read_stream(spark, written_files(spark, sf)), "1 hour")
    return drained(spark, stream, "str-levels").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "level", "n")


@query("str_error_rates", with_logs("""
  SELECT window_start, count(*) AS n, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS errors,
    round(100.0 * count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) / count(*), 6) AS error_percent
  FROM (SELECT level, time_bucket(INTERVAL '30 minutes', timestamp, TIMESTAMP '1970-01-01') - to_minutes(30 * unnest([0, 1])) AS window_start FROM logs)
  WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTES FROM logs) GROUP BY 1"""))
def str_error_rates(spark, sf):
    stream = jobs.error_rates(jobs.read_stream(spark, written_files(spark, sf)))
    return drained(spark, stream, "str-rates").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "errors",
        F.round("error_percent", 6).alias("error_percent"))


@query("str_instance_stats", with_logs("""
  SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS period_start, instance_id, count(*) FILTER (WHERE level = 'ERROR') AS errors,
    count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM logs WHERE instance_id IS NOT NULL
    AND date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 10 MINUTES FROM logs WHERE instance_id IS NOT NULL)
  GROUP BY 1, 2"""))
def str_instance_stats(spark, sf):
    """Statistics per instance and closed day."""
    stream = jobs.instance_statistics(jobs.read_stream(spark, written_files(spark, sf)))
    return drained(spark, stream, "str-instances").select(
        F.col("period_start").cast("timestamp_ntz").alias("period_start"), "instance_id", "errors", "n", "first_seen", "last_seen")


@query("str_error_burst", with_logs("""
  SELECT timestamp, level, message, CAST(sum(CAST(level = 'ERROR' AS INT)) OVER w AS DOUBLE) AS error_burst,
    CAST(sum(CAST(level = 'ERROR' AS INT)) OVER w >= 5 AS INT) AS is_error_burst
  FROM logs JOIN raw USING (log_id) WINDOW w AS (ORDER BY timestamp, line ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ("raw", SQL_RAW)))
def str_error_burst(spark, sf):
    """Lines arrive up to ten minutes after their time, in four loads, with a restart of the stream before each."""
    root = scratch_path(spark, "str-burst")
    lines = parse_lines(raw_lines(spark, sf).select(F.col("line").alias("value")))
    delay = F.pmod(F.xxhash64("raw_log"), F.lit(600_000_000))
    lines = stage(lines.select("raw_log", (micros(F.col("timestamp")) + delay).alias("arrival")))
    ends = lines.approxQuantile("arrival", [0.25, 0.5, 0.75], 0.01)
    load = sum((F.col("arrival") > e).cast("int") for e in ends) if ends else F.lit(0)
    detector = jobs.BurstDetector(f"{root}/bursts", tiebreak=("raw_log",))
    for i in range(4):
        lines.where(load == i).select("raw_log").write.text(f"{root}/in/{i}")
        detector.start(jobs.read_stream(spark, f"{root}/in"), f"{root}/checkpoint", available_now=True).awaitTermination()
    return detector.table(spark).select("timestamp", "level", "message", "error_burst", "is_error_burst")
