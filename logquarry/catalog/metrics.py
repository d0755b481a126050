"""Queries of run metrics, alert rules and predictor quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry.catalog.registry import query
from logquarry.catalog.views import logs, runs, table, with_logs, with_runs
from logquarry.operators import evaluation, metrics

MINUTE = "date_trunc('minute', ts)"


def sql_tumbling(minutes: int, ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', {ts}, TIMESTAMP '1970-01-01')"


def sql_ends(width: int) -> str:
    return f"{MINUTE} + to_minutes(unnest(range(1, {width + 1})))"


def sql_held(columns: str, source: str, minutes: int) -> str:
    return (f" SELECT {columns}, breached, breached AND count(*) FILTER (WHERE breached) OVER (ORDER BY window_end "
            f"RANGE BETWEEN INTERVAL '{minutes} minutes' PRECEDING AND CURRENT ROW) = {minutes + 1} AS firing FROM ({source})")


@query("run_log", with_runs("""
  SELECT run_id, ts, issue[:100] AS issue_description, status, category, mode, relevant_logs,
    duration AS processing_time FROM runs"""))
def run_log(spark, sf):
    return metrics.run_log(runs(spark, sf))


@query("last_runs", with_runs("""
  SELECT run_id, ts, issue[:100] AS issue_description, status FROM runs ORDER BY ts DESC, run_id DESC LIMIT 10"""))
def last_runs(spark, sf):
    return metrics.last_runs(metrics.run_log(runs(spark, sf))).select("run_id", "ts", "issue_description", "status")


@query("runs_by_category", with_runs("""
  SELECT status, category, mode, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share
  FROM runs GROUP BY status, category, mode"""))
def runs_by_category(spark, sf):
    return metrics.runs_by_category(runs(spark, sf)).withColumn("share", F.round("share", 6))


@query("duration_quantiles", with_runs(f"""
  SELECT {sql_tumbling(5)} AS window_start, round(quantile_cont(duration, 0.5), 6) AS p50,
    round(quantile_cont(duration, 0.95), 6) AS p95, round(CAST(sum(CAST(duration AS DECIMAL(18, 6))) AS DOUBLE) / count(*), 9) AS mean, count(*) AS runs
  FROM runs GROUP BY 1"""))
def duration_quantiles(spark, sf):
    return metrics.duration_quantiles(runs(spark, sf)).withColumns({
        "p50": F.round("p50", 6), "p95": F.round("p95", 6), "mean": F.round("mean", 9)})


@query("duration_histogram", with_runs(
    "SELECT mode, le, n FROM (" + " UNION ALL ".join(
        f"SELECT mode, '{b}' AS le, count(*) FILTER (WHERE duration <= {b}) AS n FROM runs GROUP BY mode"
        for b in metrics.DURATION_BOUNDS)
    + " UNION ALL SELECT mode, '+Inf', count(*) FROM runs GROUP BY mode)"))
def duration_histogram(spark, sf):
    return metrics.duration_histogram(runs(spark, sf))


@query("alert_error_rate", with_runs(sql_held("window_end, runs, errors, error_percent", f"""
  SELECT window_end, count(*) AS runs, count(*) FILTER (WHERE status = 'error') AS errors,
    round(100.0 * count(*) FILTER (WHERE status = 'error') / count(*), 6) AS error_percent,
    100.0 * count(*) FILTER (WHERE status = 'error') / count(*) > 5 AS breached
  FROM (SELECT status, {sql_ends(5)} AS window_end FROM runs) GROUP BY 1""", 2)))
def alert_error_rate(spark, sf):
    return metrics.alert_error_rate(runs(spark, sf)).withColumn("error_percent", F.round("error_percent", 6))


@query("alert_slow", with_runs(sql_held("window_end, round(p95, 6) AS p95", f"""
  SELECT window_end, quantile_cont(duration, 0.95) AS p95, quantile_cont(duration, 0.95) > 30 AS breached
  FROM (SELECT duration, {sql_ends(5)} AS window_end FROM runs) GROUP BY 1""", 5)))
def alert_slow(spark, sf):
    return metrics.alert_slow(runs(spark, sf)).withColumn("p95", F.round("p95", 6))


@query("alert_rating", with_runs(sql_held("window_end, ratings, total, round(mean_rating, 6) AS mean_rating", f"""
  SELECT window_end, count(*) AS ratings, CAST(sum(rating) AS BIGINT) AS total, avg(rating) AS mean_rating,
    avg(rating) < 3 AS breached
  FROM (SELECT rating, {sql_ends(60)} AS window_end FROM runs WHERE rating BETWEEN 1 AND 5) GROUP BY 1""", 15)))
def alert_rating(spark, sf):
    return metrics.alert_rating(runs(spark, sf)).withColumn("mean_rating", F.round("mean_rating", 6))


@query("rating_median", with_runs(f"""
  SELECT {sql_tumbling(60)} AS window_start, CAST(quantile_cont(rating, 0.5) AS DOUBLE) AS median
  FROM runs WHERE rating BETWEEN 1 AND 5 GROUP BY 1"""))
def rating_median(spark, sf):
    return metrics.rating_median(runs(spark, sf))


@query("alert_silence", with_runs("""
  , minutes AS (SELECT DISTINCT date_trunc('minute', ts) AS m FROM runs WHERE ts IS NOT NULL),
  ends AS (SELECT unnest(generate_series(min(m) + INTERVAL 1 MINUTE, max(m) + INTERVAL 21 MINUTES, INTERVAL 1 MINUTE)) AS w FROM minutes),
  counted AS (SELECT w, (SELECT count(*) FROM runs r WHERE date_trunc('minute', r.ts) < w
    AND date_trunc('minute', r.ts) >= w - INTERVAL 10 MINUTES) AS runs FROM ends)
  SELECT w AS window_end, runs, runs = 0 AS breached,
    sum(CAST(runs = 0 AS INT)) OVER (ORDER BY w ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) = 11 AS firing FROM counted"""))
def alert_silence(spark, sf):
    return metrics.alert_silence(runs(spark, sf))


@query("success_rate", with_runs(f"""
  SELECT {sql_tumbling(5)} AS window_start,
    round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_percent,
    round(count(*) FILTER (WHERE mode = 'hybrid') / 5.0, 6) AS hybrid_per_minute,
    round(count(*) FILTER (WHERE mode = 'fast') / 5.0, 6) AS fast_per_minute FROM runs GROUP BY 1"""))
def success_rate(spark, sf):
    return metrics.success_rate(runs(spark, sf)).withColumns({
        c: F.round(c, 6) for c in ("success_percent", "hybrid_per_minute", "fast_per_minute")})


@query("volume_by_level", with_logs(
    " SELECT date_trunc('minute', timestamp) AS minute, level, count(*) AS n FROM logs GROUP BY 1, 2"))
def volume_by_level(spark, sf):
    return metrics.volume_by_level(logs(spark, sf))


@query("active_users", with_runs(
    f"SELECT {sql_tumbling(60)} AS window_start, count(DISTINCT user_id) AS active_users FROM runs GROUP BY 1"))
def active_users(spark, sf):
    return metrics.active_users(runs(spark, sf))


STAGES = {"load": 0.125, "category": 0.0625, "timeline": 0.1875, "patterns": 0.25, "report": 0.375}


@query("stage_timings", with_runs("SELECT stage, round(avg(duration * part), 6) AS mean_seconds FROM runs, (VALUES "
       + ", ".join(f"('{n}', {p}::DOUBLE)" for n, p in STAGES.items()) + ") AS v(stage, part) GROUP BY stage"))
def stage_timings(spark, sf):
    timed = runs(spark, sf).select(*[(F.col("duration") * p).alias(n) for n, p in STAGES.items()])
    return metrics.stage_timings(timed, list(STAGES)).select("stage", F.round("mean_seconds", 6).alias("mean_seconds"))


# --- predictor quality: long documents are taken to be good ones ------------------------

LENGTH_RULE = 400


def judged(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        "lang", "source", F.col("quality").alias("label"),
        (F.col("n_chars") > LENGTH_RULE).cast("int").alias("prediction"))


SQL_JUDGED = (f"SELECT lang, source, quality AS label, CAST(n_chars > {LENGTH_RULE} AS INT) AS prediction "
              "FROM documents JOIN labels USING (doc_id)")


@query("confusion", f"SELECT label, prediction, count(*) AS n FROM ({SQL_JUDGED}) GROUP BY label, prediction")
def confusion(spark, sf):
    return evaluation.confusion(judged(spark, sf))


SQL_TRAINED = f"""SELECT lang AS run_id,
    round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy,
    round(coalesce(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE prediction = 1), 0), 0), 6) AS precision,
    round(coalesce(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 0), 6) AS recall
  FROM ({SQL_JUDGED}) GROUP BY lang"""


def trained(spark, sf):
    """One training run per language, with its scores."""
    per_language = evaluation.scores(judged(spark, sf), "label", "prediction", "lang")
    return per_language.select(
        F.col("lang").alias("run_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query("class_report", f"""
  SELECT c.class, count(*) FILTER (WHERE label = c.class) AS support,
    round(coalesce(count(*) FILTER (WHERE label = c.class AND prediction = c.class)
      / nullif(count(*) FILTER (WHERE prediction = c.class), 0), 0), 6) AS precision,
    round(coalesce(count(*) FILTER (WHERE label = c.class AND prediction = c.class)
      / nullif(count(*) FILTER (WHERE label = c.class), 0), 0), 6) AS recall
  FROM ({SQL_JUDGED}), (SELECT CAST(unnest([0, 1]) AS INT) AS class) c GROUP BY c.class""")
def class_report(spark, sf):
    return evaluation.class_report(judged(spark, sf)).select(
        "class", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("training_history", f"SELECT TIMESTAMP '2024-01-01' AS ts, * FROM ({SQL_TRAINED})")
def training_history(spark, sf):
    return metrics.training_history(trained(spark, sf))


@query("alert_accuracy", f"SELECT run_id, accuracy FROM ({SQL_TRAINED}) WHERE accuracy < 0.8")
def alert_accuracy(spark, sf):
    return metrics.alert_accuracy(trained(spark, sf)).select("run_id", "accuracy")
