"""Queries of filters, joins, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry import dims
from logquarry.catalog.registry import query
from logquarry.catalog.projections import SQL_SCORE
from logquarry.catalog.views import logs, runs, table, with_logs, with_runs
from logquarry.functions import importance, text
from logquarry.operators import aggregates, documents, filters
from logquarry.operators.keyed import add_request_stats, instance_stats, request_stats
from logquarry.operators.topk import at_least_percentile, top_per_group
from logquarry.plans.features import text_features
from logquarry.sources.store import logs_union

# --- filters ---------------------------------------------------------------------------


@query("filter_error", with_logs(" SELECT log_id, timestamp, service_type, message FROM logs WHERE upper(level) = 'ERROR'"))
def filter_error(spark, sf):
    return logs(spark, sf).where(filters.level_is("error")).select(
        "log_id", "timestamp", "service_type", "message")


@query("filter_logs", with_logs("""
  SELECT timestamp, level, service_type, message, instance_id FROM logs
  WHERE level IN ('ERROR', 'CRITICAL', 'WARNING') AND service_type IN ('nova-api', 'nova-compute')
    AND instance_id IS NOT NULL AND instance_id IN ('00000001', '00000004', '00000005', '00000008', '00000012')
    AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-25'
    AND contains(lower(message), 'instance')"""))
def filter_logs(spark, sf):
    return filters.filter_logs(
        logs(spark, sf), levels=["ERROR", "CRITICAL", "WARNING"], services=["nova-api", "nova-compute"],
        instances=["00000001", "00000004", "00000005", "00000008", "00000012"],
        start="2024-01-03", end="2024-01-24", text="INSTANCE",
    ).select("timestamp", "level", "service_type", "message", "instance_id")


@query("keyword_counts", with_logs(f"""
  SELECT k.keyword, count(*) AS matches, min_by(l.message, l.log_id) AS sample
  FROM logs l JOIN (SELECT unnest({dims.INSPECT_WORDS}) AS keyword) k ON contains(lower(l.message), k.keyword)
  GROUP BY k.keyword"""))
def keyword_counts(spark, sf):
    return filters.keyword_counts(logs(spark, sf), dims.INSPECT_WORDS)


@query("percentile_filter", with_logs("""
  SELECT log_id, CAST(length(message) AS INT) AS score FROM logs
  WHERE length(message) >= (SELECT quantile_cont(length(message), 0.3) FROM logs)"""))
def percentile_filter(spark, sf):
    scored = logs(spark, sf).select("log_id", F.length("message").alias("score"))
    return at_least_percentile(scored, "score", dims.IMPORTANCE_PERCENTILE)


@query("search_by_meta", with_logs("""
  SELECT log_id, timestamp, service_type, level, instance_id, message FROM logs
  WHERE service_type = 'nova-compute' AND level = 'ERROR'"""))
def search_by_meta(spark, sf):
    return filters.search_by_meta(logs(spark, sf), service_type="nova-compute", level="ERROR").select(
        "log_id", "timestamp", "service_type", "level", "instance_id", "message")


# --- joins and set operations ----------------------------------------------------------


@query("semi_join_prefilter", with_logs(f"""
  SELECT log_id, level, message FROM logs WHERE log_id IN (
    SELECT log_id FROM logs WHERE {SQL_SCORE} >= (SELECT quantile_cont({SQL_SCORE}, 0.3) FROM logs))"""))
def semi_join_prefilter(spark, sf):
    df = logs(spark, sf)
    scored = df.select("log_id", importance.rule_score(F.col("level"), F.col("message")).alias("score"))
    kept = at_least_percentile(scored, "score", dims.IMPORTANCE_PERCENTILE)
    return df.join(kept, "log_id", "left_semi").select("log_id", "level", "message")


SQL_DOC_KEY = "md5(concat(text, '_', lang))"


@query("anti_join_ingest", f"""
  SELECT DISTINCT {SQL_DOC_KEY} AS doc_id FROM documents
  WHERE {SQL_DOC_KEY} NOT IN (SELECT {SQL_DOC_KEY} FROM documents JOIN labels USING (doc_id))""")
def anti_join_ingest(spark, sf):
    docs = table(spark, sf, "documents")
    key = text.document_key(F.col("text"), F.col("lang")).alias("doc_id")
    stored = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select(key)
    return documents.new_documents(docs.select(key), stored)


@query("union_logs", with_runs(f"""
  SELECT timestamp, level, message, service_type, instance_id, request_id FROM (
    {with_logs(' SELECT timestamp, level, message, service_type, instance_id, request_id FROM logs')})
  UNION ALL SELECT ts, CASE WHEN status = 'error' THEN 'ERROR' ELSE 'INFO' END, issue, 'rca', NULL, NULL FROM runs"""))
def union_logs(spark, sf):
    own = runs(spark, sf).select(
        F.col("ts").alias("timestamp"),
        F.when(F.col("status") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("issue").alias("message"), F.lit("rca").alias("service_type"))
    return logs_union([logs(spark, sf), own]).select(
        "timestamp", "level", "message", "service_type", "instance_id", "request_id")


@query("dedup_ingest", "SELECT DISTINCT md5(text) AS doc_id FROM documents")
def dedup_ingest(spark, sf):
    return table(spark, sf, "documents").select(F.md5("text").alias("doc_id")).dropDuplicates(["doc_id"])


@query("dedup_hits", """
  SELECT doc_id, document, similarity, rank FROM (
    SELECT *, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank FROM (
      SELECT doc_id, text AS document, n_chars / 40000.0 AS similarity,
        row_number() OVER (PARTITION BY text, source, lang ORDER BY n_chars DESC, doc_id) AS copy FROM documents)
    WHERE copy = 1) WHERE rank <= 20""")
def dedup_hits(spark, sf):
    hits = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("document"), F.col("source").alias("service_type"),
        F.col("lang").alias("level"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        (F.col("n_chars") / 40000.0).alias("similarity"))
    return documents.dedup_hits(hits, dims.TOP_HITS).select("doc_id", "document", "similarity", "rank")


@query("topk_scored", with_logs(f"""
  SELECT service_type, log_id, rule_score, rank FROM (
    SELECT service_type, log_id, {SQL_SCORE} AS rule_score,
      CAST(row_number() OVER (PARTITION BY service_type ORDER BY {SQL_SCORE} DESC, log_id) AS INT) AS rank FROM logs)
  WHERE rank <= 50"""))
def topk_scored(spark, sf):
    scored = logs(spark, sf).select(
        "service_type", "log_id", importance.rule_score(F.col("level"), F.col("message")).alias("rule_score"))
    return top_per_group(scored, ["service_type"], [F.desc("rule_score"), F.col("log_id")], dims.TOP_RELEVANT)


# --- aggregates ------------------------------------------------------------------------


@query("level_dist", with_logs(" SELECT level, count(*) AS n FROM logs GROUP BY level"))
def level_dist(spark, sf):
    return aggregates.counts_by(logs(spark, sf), "level")


@query("service_dist", with_logs(
    " SELECT service_type, count(*) AS n FROM logs GROUP BY service_type ORDER BY n DESC, service_type LIMIT 10"))
def service_dist(spark, sf):
    return aggregates.top_counts(logs(spark, sf), "service_type")


@query("dist_pct", with_logs("""
  SELECT coalesce(instance_id, 'unknown') AS instance_id, count(*) AS n,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM logs GROUP BY 1"""))
def dist_pct(spark, sf):
    return aggregates.distribution(logs(spark, sf), "instance_id").withColumn("percent", F.round("percent", 6))


@query("log_kpis", with_logs("""
  SELECT count(*) AS total_logs, count(*) FILTER (WHERE level = 'ERROR') AS error_count,
    round(100.0 * count(*) FILTER (WHERE level = 'ERROR') / count(*), 6) AS error_rate,
    count(DISTINCT instance_id) AS unique_instances, count(DISTINCT service_type) AS unique_services FROM logs"""))
def log_kpis(spark, sf):
    return aggregates.key_figures(logs(spark, sf)).withColumn("error_rate", F.round("error_rate", 6))


@query("ingest_stats", with_logs("""
  SELECT 'total' AS part, NULL AS key, count(*) AS entries, min(timestamp) AS first_time, max(timestamp) AS last_time,
    count(DISTINCT instance_id) AS instances, count(DISTINCT strftime(timestamp, '%Y%m%d')) AS files FROM logs
  UNION ALL SELECT 'service', service_type, count(*), min(timestamp), max(timestamp), NULL, NULL FROM logs GROUP BY service_type
  UNION ALL SELECT 'level', level, count(*), min(timestamp), max(timestamp), NULL, NULL FROM logs GROUP BY level"""))
def ingest_stats(spark, sf):
    df = logs(spark, sf).withColumn("source_file", F.date_format("timestamp", "yyyyMMdd"))
    return aggregates.ingest_stats(df)


def sql_life(prefix: str) -> str:
    return f"round((epoch_us(max({prefix}timestamp)) - epoch_us(min({prefix}timestamp))) / 1e6, 6)"


@query("instance_stats", with_logs(f"""
  SELECT instance_id, count(*) FILTER (WHERE level = 'ERROR') AS instance_error_count,
    count(message) AS instance_log_count, min(timestamp) AS instance_first_seen,
    max(timestamp) AS instance_last_seen, {sql_life('')} AS instance_lifespan,
    round(count(*) FILTER (WHERE level = 'ERROR') / count(message), 6) AS instance_error_rate
  FROM logs WHERE instance_id IS NOT NULL GROUP BY instance_id"""))
def instance_statistics(spark, sf):
    return instance_stats(logs(spark, sf)).withColumns({
        c: F.round(c, 6) for c in ("instance_lifespan", "instance_error_rate")})


@query("request_stats", with_logs("""
  SELECT request_id, count(*) FILTER (WHERE level = 'ERROR') AS request_error_count,
    count(message) AS request_log_count,
    round(count(*) FILTER (WHERE level = 'ERROR') / count(message), 6) AS request_error_rate
  FROM logs WHERE request_id IS NOT NULL GROUP BY request_id"""))
def request_statistics(spark, sf):
    return request_stats(logs(spark, sf)).withColumn("request_error_rate", F.round("request_error_rate", 6))


@query("request_join", with_logs("""
  SELECT l.log_id, CAST(coalesce(r.e, 0) AS DOUBLE) AS request_error_count,
    CAST(coalesce(r.n, 1) AS DOUBLE) AS request_log_count, round(coalesce(r.e / r.n, 0), 6) AS request_error_rate
  FROM logs l LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE level = 'ERROR') AS e, count(message) AS n
    FROM logs WHERE request_id IS NOT NULL GROUP BY request_id) r ON l.request_id = r.request_id"""))
def request_join(spark, sf):
    return add_request_stats(logs(spark, sf)).select(
        "log_id", "request_error_count", "request_log_count",
        F.round("request_error_rate", 6).alias("request_error_rate"))


@query("hourly_level", with_logs("""
  SELECT date_trunc('hour', timestamp) AS hour, level, count(*) AS n FROM logs GROUP BY 1, 2"""))
def hourly_level(spark, sf):
    return aggregates.hourly_levels(logs(spark, sf))


@query("instance_heatmap", with_logs(
    " SELECT instance_id, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (WHERE hour(timestamp) = {h}) AS h{h:02d}" for h in range(24))
    + " FROM logs WHERE instance_id IS NOT NULL GROUP BY instance_id ORDER BY total DESC, instance_id LIMIT 20"))
def instance_heatmap(spark, sf):
    return aggregates.instance_heatmap(logs(spark, sf))


@query("file_dist", with_logs("""
  SELECT concat(service_type, '-', strftime(timestamp, '%Y%m%d')) AS source_file, count(*) AS n
  FROM logs GROUP BY 1 ORDER BY n DESC, source_file LIMIT 10"""))
def file_dist(spark, sf):
    df = logs(spark, sf).withColumn(
        "source_file", F.concat("service_type", F.lit("-"), F.date_format("timestamp", "yyyyMMdd")))
    return aggregates.top_counts(df, "source_file")


@query("doc_stats", """
  SELECT count(*) AS total_documents, count(*) FILTER (WHERE length(text) > 512) AS chunked_documents,
    count(*) FILTER (WHERE length(text) <= 512) AS non_chunked_documents FROM documents""")
def doc_stats(spark, sf):
    docs = table(spark, sf, "documents").withColumn("is_chunked", F.length("text") > dims.CHUNK_SIZE)
    return aggregates.document_stats(docs)


@query("hour_activity", with_logs("""
  SELECT CAST(hour(timestamp) AS INT) AS hour, count(*) AS activity FROM logs GROUP BY 1"""))
def hour_activity(spark, sf):
    return aggregates.hour_activity(logs(spark, sf))


@query("error_frequency", with_logs("""
  SELECT CASE """ + " ".join(
    f"WHEN contains(lower(message), '{w}') THEN '{w}'" for w in reversed(dims.INSPECT_WORDS)) + """
    ELSE 'other' END AS error_type, count(*) AS frequency
  FROM logs WHERE upper(level) IN ('ERROR', 'CRITICAL') GROUP BY 1"""))
def error_frequency(spark, sf):
    return aggregates.error_frequency(logs(spark, sf))



@query("feature_summary", with_logs("""
  SELECT 27 AS total_features, 21 AS numerical_features, 5 AS categorical_features, 1 AS datetime_features,
    CAST(count(*) FILTER (WHERE instance_id IS NULL) + count(*) FILTER (WHERE request_id IS NULL) AS BIGINT) AS missing_values,
    2 AS temporal_columns, 5 AS text_columns, 2 AS instance_columns, 3 AS error_columns,
    0 AS context_columns, 0 AS anomaly_columns FROM logs"""))
def feature_summary(spark, sf):
    return aggregates.feature_summary(text_features(logs(spark, sf)))


@query("bench_summary", with_runs("""
  SELECT coalesce(category, '(all)') AS category, count(*) AS tests,
    round(avg(duration) FILTER (WHERE mode = 'hybrid'), 6) AS avg_hybrid,
    round(avg(duration) FILTER (WHERE mode = 'fast'), 6) AS avg_fast,
    min(duration) FILTER (WHERE mode = 'hybrid') AS best_hybrid,
    max(duration) FILTER (WHERE mode = 'hybrid') AS worst_hybrid,
    arg_min(category, (duration, run_id)) FILTER (WHERE mode = 'hybrid') AS best_query,
    arg_max(category, (duration, run_id)) FILTER (WHERE mode = 'hybrid') AS worst_query,
    round(avg(relevant_logs) FILTER (WHERE mode = 'hybrid'), 6) AS avg_hybrid_logs,
    round(avg(relevant_logs) FILTER (WHERE mode = 'fast'), 6) AS avg_fast_logs,
    round(avg(duration) FILTER (WHERE mode = 'hybrid') / avg(duration) FILTER (WHERE mode = 'fast'), 6) AS speedup
  FROM runs GROUP BY ROLLUP (category)"""))
def bench_summary(spark, sf):
    out = aggregates.run_benchmark_summary(runs(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in (
        "avg_hybrid", "avg_fast", "avg_hybrid_logs", "avg_fast_logs", "speedup")})
