"""Queries of line parsing, text and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry import dims
from logquarry.catalog.registry import query
from logquarry.catalog.views import SQL_RAW, logs, raw_lines, table, with_logs
from logquarry.functions import importance, parsing, temporal, text
from logquarry.functions.chunking import chunk
from logquarry.operators.labels import apply_labels, classic_matrix, fit_labels, indexed_features
from logquarry.sources.files import parse_lines, rejected_lines

SQL_STOPS = "[" + ", ".join(f"'{w}'" for w in dims.STOP_WORDS) + "]"
SQL_PATTERN = parsing.LINE_PATTERN
SQL_CLEAN = "trim(regexp_replace(lower({0}), '[^a-z]+', ' ', 'g'))"


def sql_any(column: str, phrases) -> str:
    return f"regexp_matches(lower({column}), '{text.any_of(phrases)}')"


def sql_flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def over_raw(body: str) -> str:
    return with_logs(body, ("raw", SQL_RAW))


def _field(i: int) -> str:
    return f"regexp_extract(line, '{SQL_PATTERN}', {i})"


@query("parse_log_line", over_raw(f"""
  SELECT log_id, {_field(1)} AS service,
    try_strptime({_field(2)}, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
    {_field(3)} AS process_id, {_field(4)} AS level, {_field(5)} AS module,
    {_field(6)} AS request_info, {_field(7)} AS message
  FROM raw WHERE regexp_matches(line, '{SQL_PATTERN}')"""))
def parse_log_line(spark, sf):
    parsed = parse_lines(raw_lines(spark, sf).withColumnRenamed("line", "value"))
    return parsed.select("log_id", "service", "timestamp", "process_id", "level", "module",
                         "request_info", "message")


@query("parse_rejects", f"""
  SELECT doc_id, count(*) AS lines,
    count(*) FILTER (WHERE NOT regexp_matches(l, '{SQL_PATTERN}')) AS rejected
  FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> ''
  GROUP BY doc_id""")
def parse_rejects(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    flagged = rejected_lines(lines, keep_all=True)
    return flagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("rejected").alias("rejected"))


@query("service_type", over_raw(f"""
  SELECT log_id, {_field(1)} AS service,
    CASE WHEN contains({_field(1)}, 'nova-api') THEN 'nova-api'
         WHEN contains({_field(1)}, 'nova-compute') THEN 'nova-compute'
         WHEN contains({_field(1)}, 'nova-scheduler') THEN 'nova-scheduler'
         ELSE 'unknown' END AS service_type
  FROM raw"""))
def service_type(spark, sf):
    service = parsing.line_fields(F.col("line"))[0]
    return raw_lines(spark, sf).select("log_id", service).withColumn(
        "service_type", parsing.service_type(F.col("service")))


@query("instance_id", with_logs(f"""
  SELECT log_id, nullif(regexp_extract(message, '{parsing.INSTANCE_PATTERN}', 1), '') AS instance_id
  FROM logs"""))
def instance_id(spark, sf):
    return logs(spark, sf).select("log_id", parsing.instance_id(F.col("message")).alias("instance_id"))


@query("request_id", over_raw(f"""
  SELECT log_id, nullif(regexp_extract({_field(6)}, '{parsing.REQUEST_PATTERN}', 1), '') AS request_id
  FROM raw"""))
def request_id(spark, sf):
    info = parsing.line_fields(F.col("line"))[5]
    return raw_lines(spark, sf).select("log_id", parsing.request_id(info).alias("request_id"))


@query("ts_flexible", with_logs("""
  SELECT log_id, CASE WHEN log_id % 5 = 4 THEN NULL ELSE
    CASE log_id % 5 WHEN 0 THEN timestamp WHEN 1 THEN timestamp
      WHEN 2 THEN date_trunc('second', timestamp) ELSE CAST(CAST(timestamp AS DATE) AS TIMESTAMP) END END AS parsed
  FROM logs"""))
def ts_flexible(spark, sf):
    ts, form = F.col("timestamp"), F.col("log_id") % 5
    written = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(form == 2, F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
        .when(form == 3, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise("no time"))
    return logs(spark, sf).select("log_id", parsing.flexible_timestamp(written).alias("parsed"))


SQL_DOW = "(CAST(isodow(timestamp) AS INT) - 1)"
SQL_HOUR = "CAST(hour(timestamp) AS INT)"


@query("temporal_parts", with_logs(f"""
  SELECT log_id, {SQL_HOUR} AS hour, {SQL_DOW} AS day_of_week, CAST(day(timestamp) AS INT) AS day_of_month,
    CAST(month(timestamp) AS INT) AS month, CAST(minute(timestamp) AS INT) AS minute,
    CAST(second(timestamp) AS INT) AS second, {sql_flag(f'{SQL_DOW} >= 5')} AS is_weekend,
    {sql_flag(f'{SQL_HOUR} BETWEEN 9 AND 17')} AS is_business_hours,
    {sql_flag(f'{SQL_HOUR} >= 22 OR {SQL_HOUR} <= 6')} AS is_night
  FROM logs"""))
def temporal_parts(spark, sf):
    return logs(spark, sf).select(
        "log_id", *[c.alias(n) for n, c in temporal.parts(F.col("timestamp")).items()])


@query("log_text", with_logs("""
  SELECT log_id, service_type || ' ' || level || ': ' || message ||
    CASE WHEN instance_id IS NULL THEN '' ELSE ' [Instance: ' || instance_id || ']' END AS log_text
  FROM logs"""))
def log_text(spark, sf):
    body = text.log_text(F.col("service_type"), F.col("level"), F.col("message"), F.col("instance_id"))
    return logs(spark, sf).select("log_id", body.alias("log_text"))


SQL_TRUNCATED = """
  SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text
    WHEN strpos(reverse(text[:1000]), ' ') > 0 AND 1000 - strpos(reverse(text[:1000]), ' ') > 800
    THEN substring(text, 1, 1000 - strpos(reverse(text[:1000]), ' ')) || '...'
    ELSE substring(text, 1, 1000) || '...' END AS truncated
  FROM documents"""


@query("truncate_text", SQL_TRUNCATED)
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("truncated"))


@query("doc_key", """
  SELECT doc_id, md5(concat(coalesce(source, ''), '_', coalesce(lang, ''), '_', substring(text, 1, 100))) AS doc_key
  FROM documents""")
def doc_key(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.document_key(F.col("source"), F.col("lang"), F.substring("text", 1, 100)).alias("doc_key"))


SQL_CHUNKS = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, text, length(text) AS n, 0 AS start_at,
    CASE WHEN length(text) <= 512 THEN length(text)
         WHEN strpos(reverse(substring(text, 1, 512)), ' ') BETWEEN 1 AND 511
         THEN 512 - strpos(reverse(substring(text, 1, 512)), ' ') ELSE 512 END AS end_at
  FROM documents
  UNION ALL
  SELECT doc_id, text, n, s, CASE WHEN s + 512 >= n THEN s + 512
      WHEN strpos(reverse(substring(text, s + 1, 512)), ' ') BETWEEN 1 AND 511
      THEN s + 512 - strpos(reverse(substring(text, s + 1, 512)), ' ') ELSE s + 512 END
  FROM (SELECT doc_id, text, n, greatest(end_at - 50, start_at + 1) AS s FROM cut WHERE n > 512)
  WHERE s < n),
pieces AS (
  SELECT doc_id, start_at, n, CASE WHEN n <= 512 THEN text
    ELSE regexp_replace(substring(text, start_at + 1, end_at - start_at), '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') END AS chunk
  FROM cut)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_at) - 1 AS INT) AS chunk_index,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, n > 512 AS is_chunked, chunk
FROM pieces WHERE n <= 512 OR chunk <> ''"""


@query("chunk_text", SQL_CHUNKS)
def chunk_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn("_chunks", chunk(F.col("text")))
    return docs.select(
        "doc_id", F.posexplode("_chunks").alias("chunk_index", "chunk"),
        F.size("_chunks").alias("total_chunks"),
        (F.length("text") > dims.CHUNK_SIZE).alias("is_chunked"))


@query("clean_text", f"SELECT doc_id, {SQL_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("tokens", f"""
  SELECT doc_id, list_filter(string_split({SQL_CLEAN.format('text')}, ' '),
    lambda w: length(w) > 2 AND NOT list_contains({SQL_STOPS}, w)) AS tokens FROM documents""")
def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


def _n(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INT)"


@query("text_counts", f"""
  SELECT doc_id, CAST(length(text) AS INT) AS message_length, {_n('[^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0B]+')} AS word_count,
    CAST(length(text) AS INT) AS char_count, {_n('[0-9]')} AS number_count, {_n('[A-Z]')} AS uppercase_count,
    {_n('[^a-zA-Z0-9 ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0B]')} AS special_char_count
  FROM documents""")
def text_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[c.alias(n) for n, c in text.counts(F.col("text")).items()])


@query("text_flags", "SELECT doc_id, " + ", ".join(
    [sql_flag("regexp_matches(text, '(?i)https?://')") + " AS has_url",
     sql_flag(r"regexp_matches(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')") + " AS has_ip"]
    + [sql_flag(f"contains(lower(text), '{w}')") + f" AS has_{w}" for w in dims.ERROR_WORDS]
    + [sql_flag(f"contains(lower(text), '{w}')") + f" AS mentions_{w}" for w in dims.RESOURCE_WORDS])
    + " FROM documents")
def text_flags(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", *[c.alias(n) for n, c in text.flags(F.col("text")).items()])


SQL_ML = f"""
  SELECT log_id, {SQL_CLEAN.format('message')} AS cleaned_message,
    CAST(length(message) AS INT) AS message_length,
    CAST(len(string_split({SQL_CLEAN.format('message')}, ' ')) AS INT) AS word_count,
    {SQL_HOUR} AS hour, {SQL_DOW} AS day_of_week, CAST(minute(timestamp) AS INT) AS minute,
    CAST(instance_id IS NOT NULL AS INT) AS has_instance_id,
    CAST(request_id IS NOT NULL AS INT) AS has_request_id,
    {', '.join(sql_flag(f"contains({SQL_CLEAN.format('message')}, '{w}')") + f' AS has_{w}' for w in dims.IMPORTANT_WORDS[:10])}
  FROM logs"""


@query("ml_features", with_logs(SQL_ML))
def ml_features(spark, sf):
    return indexed_features(logs(spark, sf)).select(
        "log_id", "cleaned_message", "message_length", "word_count", "hour", "day_of_week", "minute",
        "has_instance_id", "has_request_id", *[f"has_{w}" for w in dims.IMPORTANT_WORDS[:10]])


@query("label_encode", with_logs("""
  SELECT log_id, CAST(dense_rank() OVER (ORDER BY level) - 1 AS INT) AS level_encoded,
    CAST(dense_rank() OVER (ORDER BY service_type) - 1 AS INT) AS service_type_encoded
  FROM logs"""))
def label_encode(spark, sf):
    df = logs(spark, sf)
    for column in ("level", "service_type"):
        df = apply_labels(df, fit_labels(df, column), column)
    return df.select("log_id", "level_encoded", "service_type_encoded")


SQL_SIGNALS = {
    "is_error": "lower(level) IN ('error', 'critical')",
    "is_warning": "lower(level) = 'warning'",
    "has_keyword": sql_any("message", dims.IMPORTANT_WORDS),
    "has_critical": sql_any("message", dims.CRITICAL_PHRASES),
    "has_lifecycle": sql_any("message", dims.LIFECYCLE_PHRASES),
    "has_resource": sql_any("message", dims.RESOURCE_PHRASES),
}
SQL_SCORE = ("(4 * CAST({is_error} AS INT) + 2 * CAST({is_warning} AS INT) + CAST({has_keyword} AS INT)"
             " + CAST({has_critical} AS INT) + CAST({has_lifecycle} AS INT) + CAST({has_resource} AS INT)) / 8.0"
             ).format(**SQL_SIGNALS)
SQL_SCORE = f"CAST({SQL_SCORE} AS DOUBLE)"


@query("importance_label", with_logs(f"""
  SELECT log_id, CAST({' OR '.join(SQL_SIGNALS.values())} AS INT) AS important, {SQL_SCORE} AS rule_score
  FROM logs"""))
def importance_label(spark, sf):
    level, message = F.col("level"), F.col("message")
    return logs(spark, sf).select(
        "log_id", importance.label(level, message).alias("important"),
        importance.rule_score(level, message).alias("rule_score"))


@query("explain_ranking", with_logs(f"""
  SELECT log_id, CASE WHEN i >= 0.8 AND v >= 0.8 THEN 'High importance + High similarity'
    WHEN i >= 0.8 THEN 'High importance + Moderate similarity'
    WHEN v >= 0.8 THEN 'Moderate importance + High similarity'
    ELSE 'Moderate importance + Moderate similarity' END AS explanation
  FROM (SELECT log_id, {SQL_SCORE} AS i, (log_id % 100) / 100.0 AS v FROM logs)"""))
def explain_ranking(spark, sf):
    score = importance.rule_score(F.col("level"), F.col("message"))
    return logs(spark, sf).select(
        "log_id", importance.explain(score, (F.col("log_id") % 100) / 100.0).alias("explanation"))


@query("display_cols", with_logs("""
  SELECT log_id, right(instance_id, 8) AS instance_8, right(instance_id, 12) AS instance_12,
    strftime(timestamp, '%H:%M:%S') AS clock FROM logs"""))
def display_cols(spark, sf):
    return logs(spark, sf).select(
        "log_id", F.right("instance_id", F.lit(8)).alias("instance_8"),
        F.right("instance_id", F.lit(12)).alias("instance_12"),
        temporal.clock(F.col("timestamp")).alias("clock"))


@query("rec_urgency", f"""
  SELECT conv_id, turn, CASE WHEN {sql_any('text', dims.IMMEDIATE_WORDS)} THEN 'immediate'
    WHEN {sql_any('text', dims.SHORT_TERM_WORDS)} THEN 'short_term' ELSE 'long_term' END AS urgency
  FROM conversations""")
def rec_urgency(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", importance.urgency(F.col("text")).alias("urgency"))


@query("classic_matrix", with_logs(
    "SELECT log_id, message_length, word_count, hour, day_of_week, minute, has_instance_id, has_request_id, "
    + ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1 AS INT) AS {c}_encoded" for c in ("level", "service_type", "module"))
    + ", " + ", ".join(f"has_{w}" for w in dims.IMPORTANT_WORDS[:10])
    + f" FROM ({SQL_ML}) JOIN (SELECT log_id, level, service_type, CASE WHEN log_id % 7 <> 0 THEN concat('unit', log_id % 5) END AS module "
      "FROM logs) USING (log_id)"))
def classic_inputs(spark, sf):
    """The 20 inputs of classic models; every seventh line has no module."""
    i = F.col("log_id")
    lines = logs(spark, sf).withColumn("module", F.when(i % 7 != 0, F.concat(F.lit("unit"), (i % 5).cast("string"))))
    return classic_matrix(lines)
