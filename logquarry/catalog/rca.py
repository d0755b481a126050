"""Queries of issue analysis and text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from logquarry import dims
from logquarry.catalog.projections import SQL_SCORE, SQL_STOPS, sql_any
from logquarry.catalog.registry import query
from logquarry.catalog.views import SQL_ISSUES, issues, logs, table, values, with_logs
from logquarry.functions.vectors import hashing_encoder
from logquarry.operators import issues as ops
from logquarry.operators import reports
from logquarry.operators.documents import to_documents
from logquarry.operators.tfidf import TfidfModel, tfidf_terms
from logquarry.plans.analysis import LINE_COLUMNS, analyze_issues, history_hits
from logquarry.session import stage

WIDTH = 64


def sql_words(source: str, key: str, column: str) -> str:
    return (f"SELECT {key}, list_filter(regexp_extract_all(lower({column}), '[0-9a-z_]{{2,}}'), "
            f"lambda w: NOT list_contains({SQL_STOPS}, w)) AS w FROM {source}")


def sql_terms(source: str, key: str, column: str) -> str:
    """(key, term), one row per occurrence: words, then pairs of neighbours."""
    return (f"SELECT {key}, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), "
            f"lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ({sql_words(source, key, column)})")


def sql_tfidf(source: str, key: str, column: str, prefix: str) -> list[tuple[str, str]]:
    """Subqueries ending in ``<prefix>_w(key, term, weight)`` with a vocabulary fitted on source."""
    p = prefix
    return [
        (f"{p}_t", sql_terms(source, key, column)),
        (f"{p}_v", f"SELECT term, count(*) AS total, count(DISTINCT {key}) AS df FROM {p}_t GROUP BY term "
                   f"ORDER BY total DESC, term LIMIT {dims.VOCABULARY_SIZE}"),
        (f"{p}_i", f"SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf FROM {p}_v"),
        (f"{p}_c", f"SELECT {key}, term, count(*) * any_value(idf) AS x FROM {p}_t JOIN {p}_i USING (term) "
                   f"GROUP BY {key}, term"),
        (f"{p}_w", f"SELECT {key}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS weight FROM {p}_c"),
    ]


SQL_CATEGORY = "CASE " + " ".join(
    f"WHEN {sql_any('{0}', words)} THEN '{name}'" for name, words in dims.CATEGORY_KEYWORDS) + " ELSE 'general' END"


def sql_category(column: str) -> str:
    return SQL_CATEGORY.replace("{0}", column)


SQL_EVENT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(message), '{p}') THEN '{n}'" for p, n in dims.EVENT_PATTERNS) + " END"
SQL_KEPT = (f"SELECT * FROM (SELECT *, {SQL_SCORE} AS importance FROM logs) WHERE importance >= "
            f"(SELECT quantile_cont({SQL_SCORE}, 0.3) FROM logs)")


@query("tfidf_terms", "WITH " + ", ".join(
    f"{n} AS ({s})" for n, s in sql_tfidf("documents", "doc_id", "text", "d")
) + " SELECT doc_id, term, round(weight, 6) AS weight FROM d_w")
def tfidf(spark, sf):
    docs = table(spark, sf, "documents")
    return tfidf_terms(docs, "doc_id", "text", TfidfModel.fit(docs, "text")).withColumn(
        "weight", F.round("weight", 6))


def scored_logs(spark, sf):
    """The log lines with their importance, staged: the percentile, the term fit and the search
    each read them."""
    return stage(ops.with_importance(logs(spark, sf)).select(*LINE_COLUMNS))


@query("importance_filter", with_logs(" SELECT log_id, importance FROM kept", ("kept", SQL_KEPT)))
def importance_filter(spark, sf):
    return ops.importance_filter(logs(spark, sf)).select("log_id", "importance")


def sql_fast() -> list[tuple[str, str]]:
    q = "q"
    return [
        ("kept", SQL_KEPT),
        ("issues", SQL_ISSUES),
        *sql_tfidf("kept", "log_id", "message", "k"),
        (f"{q}_t", sql_terms("issues", "issue_id", "description")),
        (f"{q}_c", f"SELECT issue_id, term, count(*) * any_value(idf) AS x FROM {q}_t JOIN k_i USING (term) GROUP BY 1, 2"),
        (f"{q}_w", f"SELECT issue_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY issue_id)) AS weight FROM {q}_c"),
        ("sims", "SELECT issue_id, log_id, round(sum(k_w.weight * q_w.weight), 6) AS similarity "
                 "FROM k_w JOIN q_w USING (term) GROUP BY 1, 2"),
        ("hits", "SELECT * FROM sims WHERE similarity >= 0.1"),
        ("spare", "SELECT issue_id, log_id, 0.0::DOUBLE AS similarity, -importance AS o FROM issues, kept "
                  "WHERE issue_id NOT IN (SELECT issue_id FROM hits)"),
        ("ranked", "SELECT issue_id, log_id, similarity, CAST(row_number() OVER (PARTITION BY issue_id "
                   "ORDER BY similarity DESC, o, log_id) AS INT) AS rank FROM "
                   "(SELECT issue_id, log_id, similarity, 0 AS o FROM hits UNION ALL SELECT * FROM spare)"),
        ("relevant", "SELECT r.issue_id, r.similarity, r.rank, k.*, k.importance AS score FROM ranked r "
                     "JOIN kept k USING (log_id) WHERE r.rank <= 50"),
    ]


@query("fast_filter", with_logs(
    " SELECT issue_id, log_id, similarity, importance, rank FROM relevant", *sql_fast()))
def fast_filter(spark, sf):
    return ops.fast_filter(scored_logs(spark, sf), issues(spark)).select(
        "issue_id", "log_id", "similarity", "importance", "rank")


def sql_encoded(source: str, key: str, column: str, prefix: str) -> list[tuple[str, str]]:
    p = prefix
    return [
        (f"{p}_h", f"SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {WIDTH} AS d FROM "
                   f"(SELECT {key}, unnest(w) AS w FROM ({sql_words(source, key, column)}))"),
        (f"{p}_n", f"SELECT {key}, d, count(*) AS x FROM {p}_h GROUP BY 1, 2"),
        (f"{p}_e", f"SELECT {key}, d, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {p}_n"),
    ]


SQL_HYBRID = [
    ("kept", SQL_KEPT),
    ("issues", SQL_ISSUES),
    *sql_encoded("kept", "log_id", "message", "k"),
    *sql_encoded("issues", "issue_id", "description", "q"),
    ("sims", "SELECT issue_id, log_id, round(sum(k_e.x * q_e.x), 6) AS similarity FROM k_e JOIN q_e USING (d) GROUP BY 1, 2"),
    ("hits", "SELECT issue_id, log_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY issue_id "
             "ORDER BY similarity DESC, log_id) AS r FROM (SELECT i.issue_id, k.log_id, coalesce(s.similarity, 0) AS similarity "
             "FROM issues i CROSS JOIN kept k LEFT JOIN sims s ON s.issue_id = i.issue_id AND s.log_id = k.log_id)) WHERE r <= 50"),
    ("scored", "SELECT i.issue_id, k.log_id, k.importance, coalesce(h.similarity, 0) AS similarity, "
               "round(k.importance * 0.7::DOUBLE + coalesce(h.similarity, 0) * 0.3::DOUBLE, 6) AS score FROM issues i CROSS JOIN kept k "
               "LEFT JOIN hits h ON h.issue_id = i.issue_id AND h.log_id = k.log_id"),
    ("ranked", "SELECT *, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, log_id) AS INT) AS rank FROM scored"),
]


@query("hybrid_rank", with_logs(
    " SELECT issue_id, log_id, importance, similarity, score, rank FROM ranked WHERE rank <= 50", *SQL_HYBRID))
def hybrid_rank(spark, sf):
    return ops.hybrid_rank(scored_logs(spark, sf), issues(spark), hashing_encoder(WIDTH)).select(
        "issue_id", "log_id", "importance", "similarity", "score", "rank")


# --- category, advice, timeline, patterns ----------------------------------------------


@query("categorize_issue", f"SELECT conv_id, turn, {sql_category('text')} AS category FROM conversations")
def categorize_issue(spark, sf):
    asked = table(spark, sf, "conversations").withColumn("description", F.col("text"))
    return ops.categorize(asked).select("conv_id", "turn", "category")


def sql_advice() -> str:
    rows = [(c, i, t) for c, items in dims.ADVICE.items() for i, t in enumerate(items, start=1)]
    return f"SELECT * FROM (VALUES {values(rows)}) AS v(category, ord, recommendation)"


@query("recommendations", f"""
  WITH c AS (SELECT doc_id AS issue_id, {sql_category('text')} AS category FROM documents), a AS ({sql_advice()})
  SELECT c.issue_id, c.category, CAST(a.ord AS INT) AS ord, a.recommendation FROM c
  JOIN a ON a.category = CASE WHEN c.category IN (SELECT category FROM a) THEN c.category ELSE '' END""")
def recommendations(spark, sf):
    asked = table(spark, sf, "documents").select(
        F.col("doc_id").alias("issue_id"), F.col("text").alias("description"))
    return ops.recommendations(asked)


@query("categories", with_logs(
    " SELECT v.category, v.priority, list_aggregate(v.keywords, 'string_agg', ',') AS keywords, "
    "count(l.log_id) AS mentions FROM (VALUES "
    + ", ".join(f"('{c}', {p}, {words})" for p, (c, words) in enumerate(dims.CATEGORY_KEYWORDS))
    + ") AS v(category, priority, keywords) LEFT JOIN logs l ON len(list_filter(v.keywords, "
      "lambda k: contains(lower(l.message), k))) > 0 GROUP BY 1, 2, 3"))
def categories(spark, sf):
    """Every category with its keywords and the number of lines that mention one of them."""
    from logquarry.functions.text import mentions

    hits = logs(spark, sf).agg(*[
        F.count_if(mentions(F.col("message"), words)).alias(name) for name, words in dims.CATEGORY_KEYWORDS])
    listed = F.array(*[
        F.struct(F.lit(name).alias("category"), F.lit(p).alias("priority"),
                 F.lit(",".join(words)).alias("keywords"), F.col(name).alias("mentions"))
        for p, (name, words) in enumerate(dims.CATEGORY_KEYWORDS)])
    return hits.select(F.inline(listed))


@query("timeline", with_logs(f"""
  SELECT log_id, timestamp, {SQL_EVENT} AS event_type, message, service_type AS service, level
  FROM logs WHERE {SQL_EVENT} IS NOT NULL"""))
def timeline(spark, sf):
    return ops.timeline(logs(spark, sf)).select(
        "log_id", "timestamp", "event_type", "message", F.col("service_type").alias("service"), "level"
    ).orderBy("timestamp", "log_id")


def sql_counters(patterns) -> str:
    return ", ".join(f"count(*) FILTER (WHERE regexp_matches(message, '(?i){p}')) AS {n}" for n, p in patterns)


@query("resource_patterns", with_logs(
    f" SELECT service_type, {sql_counters(dims.RESOURCE_COUNTERS)} FROM logs GROUP BY service_type"))
def resource_patterns(spark, sf):
    return ops.resource_patterns(logs(spark, sf), "service_type")


@query("network_patterns", with_logs(
    f" SELECT service_type, {sql_counters(dims.NETWORK_COUNTERS)} FROM logs GROUP BY service_type"))
def network_patterns(spark, sf):
    return ops.network_patterns(logs(spark, sf), "service_type")


def sql_issue_counters(pattern: str, patterns, wanted) -> str:
    names = "', '".join(wanted)
    return " UNION ALL ".join(
        f"SELECT issue_id, '{pattern}' AS pattern, '{n}' AS key, count(*) FILTER (WHERE regexp_matches(message, '(?i){p}')) AS n "
        f"FROM lines WHERE category IN ('{names}') GROUP BY issue_id" for n, p in patterns)


SQL_LINES = ("lines", f"SELECT r.*, {sql_category('i.description')} AS category, i.description "
                      "FROM relevant r JOIN issues i USING (issue_id)")


@query("issue_patterns", with_logs(f"""
  SELECT issue_id, 'error_count' AS pattern, '' AS key, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS n
  FROM lines GROUP BY issue_id
  UNION ALL SELECT issue_id, 'level_distribution', level, count(*) FROM lines GROUP BY issue_id, level
  UNION ALL SELECT issue_id, 'service_distribution', service_type, count(*) FROM lines GROUP BY issue_id, service_type
  UNION ALL {sql_issue_counters('resource_patterns', dims.RESOURCE_COUNTERS, dims.RESOURCE_COUNTER_CATEGORIES)}
  UNION ALL {sql_issue_counters('network_patterns', dims.NETWORK_COUNTERS, dims.NETWORK_COUNTER_CATEGORIES)}""",
    *sql_fast(), SQL_LINES))
def issue_patterns(spark, sf):
    asked = issues(spark)
    return ops.issue_patterns(ops.fast_filter(scored_logs(spark, sf), asked), asked)


# --- reports ---------------------------------------------------------------------------

NL = "chr(10)"
SQL_STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')"
SQL_REPORT = [
    *sql_fast(), SQL_LINES,
    ("per_issue", "SELECT issue_id, any_value(description) AS description, any_value(category) AS category, "
                  "count(*) AS n, count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL')) AS e, "
                  "min(timestamp) AS first_time, max(timestamp) AS last_time FROM lines GROUP BY issue_id"),
    ("services", "SELECT issue_id, service_type, count(*) AS n, row_number() OVER (PARTITION BY issue_id "
                 "ORDER BY count(*) DESC, service_type) AS r FROM lines GROUP BY issue_id, service_type"),
    ("events", f"SELECT *, {SQL_EVENT} AS event_type, row_number() OVER (PARTITION BY issue_id ORDER BY timestamp, log_id) AS r "
               f"FROM lines WHERE {SQL_EVENT} IS NOT NULL"),
    ("service_text", "SELECT issue_id, '{' || string_agg('''' || service_type || ''': ' || n, ', ' ORDER BY r) || '}' AS mapping, "
                     f"string_agg('  * ' || service_type || ': ' || n || ' events', {NL} ORDER BY r) FILTER (WHERE r <= 3) AS top3 "
                     "FROM services GROUP BY issue_id"),
    ("event_text", f"SELECT issue_id, count(*) AS n, string_agg('- ' || {SQL_STAMP} || ': ' || event_type || ' (' || service_type || ')', {NL} ORDER BY r) "
                   f"FILTER (WHERE r <= 10) AS first10, string_agg('- ' || {SQL_STAMP} || ': ' || event_type, {NL} ORDER BY r) "
                   "FILTER (WHERE r <= 5) AS first5 FROM events GROUP BY issue_id"),
    ("line_text", "SELECT issue_id, string_agg('- [' || level || '] ' || service_type || ': ' || message || ' (Score: ' || "
                  f"printf('%.3f', score) || ')', {NL} ORDER BY rank) AS best FROM lines WHERE rank <= 20 GROUP BY issue_id"),
    ("advice_text", f"SELECT category, string_agg('- ' || recommendation, {NL} ORDER BY ord) AS advice FROM ({sql_advice()}) GROUP BY category"),
    ("reports", "SELECT p.*, " + f"""'Issue Description: ' || description || {NL} || 'Issue Category: ' || p.category || {NL} || {NL} ||
        'Pattern Analysis:' || {NL} || '- Total relevant logs: ' || p.n || {NL} || '- Error count: ' || e || {NL} ||
        '- Service distribution: ' || mapping || {NL} || {NL} ||
        CASE WHEN v.n > 0 THEN 'Key Events Timeline:' || {NL} || first10 || {NL} || {NL} ELSE '' END ||
        'Most Relevant Logs:' || {NL} || best AS context,
        'Root Cause Analysis for ' || p.category || ' issue:' || {NL} || {NL} || 'Pattern Analysis:' || {NL} ||
        '- Found ' || p.n || ' relevant log entries' || {NL} || '- ' || e || ' error-level messages' || {NL} ||
        '- Most affected services:' || {NL} || top3 ||
        CASE WHEN v.n > 0 THEN {NL} || {NL} || 'Key Events:' || {NL} || first5 ELSE '' END || {NL} || {NL} ||
        'Recommendations:' || {NL} || a.advice AS report, coalesce(v.n, 0) AS events, a.advice
        FROM per_issue p JOIN service_text USING (issue_id) LEFT JOIN event_text v USING (issue_id) JOIN line_text USING (issue_id)
        JOIN advice_text a ON a.category = CASE WHEN p.category IN (SELECT category FROM advice_text) THEN p.category ELSE '' END"""),
]


def _gathered(spark, sf):
    asked = issues(spark)
    return reports.gathered_issues(ops.fast_filter(scored_logs(spark, sf), asked), asked)


@query("report_context", with_logs(" SELECT issue_id, context FROM reports", *SQL_REPORT))
def report_context(spark, sf):
    return _gathered(spark, sf).select("issue_id", reports.context_text().alias("context"))


@query("report_fallback", with_logs(" SELECT issue_id, report FROM reports", *SQL_REPORT))
def report_fallback(spark, sf):
    return _gathered(spark, sf).select("issue_id", reports.rule_report().alias("report"))


def _flat(analysis):
    return analysis.select(
        "issue_id", "issue_description", "issue_category", "relevant_logs_count", "error_count",
        "first_time", "last_time", F.coalesce(F.size("timeline"), F.lit(0)).alias("events"),
        F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("- "), r)), "\n").alias("recommendations"),
        "root_cause_analysis", "analysis_mode")


@query("analyze_issues", with_logs("""
  SELECT issue_id, description AS issue_description, category AS issue_category, n AS relevant_logs_count,
    e AS error_count, first_time, last_time, events, advice AS recommendations, report AS root_cause_analysis,
    'fast' AS analysis_mode FROM reports""", *SQL_REPORT))
def analyze(spark, sf):
    return _flat(analyze_issues(logs(spark, sf), issues(spark), materialize=stage))



@query("analyze_empty", with_logs(f"""
  SELECT issue_id, description AS issue_description, 'unknown' AS issue_category, 0 AS relevant_logs_count,
    0 AS error_count, CAST(NULL AS TIMESTAMP) AS first_time, CAST(NULL AS TIMESTAMP) AS last_time, 0 AS events,
    {" || chr(10) || ".join(f"'- {t}'" for t in dims.FAILED_ADVICE)} AS recommendations,
    'Analysis failed for issue: ' || description || '. Please check system logs manually.' AS root_cause_analysis,
    'fallback' AS analysis_mode FROM issues
  WHERE (SELECT count(*) FROM logs WHERE level = 'FATAL') = 0""", ("issues", SQL_ISSUES)))
def analyze_empty(spark, sf):
    """No line of the log has the level, so every issue gets the fixed answer."""
    return _flat(analyze_issues(logs(spark, sf).where("level = 'FATAL'"), issues(spark)))


SQL_HISTORY = [
    ("issues", SQL_ISSUES),
    ("docs", "SELECT *, service_type || ' ' || level || ': ' || message || CASE WHEN instance_id IS NULL THEN '' "
             "ELSE ' [Instance: ' || instance_id || ']' END AS document FROM logs"),
    *sql_encoded("docs", "log_id", "document", "k"),
    *sql_encoded("issues", "issue_id", "description", "q"),
    ("sims", "SELECT issue_id, log_id, round(sum(k_e.x * q_e.x), 6) AS similarity FROM k_e JOIN q_e USING (d) GROUP BY 1, 2"),
    ("hits", "SELECT * FROM (SELECT i.issue_id, d.*, coalesce(s.similarity, 0) AS similarity, row_number() OVER (PARTITION BY i.issue_id "
             "ORDER BY coalesce(s.similarity, 0) DESC, d.log_id) AS r FROM issues i CROSS JOIN docs d "
             "LEFT JOIN sims s ON s.issue_id = i.issue_id AND s.log_id = d.log_id) WHERE r <= 10"),
]


@query("history_context", with_logs(f"""
  SELECT issue_id, string_agg('Historical Log ' || r || ' (Similarity: ' || printf('%.3f', round(similarity, 3)) || '):' || {NL} ||
    '  ' || document || {NL} || '  Service: ' || service_type || {NL} || '  Level: ' || level || {NL} ||
    '  Timestamp: ' || {SQL_STAMP} || {NL}, {NL} ORDER BY r) AS history
  FROM hits GROUP BY issue_id""", *SQL_HISTORY))
def history_context(spark, sf):
    docs = to_documents(logs(spark, sf))
    return reports.history_context(history_hits(docs, issues(spark), hashing_encoder(WIDTH)))
