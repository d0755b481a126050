"""End-to-end analysis of a table of issues against a table of logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.operators import issues as ops
from logquarry.operators.issues import advice
from logquarry.operators.reports import context_text, gather, rule_report
from logquarry.operators.search import top_by_similarity
from logquarry.operators.tfidf import TfidfModel


LINE_COLUMNS = ["log_id", *ops.PAYLOAD]


def analyze_issues(
    logs: DataFrame,
    issues: DataFrame,
    mode: str = "fast",
    encoder: Callable[[Column], Column] | None = None,
    model: TfidfModel | None = None,
    score: Column | None = None,
    k: int = dims.TOP_RELEVANT,
    history: DataFrame | None = None,
    materialize: Callable[[DataFrame], DataFrame] | None = None,
    embedding: str | None = None,
) -> DataFrame:
    """One row per issue: category, counts, time range, timeline, advice, context and report.

    The lines are scored once for all issues. ``materialize`` may write the scored lines to a
    table, so that the percentile, the term fit and the search do not score them again.
    Issues for which there is nothing to analyse get the fixed answer. In hybrid mode ``embedding`` names a column of
    ``logs`` that holds the lines' vectors, as a document store keeps them; then only issues are encoded.
    """
    if mode not in ("fast", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    scored = ops.with_importance(logs, score).select(*LINE_COLUMNS, *([embedding] if embedding else []))
    if materialize is not None:
        scored = materialize(scored)
    survivors = ops.importance_filter(scored)
    if mode == "fast":
        relevant = ops.fast_filter(scored, issues, model, k, survivors=survivors)
    else:
        if encoder is None:
            raise ValueError("hybrid mode needs an encoder")
        relevant = ops.hybrid_rank(scored, issues, encoder, k, survivors=survivors, embedding=embedding)
    return summarize(relevant, issues, mode, history)


def summarize(relevant: DataFrame, issues: DataFrame, mode: str, history: DataFrame | None = None) -> DataFrame:
    table = ops.categorize(issues).join(gather(relevant), "issue_id", "left")
    if history is not None:
        table = table.join(history, "issue_id", "left")
    past = F.col("history") if history is not None else None
    found = F.col("lines").isNotNull()
    failed = F.concat(
        F.lit("Analysis failed for issue: "), F.col("description"),
        F.lit(". Please check system logs manually."))
    category = F.when(found, F.col("category")).otherwise(dims.UNKNOWN_CATEGORY)
    return table.select(
        "issue_id",
        F.col("description").alias("issue_description"),
        category.alias("issue_category"),
        F.coalesce("relevant_logs", F.lit(0)).alias("relevant_logs_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        "first_time",
        "last_time",
        "timeline",
        "services",
        "lines",
        advice(category).alias("recommendations"),
        F.when(found, rule_report()).otherwise(failed).alias("root_cause_analysis"),
        F.when(found, context_text(past)).alias("context"),
        F.when(found, F.lit(mode)).otherwise("fallback").alias("analysis_mode"),
    )


def history_hits(
    documents: DataFrame, issues: DataFrame, encoder: Callable[[Column], Column],
    k: int = dims.HISTORY_SIZE, text: str = "document", embedding: str | None = None,
) -> DataFrame:
    """Best stored documents per issue, the input of the history block."""
    vector = embedding or "_vector"
    encoded = documents if embedding else documents.withColumn(vector, encoder(F.col(text)))
    queries = issues.select("issue_id", encoder(F.col("description")).alias(vector))
    return top_by_similarity(
        encoded, queries, k, vector=vector, carry=(text, "service_type", "level", "timestamp")
    )
