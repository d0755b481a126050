"""Texts per issue. Each issue has at most a few dozen relevant lines; they are gathered once
as an array and everything else is an expression on that array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.operators.issues import advice, categorize, event_type
from logquarry.operators.topk import top_per_group

NEWLINE = "\n"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, STAMP), F.lit("None"))


def _text(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def gather(relevant: DataFrame) -> DataFrame:
    """Per issue: lines by rank, events by time, services by count, errors and time range."""
    line = F.struct("rank", "log_id", "timestamp", "level", "service_type", "message", "score")
    grouped = relevant.groupBy("issue_id").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    events = F.transform(
        "lines",
        lambda x: F.struct(
            x["timestamp"].alias("timestamp"), x["log_id"].alias("log_id"),
            event_type(x["message"]).alias("event_type"), x["message"].alias("message"),
            x["service_type"].alias("service"), x["level"].alias("level"),
        ),
    )
    named = F.array_distinct(F.filter(F.transform("lines", lambda x: x["service_type"]), lambda s: s.isNotNull()))
    sized = F.transform(
        named,
        lambda s: F.struct(
            (-F.size(F.filter("lines", lambda x: x["service_type"] == s))).alias("minus_n"), s.alias("service")
        ),
    )
    return grouped.withColumns({
        "relevant_logs": F.size("lines"),
        "error_count": F.size(F.filter("lines", lambda x: x["level"].rlike("(?i)(ERROR|CRITICAL)"))),
        "timeline": F.array_sort(F.filter(events, lambda e: e["event_type"].isNotNull())),
        "services": F.array_sort(sized),
    })


def service_mapping(services: Column) -> Column:
    """``{'name': count, ...}`` by descending count."""
    parts = F.transform(
        services,
        lambda s: F.concat(F.lit("'"), s["service"], F.lit("': "), (-s["minus_n"]).cast("string")),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def _lines(parts: list[Column]) -> Column:
    """Concatenate arrays of lines into one text."""
    return F.array_join(F.concat(*parts), NEWLINE)


def _const(*texts) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])


def context_text(history: Column | None = None, events: int = 10, lines: int = 20) -> Column:
    """Issue, category, history, patterns, first events and best lines."""
    none = F.array().cast("array<string>")
    happened = F.transform(
        F.slice("timeline", 1, events),
        lambda e: F.concat(F.lit("- "), _stamp(e["timestamp"]), F.lit(": "), e["event_type"],
                           F.lit(" ("), _text(e["service"], "None"), F.lit(")")),
    )
    best = F.transform(
        F.slice("lines", 1, lines),
        lambda x: F.concat(
            F.lit("- ["), _text(x["level"], "INFO"), F.lit("] "), _text(x["service_type"], "unknown"), F.lit(": "),
            _text(x["message"], ""), F.lit(" (Score: "), F.format_string("%.3f", F.round(x["score"], 3)), F.lit(")"),
        ),
    )
    past = none if history is None else F.when(
        F.coalesce(history, F.lit("")) != "",
        _const("Historical Context (Similar Issues):", history, ""),
    ).otherwise(none)
    return _lines([
        _const(F.concat(F.lit("Issue Description: "), F.col("description")),
               F.concat(F.lit("Issue Category: "), F.col("category")), ""),
        past,
        _const("Pattern Analysis:",
               F.concat(F.lit("- Total relevant logs: "), F.col("relevant_logs").cast("string")),
               F.concat(F.lit("- Error count: "), F.col("error_count").cast("string")),
               F.concat(F.lit("- Service distribution: "), service_mapping(F.col("services"))), ""),
        F.when(F.size("timeline") > 0, F.concat(_const("Key Events Timeline:"), happened, _const(""))).otherwise(none),
        F.when(F.size("lines") > 0, F.concat(_const("Most Relevant Logs:"), best)).otherwise(none),
    ])


def rule_report(events: int = 5, services: int = 3) -> Column:
    """The report made from counts, first events and advice."""
    none = F.array().cast("array<string>")
    most = F.transform(
        F.slice("services", 1, services),
        lambda s: F.concat(F.lit("  * "), s["service"], F.lit(": "), (-s["minus_n"]).cast("string"), F.lit(" events")),
    )
    happened = F.transform(
        F.slice("timeline", 1, events),
        lambda e: F.concat(F.lit("- "), _stamp(e["timestamp"]), F.lit(": "), e["event_type"]),
    )
    return _lines([
        _const(F.concat(F.lit("Root Cause Analysis for "), F.col("category"), F.lit(" issue:")), "",
               "Pattern Analysis:",
               F.concat(F.lit("- Found "), F.col("relevant_logs").cast("string"), F.lit(" relevant log entries")),
               F.concat(F.lit("- "), F.col("error_count").cast("string"), F.lit(" error-level messages")),
               "- Most affected services:"),
        most,
        F.when(F.size("timeline") > 0, F.concat(_const("", "Key Events:"), happened)).otherwise(none),
        _const("", "Recommendations:"),
        F.transform(advice(F.col("category")), lambda r: F.concat(F.lit("- "), r)),
    ])


def gathered_issues(relevant: DataFrame, issues: DataFrame) -> DataFrame:
    return categorize(issues).join(gather(relevant), "issue_id")


def history_context(hits: DataFrame, k: int = dims.HISTORY_SIZE, max_chars: int | None = None) -> DataFrame:
    """Per issue the numbered texts of its best distinct hits, in full unless ``max_chars`` is given.

    ``hits`` has issue_id, log_id, document, service_type, level, timestamp, similarity.
    """
    copies = ["issue_id", "document", "service_type", "level", "timestamp"]
    unique = top_per_group(hits, copies, [F.desc("similarity"), F.col("log_id")], 1, rank="_copy").drop("_copy", "rank")
    best = top_per_group(unique, ["issue_id"], [F.desc("similarity"), F.col("log_id")], k)
    block = F.concat(
        F.lit("Historical Log "), F.col("rank").cast("string"), F.lit(" (Similarity: "),
        F.format_string("%.3f", F.round("similarity", 3)), F.lit("):\n  "), F.col("document"),
        F.lit("\n  Service: "), _text(F.col("service_type"), "None"),
        F.lit("\n  Level: "), _text(F.col("level"), "None"),
        F.lit("\n  Timestamp: "), _stamp(F.col("timestamp")), F.lit("\n"),
    )
    found = best.groupBy("issue_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks")
    ).select(
        "issue_id",
        F.array_join(F.transform("blocks", lambda b: b["block"]), NEWLINE).alias("history"),
    )
    return found if max_chars is None else found.withColumn("history", F.left("history", F.lit(max_chars)))
