"""Rule-based importance of a log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import dims
from logquarry.functions.temporal import flag
from logquarry.functions.text import mentions


def signals(level: Column, message: Column) -> dict[str, Column]:
    lowered = F.lower(F.coalesce(level, F.lit("")))
    text = F.coalesce(message, F.lit(""))
    return {
        "is_error": lowered.isin("error", "critical"),
        "is_warning": lowered == "warning",
        "has_keyword": mentions(text, dims.IMPORTANT_WORDS),
        "has_critical": mentions(text, dims.CRITICAL_PHRASES),
        "has_lifecycle": mentions(text, dims.LIFECYCLE_PHRASES),
        "has_resource": mentions(text, dims.RESOURCE_PHRASES),
    }


def label(level: Column, message: Column) -> Column:
    """1 if any signal holds, else 0."""
    found = None
    for condition in signals(level, message).values():
        found = condition if found is None else found | condition
    return found.cast("int")


def rule_score(level: Column, message: Column) -> Column:
    """Share of the signals that hold, the level counting most; stands in for a model.

    All weights are eighths, so the sum is exact in binary floating point.
    """
    s = signals(level, message)
    weights = {"is_error": 4, "is_warning": 2, "has_keyword": 1, "has_critical": 1,
               "has_lifecycle": 1, "has_resource": 1}
    total = None
    for name, weight in weights.items():
        part = flag(s[name]) * weight
        total = part if total is None else total + part
    return total / F.lit(8.0)


def explain(importance: Column, similarity: Column, high: float = dims.HIGH_SCORE) -> Column:
    return (
        F.when((importance >= high) & (similarity >= high), "High importance + High similarity")
        .when(importance >= high, "High importance + Moderate similarity")
        .when(similarity >= high, "Moderate importance + High similarity")
        .otherwise("Moderate importance + Moderate similarity")
    )


def urgency(text: Column) -> Column:
    return (
        F.when(mentions(text, dims.IMMEDIATE_WORDS), "immediate")
        .when(mentions(text, dims.SHORT_TERM_WORDS), "short_term")
        .otherwise("long_term")
    )
