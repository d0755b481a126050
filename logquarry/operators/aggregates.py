"""Aggregates over log and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry import dims
from logquarry.functions.text import contains_ignoring_case
from logquarry.operators.filters import level_is


def counts_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    known = df.where(F.col(column).isNotNull())
    return counts_by(known, column).orderBy(F.desc("n"), column).limit(k)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts with their share of all rows in percent; missing values count as unknown."""
    counts = counts_by(df.withColumn(column, F.coalesce(column, F.lit("unknown"))), column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.try_divide(F.col("n") * 100.0, total)).orderBy(F.desc("n"), column)


def key_figures(df: DataFrame) -> DataFrame:
    """Rows, errors and how many instances and services there are.

    Rows are counted per (instance, service) first, so the exact distinct counts run over those few pairs.
    """
    pairs = df.groupBy("instance_id", "service_type").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(level_is("ERROR")).alias("_errors"))
    total, errors = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_errors"), F.lit(0))
    return pairs.agg(
        total.alias("total_logs"),
        errors.alias("error_count"),
        F.coalesce(F.try_divide(errors * 100.0, total), F.lit(0.0)).alias("error_rate"),
        F.count_distinct("instance_id").alias("unique_instances"),
        F.count_distinct("service_type").alias("unique_services"),
    )


def ingest_stats(df: DataFrame) -> DataFrame:
    """Totals, and counts by service and by level, as one long table.

    ``part`` names the grouping; distinct files and instances belong to the total row.
    """
    grouped = df.groupingSets(
        [[], [F.col("service_type")], [F.col("level")]], F.col("service_type"), F.col("level")
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("entries"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )
    parts = grouped.select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "service").otherwise("level").alias("part"),
        F.when(F.col("gid") == 1, F.col("service_type")).when(F.col("gid") == 2, F.col("level")).alias("key"),
        "entries", "first_time", "last_time",
    )
    distinct = df.select("instance_id", "source_file").distinct().agg(
        F.count_distinct("instance_id").alias("instances"),
        F.count_distinct("source_file").alias("files"),
    )
    both = distinct.select(F.struct("instances", "files")).scalar()
    is_total = F.col("part") == "total"
    return parts.select(
        "*",
        F.when(is_total, both["instances"]).alias("instances"),
        F.when(is_total, both["files"]).alias("files"),
    )


def hourly_levels(df: DataFrame) -> DataFrame:
    return df.groupBy(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"), "level"
    ).agg(F.count(F.lit(1)).alias("n"))


def instance_heatmap(df: DataFrame, k: int = 20) -> DataFrame:
    """Rows per hour of day of the k busiest instances.

    The hours are counted in the same aggregation that ranks the instances.
    """
    hours = [
        F.count_if(F.hour("timestamp") == h).alias(f"h{h:02d}") for h in range(24)
    ]
    per_instance = df.where(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("total"), *hours
    )
    return per_instance.orderBy(F.desc("total"), "instance_id").limit(k)


def hour_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("activity"))


def error_frequency(df: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Error rows by the error word their message contains; of several, the one listed last."""
    words = keywords or dims.INSPECT_WORDS
    kind = F.coalesce(
        *[F.when(contains_ignoring_case(F.col("message"), w), F.lit(w)) for w in reversed(words)],
        F.lit("other"),
    )
    severe = df.where(F.upper("level").isin("ERROR", "CRITICAL"))
    return severe.groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("frequency"))


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if("is_chunked").alias("chunked_documents"),
        F.count_if(~F.col("is_chunked")).alias("non_chunked_documents"),
    )


def dimension_check(docs: DataFrame, column: str = "embedding") -> DataFrame:
    size = F.size(column)
    return docs.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.min(size).alias("min_dimensions"),
        F.max(size).alias("max_dimensions"),
    )


def feature_summary(df: DataFrame) -> DataFrame:
    """Columns by type and by name family, and the number of missing cells."""
    fields = df.schema.fields
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    textual = sum(isinstance(f.dataType, T.StringType) for f in fields)
    dated = sum(isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) for f in fields)
    missing = sum((F.count_if(F.col(f"`{f.name}`").isNull()) for f in fields), F.lit(0))
    families = {
        family: sum(any(part in f.name for part in parts) for f in fields)
        for family, parts in dims.COLUMN_FAMILIES
    }
    return df.agg(missing.cast("long").alias("missing_values")).select(
        F.lit(len(fields)).alias("total_features"),
        F.lit(numeric).alias("numerical_features"),
        F.lit(textual).alias("categorical_features"),
        F.lit(dated).alias("datetime_features"),
        "missing_values",
        *[F.lit(n).alias(f"{family}_columns") for family, n in families.items()],
    )


def run_benchmark_summary(runs: DataFrame) -> DataFrame:
    """Per query and overall: mean, best and worst time per mode and the speed-up."""
    hybrid, fast = F.col("mode") == "hybrid", F.col("mode") == "fast"

    def measures(label):
        return [
            F.count(F.lit(1)).alias("tests"),
            F.avg(F.when(hybrid, F.col("duration"))).alias("avg_hybrid"),
            F.avg(F.when(fast, F.col("duration"))).alias("avg_fast"),
            F.min(F.when(hybrid, F.col("duration"))).alias("best_hybrid"),
            F.max(F.when(hybrid, F.col("duration"))).alias("worst_hybrid"),
            F.min_by(label, F.when(hybrid, F.struct("duration", "run_id"))).alias("best_query"),
            F.max_by(label, F.when(hybrid, F.struct("duration", "run_id"))).alias("worst_query"),
            F.avg(F.when(hybrid, F.col("relevant_logs"))).alias("avg_hybrid_logs"),
            F.avg(F.when(fast, F.col("relevant_logs"))).alias("avg_fast_logs"),
        ]

    label = F.col("label")
    tagged = runs.withColumn("label", F.col("category"))
    rolled = tagged.rollup("category").agg(*measures(label))
    return rolled.withColumns({
        "category": F.coalesce("category", F.lit("(all)")),
        "speedup": F.try_divide(F.col("avg_hybrid"), F.col("avg_fast")),
    })


