"""Label encoding and the compact feature set for classic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import text

MISSING = "unknown"


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes from 0 in sorted order, null as ``unknown``.

    Meant for categories (levels, services, modules): only their distinct values are sorted, in
    one task.
    """
    values = df.select(F.coalesce(column, F.lit(MISSING)).alias("value")).distinct()
    return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def apply_labels(df: DataFrame, labels: DataFrame, column: str, on_unseen: str = "error") -> DataFrame:
    """Adds ``<column>_encoded``; a value the encoder never saw is an error or null."""
    code = F.col("code")
    if on_unseen == "error":
        code = F.when(code.isNotNull(), code).otherwise(
            F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col("_value"))).cast("int")
        )
    joined = df.withColumn("_value", F.coalesce(column, F.lit(MISSING))).join(
        labels.withColumnRenamed("value", "_value"), "_value", "left"
    )
    return joined.withColumn(f"{column}_encoded", code).drop("_value", "code")


def indexed_features(df: DataFrame) -> DataFrame:
    """Cleaned text, its size, time parts, presence flags and keyword flags."""
    cleaned = df.withColumn("cleaned_message", text.clean(F.col("message")))
    ts = F.col("timestamp")
    words = F.regexp_count("cleaned_message", F.lit("[a-z]+"))
    return cleaned.withColumns({
        "message_length": F.length("message"),
        "word_count": words,
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "minute": F.minute(ts),
        "has_instance_id": F.col("instance_id").isNotNull().cast("int"),
        "has_request_id": F.col("request_id").isNotNull().cast("int"),
        **text.keyword_flags(F.col("cleaned_message")),
    })


MODEL_INPUT = [
    "message_length", "word_count", "hour", "day_of_week", "minute",
    "level_encoded", "service_type_encoded", "module_encoded", "has_instance_id", "has_request_id",
]


def classic_matrix(df: DataFrame, key: str = "log_id", labels: dict[str, DataFrame] | None = None) -> DataFrame:
    """The key and the 20 columns of classic models: sizes, time parts, codes of level, service and module, flags.

    ``labels`` holds the codes of the training table by column; by default they are fitted on ``df``.
    """
    coded = df
    for column in ("level", "service_type", "module"):
        coded = apply_labels(coded, labels[column] if labels else fit_labels(df, column), column)
    return indexed_features(coded).select(key, *MODEL_INPUT, *text.keyword_flags(F.col("message")))
