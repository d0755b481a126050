"""Quality of a binary predictor, from one table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction", *keys: str) -> DataFrame:
    """Counts of the confusion table, accuracy, precision and recall, per key if any."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    counted = df.groupBy(*keys).agg(
        F.count_if(actual & said).alias("true_positive"),
        F.count_if(~actual & said).alias("false_positive"),
        F.count_if(actual & ~said).alias("false_negative"),
        F.count_if(~actual & ~said).alias("true_negative"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return counted.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    })


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1 and support."""
    counts = confusion(df, label, prediction)
    both = counts.select(F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )).alias("c")).select("c.*")
    summed = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    return summed.select(
        "class", "support", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )
